"""Ordered folds against the plain loop they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.grouped import fold_groups
from corpuslens.functions.ordered import numbered
from corpuslens.operators.packing import pack_batches
from corpuslens.operators.triage import _greedy
from corpuslens.session import cut_lineage


def plain_batches(sizes, limit):
    out, batch, carry, empty = [], 0, 0, True
    for s in sizes:
        if carry + s > limit and not empty:
            batch, carry = batch + 1, 0
        carry, empty = carry + s, False
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for project in range(3):
        sizes = [rng.choice([0, 1, 2, 3, 5, 9, 12, 16, 25]) for _ in range(rng.randint(1, 120))]
        for i, (s, b) in enumerate(zip(sizes, plain_batches(sizes, 16))):
            rows.append((project, i, 0, 0, s))
            want[(project, i)] = b
    df = spark.createDataFrame(rows, "project_id long, file_seq long, chunk_seq int, piece int, token_count int")
    got = pack_batches(df, 16, files_per_block=7, blocks_per_group=3).collect()
    assert {(r["project_id"], r["file_seq"]): r["batch_no"] for r in got} == want


def test_spacing_of_file_numbers_does_not_matter(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 3, 9, 12]) for _ in range(200)]
    numbers = sorted(rng.getrandbits(63) - (1 << 62) for _ in sizes)
    df = spark.createDataFrame(
        [(0, n, 0, 0, s) for n, s in zip(numbers, sizes)], "project_id long, file_seq long, chunk_seq int, piece int, token_count int"
    )
    got = pack_batches(df, 16, files_per_block=10, blocks_per_group=4).orderBy("file_seq").collect()
    assert [r["batch_no"] for r in got] == plain_batches(sizes, 16)
    blocks = numbered(df.select("project_id", "file_seq"), ["project_id", "file_seq"], "no")
    assert sorted(r["no"] for r in blocks.collect()) == list(range(200))


def test_known_batches(spark):
    rows = [(0, i, 0, 0, s) for i, s in enumerate([9, 9, 9, 3, 16, 2])]
    df = spark.createDataFrame(rows, "project_id long, file_seq long, chunk_seq int, piece int, token_count int")
    got = pack_batches(df, 16, files_per_block=1, blocks_per_group=1).orderBy("file_seq").collect()
    assert [r["batch_no"] for r in got] == [0, 1, 2, 2, 3, 4]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(0, f"p{i:03d}", 0, 0, rng.choice([0, 1, 2, 3, 7, 20, 60]), float(rng.randint(0, 20))) for i in range(150)]
    budget, used, want = 100, 0, set()
    for _, path, _, _, size, rank in sorted(rows, key=lambda r: (r[5], r[1])):
        if used >= budget:
            break
        if used + size <= budget:
            used += size
            want.add(path)
    df = spark.createDataFrame(rows, "project_id long, path string, chunk_seq int, piece int, size long, rank double")
    got = {r["path"] for r in _greedy(df, budget).select("path").collect()}
    assert got == want


def test_greedy_skips_and_goes_on(spark):
    rows = [(0, f"p{i}", 0, 0, s, float(i)) for i, s in enumerate([5, 7, 3, 2])]
    df = spark.createDataFrame(rows, "project_id long, path string, chunk_seq int, piece int, size long, rank double")
    assert sorted(r["path"] for r in _greedy(df, 10).select("path").collect()) == ["p0", "p2", "p3"]


def test_groups_stay_whole_after_a_join_on_their_keys(spark):
    """Spark leaves out a shuffle by keys just joined on; the join, planned as a sort-merge join, then becomes a broadcast."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        rows = cut_lineage(spark.range(4000).repartition(8).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")))
        few = cut_lineage(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("s")))
        got = fold_groups(rows.join(few, "k"), ["k"], ["v"], lambda key, r: [(*key, len(r))], "k long, n long").collect()
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert sorted((r["k"], r["n"]) for r in got) == [(k, 80) for k in range(50)]
