"""Merging, clustering, correlation and comparison on small hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import correlate, diffing, findings
from corpuslens.operators.clusters import cluster_findings, connected_components
from corpuslens.plans.fixtures import Fixtures

COLS = "seq long, project_id long, agent_name string, severity string, title string, description string, path string, line_start int, line_end int, score_penalty double"


def frame(spark, rows):
    full = [(i, 0, a, s, t, d, p, l, l, None) for i, (a, s, t, d, p, l) in enumerate(rows)]
    return spark.createDataFrame(full, COLS)


def merged(spark, rows):
    return findings.merge_findings(frame(spark, rows)).orderBy("component").collect()


def test_same_agent_half_overlap_is_not_enough(spark):
    rows = [("security", "high", "SQL injection", "a", "x.ts", 10), ("security", "high", "sql-injection in login", "b", "x.ts", 12)]
    assert len(merged(spark, rows)) == 2


def test_more_severe_text_leads(spark):
    rows = [("logic", "low", "Bad lock here", "first", "x.ts", 10), ("logic", "critical", "Bad lock here", "second", "x.ts", 60)]
    (m,) = merged(spark, rows)
    assert m["severity"] == "critical"
    assert m["description"] == "second\n\nAdditional context: first"


def test_equal_texts_are_not_repeated(spark):
    rows = [("logic", "low", "Bad lock", "same", "x.ts", 1)] * 3
    (m,) = merged(spark, rows)
    assert m["description"] == "same" and m["n_merged"] == 3


def test_wordless_titles_stay_apart(spark):
    assert len(merged(spark, [("logic", "low", "!!!", "a", "x.ts", 1), ("logic", "low", "@@@", "b", "x.ts", 1)])) == 2


def test_far_lines_and_other_files_stay_apart(spark):
    rows = [("logic", "low", "Bad lock", "a", "x.ts", 1), ("logic", "low", "Bad lock", "b", "x.ts", 62), ("logic", "low", "Bad lock", "c", "y.ts", 1)]
    assert len(merged(spark, rows)) == 3


def test_file_level_by_description(spark):
    rows = [("logic", "low", "God object", "too many duties in one class", "x.ts", None), ("security", "low", "Huge class", "too many duties in one class", "x.ts", None)]
    assert len(merged(spark, rows)) == 1


def test_fingerprints_join_across_titles(spark):
    f = frame(spark, [("logic", "low", "alpha", "a", "x.ts", 1), ("logic", "low", "beta", "b", "x.ts", 300)])
    f = f.withColumn("fingerprint", F.lit("same"))
    assert cluster_findings(f).select("component").distinct().count() == 1


def brute_clusters(rows):
    def words(t):
        return {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()}

    def sim(a, b):
        a, b = words(a), words(b)
        return len(a & b) / len(a | b) if a and b else 0

    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[4] != b[4]:
                continue
            bar = 0.5 if a[0] == b[0] else 0.7
            if a[5] is not None and b[5] is not None:
                s = sim(a[2], b[2])
                ok = abs(a[5] - b[5]) <= 60 and s > bar or a[5] == b[5] and a[1] == b[1] and s > 0.5
            else:
                ok = a[5] is None and b[5] is None and max(sim(a[2], b[2]), sim(a[3], b[3])) > bar
            if ok:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("seed", range(2))
def test_clusters_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocab = ["cache", "lock", "leak", "sql", "token", "path", "loop"]
    rows = [
        (rng.choice(["logic", "security", "performance"]), rng.choice(["low", "high"]),
         " ".join(rng.sample(vocab, rng.randint(1, 4))), " ".join(rng.sample(vocab, rng.randint(0, 5))),
         rng.choice(["x.ts", "y.ts", None]), rng.choice([None, *range(1, 200, 7)]))
        for _ in range(160)
    ]
    got = [r["component"] for r in cluster_findings(frame(spark, rows)).orderBy("seq").collect()]
    assert got == brute_clusters(rows)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, i) for i in range(1001, 1200)]
    c = connected_components(spark.createDataFrame(chain + star, "a long, b long"))
    assert {tuple(r) for r in c.groupBy("component").count().collect()} == {(100, 301), (1000, 200)}


def test_golden_component_count(spark):
    f = Fixtures(spark, "/root/testdata/sf0.01").findings.withColumn("project_id", F.lit(0))
    row = cluster_findings(f).groupBy("component").count().agg(F.count("*").alias("n"), F.max("count").alias("m")).first()
    assert (row["n"], row["m"]) == (4657, 20)


def test_conflict_confidence(spark):
    rows = [
        ("security", "high", "validate input", "sanitize and check the token", "x.ts", 10),
        ("performance", "low", "remove the guardless path", "skip and cache it, bypass", "x.ts", 30),
        ("performance", "low", "far away", "none", "x.ts", 200),
        ("security", "low", "same agent", "none", "x.ts", 12),
    ]
    got = correlate.detect_conflicts(frame(spark, rows)).collect()
    assert {(r["seq_a"], r["seq_b"], r["confidence"]) for r in got} == {(0, 1, "high"), (1, 3, "low")}


def compared(spark, head, base):
    h = [(i, 0, "logic", "low", t, "d", "x.ts", l, l, None) for i, (t, l) in enumerate(head)]
    b = [(i, 0, "logic", "low", t, "d", "x.ts", l, l, None) for i, (t, l) in enumerate(base)]
    changed = spark.createDataFrame([(0, "x.ts")], "project_id long, path string")
    d = diffing.compare_findings(spark.createDataFrame(h, COLS), spark.createDataFrame(b, COLS), changed)
    return sorted((r["bucket"], r["seq"]) for r in d.collect())


def test_comparison_pairs_one_to_one(spark):
    got = compared(spark, [("t", 10), ("t", 12), ("u", 5)], [("t", 11), ("u", 40)])
    assert got == [("introduced", 1), ("introduced", 2), ("resolved", 1), ("unchanged", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_comparison_equals_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.choice("tu"), rng.randint(1, 60)) for _ in range(n)]
    head, base = make(50), make(50)
    mh, mb = set(), set()
    for i, f in enumerate(head):
        j = next((j for j, g in enumerate(base) if g == f and j not in mb), None)
        if j is not None:
            mh.add(i), mb.add(j)
    pairs = [(abs(f[1] - g[1]), i, j) for i, f in enumerate(head) if i not in mh for j, g in enumerate(base)
             if j not in mb and f[0] == g[0] and abs(f[1] - g[1]) <= 10]
    for _, i, j in sorted(pairs):
        if i not in mh and j not in mb:
            mh.add(i), mb.add(j)
    want = sorted([("unchanged" if i in mh else "introduced", i) for i in range(50)] + [("resolved", j) for j in range(50) if j not in mb])
    assert compared(spark, head, base) == want


def test_prefixes_of_similar_sets_are_not_gathered(spark):
    """Prefixes of word sets are far more rows than their compressed files tell; their join may not send them to the driver."""
    from corpuslens.operators.clusters import similar_sets

    sets = spark.range(2000).selectExpr("id % 5 AS project_id", "concat('some words ', id) AS ws")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        plan = similar_sets(sets, ["project_id"], "ws", 0.5)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
