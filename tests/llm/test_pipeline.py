"""The pipeline's stages, each on its own input, and its whole run."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_only_drop_rows(spark, docs):
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert 0 < len(rows) < len(before) or name == "lines"
        assert len({r.doc_id for r in rows}) == len(rows)
        if name != "lines":
            assert all(r == before[r.doc_id] for r in rows)


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "decontamination"])
def test_no_column_of_the_table_is_replaced(spark, docs, name):
    clashing = ["score", "Predicted", "held_out", "n_lines", "n_chunks", "removed_lines", "removed_chunks", "_copy", "_id", "row_key", "rank", "_column_0", "places"]
    wide = docs.limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clashing})
    out = STAGES[name](spark, wide, SF)
    assert out.columns == wide.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clashing)


def test_a_repeated_id_teaches_once(spark):
    rows = [(1, f"bad {k}") for k in range(400)] + [(i, "fine good words here") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 40)], "doc_id long, quality int")
    from corpuslens.llm import quality_classifier

    out = quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(out) == 438 and all(0 <= r.score <= 1 for r in out)


def test_rejected_documents_go(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in STAGES["quality"](spark, docs, SF).collect()}
    bad = [i for i, q in labels.items() if q == 0]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in bad) <= 0.1 * len(bad) and sum(i in kept for i in good) >= 0.95 * len(good)


def test_one_document_of_a_group_stays(spark, docs):
    rows = docs.where("n_chars > 400").limit(5).collect()
    more = [(10_000 + r.doc_id, r.text + " and a few more", r.lang, r.source, r.n_chars) for r in rows]
    more += [(None, rows[0].text, "en", "s", 1), (None, rows[0].text, "en", "s", 1), (20_000, None, None, None, None), (20_001, "", None, None, 0), (20_000, None, None, None, None)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    kept = collections.Counter(r.doc_id for r in STAGES["near_duplicates"](spark, both, SF).collect())
    assert not any(10_000 + r.doc_id in kept for r in rows)
    assert kept[20_000] == kept[20_001] == 1 and kept[None] == 1 and max(kept.values()) == 1


def test_contaminated_documents_go(spark, docs):
    def norm(t):
        return " ".join(re.findall(r"\w+", t.lower()))

    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in STAGES["decontamination"](spark, docs, SF).collect()}
    held = {r.doc_id for r in docs.collect() if any(f" {x} " in f" {norm(r.text)} " for x in items)}
    assert held and not held & kept and len(kept) > 0.9 * (docs.count() - len(held))


def test_emptied_documents_go(spark, docs):
    text = "\n".join(f"line {k}" for k in range(20))
    rows = [(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, text + "\nown tail\nand more", "en", "s", 7), (4, None, None, None, None), (5, "", "en", "s", 0)]
    out = {r.doc_id: r for r in STAGES["lines"](spark, spark.createDataFrame(rows, docs.schema), SF).collect()}
    assert set(out) == {1, 3, 4, 5} and out[1].text == text and out[4].text is None
    assert len(out[3].text) == out[3].n_chars < len(rows[2][1])


def passages_by_brute_force(rows):
    """Lines left once every passage of two filled lines or more and over 50 words that stands whole at an earlier place has gone."""
    first, gone = {}, {}
    for i, t in rows:
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone[i] = set()
        for a in range(len(full)):
            for b in range(a + 1, len(full)):
                stretch = lines[full[a] : full[b] + 1]
                if sum(len(x.split()) for x in stretch) > 50:
                    if first.setdefault(tuple(stretch), (i, full[a])) != (i, full[a]):
                        gone[i].update(range(full[a], full[b] + 1))
    return {i: [x for k, x in enumerate(t.split("\n")) if k not in gone[i]] for i, t in rows}


def lines_left(spark, docs, rows):
    out = STAGES["lines"](spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema), SF).collect()
    return {r.doc_id: r.text.split("\n") for r in out}


def test_text_that_is_repeated_nowhere_stays(spark, docs):
    lines = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(6)]
    rows = [(k, "\n".join([f"own {k}", lines[k], lines[k + 1], f"more {k}"])) for k in range(5)] + [(9, "\n".join(lines))]
    assert lines_left(spark, docs, rows) == passages_by_brute_force(rows) == {i: t.split("\n") for i, t in rows}


def test_any_long_passage_goes(spark, docs):
    r = random.Random(6)
    pool = [" ".join(f"l{k}w{i}" for i in range(r.choice([1, 3, 9, 26, 60]))) for k in range(40)] + ["", " "]
    rows = []
    for i in range(90):
        text = [r.choice(pool) for _ in range(r.randrange(3))]
        for _ in range(r.randrange(4)):
            at, n = r.randrange(36), r.randrange(1, 5)
            text += pool[at : at + n] + [f"own {i} {r.random()}"]
        rows.append((i, "\n".join([*text, f"end {i}"])))
    want, got = passages_by_brute_force(rows), lines_left(spark, docs, rows)
    plain = {x.doc_id: x.text.split("\n") for x in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(map(len, want.values())) < sum(len(t.split("\n")) for _, t in rows) - 30
    for i, t in rows:
        # what no passage holds may still go with a chunk, and nothing else may
        assert not collections.Counter(got[i]) - collections.Counter(want[i])
        if plain[i] == t.split("\n"):
            assert got[i] == want[i]


def test_whole_passages_go_from_any_context(spark, docs):
    r = random.Random(4)
    passages = [[" ".join(f"w{r.randrange(10**6)}" for _ in range(55 // n + 1)) for _ in range(n)] for n in range(2, 11) for _ in range(6)]
    rows = [
        (3 * i + k, "\n".join([*(f"own {i} {k} {x}" for x in range(r.randrange(4))), *p, *(f"more {i} {k} {x}" for x in range(r.randrange(1, 4)))]))
        for i, p in enumerate(passages) for k in range(3)
    ]
    rows += [(1000, "\n".join([*passages[0], "between", *passages[20], *passages[50][1:]])), (1001, "\n".join([*passages[30], "x", *passages[30]]))]
    out = {x.doc_id: x.text.split("\n") for x in STAGES["lines"](spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema), SF).collect()}
    want = passages_by_brute_force(rows)
    planted = {x for p in passages for x in p}
    assert all(not planted & set(out.get(i, [])) for i, _ in rows if i >= 1000 or i % 3)
    assert all(out.get(i, []) == want[i] for i, _ in rows)


def test_blank_lines_around_a_passage(spark, docs):
    passage = "\n".join(" ".join(f"p{i}x{k}" for k in range(40)) for i in range(2))
    rows = [(1, passage), (2, f"\n{passage}\n\n"), (3, f"a\n\n{passage}\n\nb"), (None, passage)]
    out = {x.doc_id: x.text for x in STAGES["lines"](spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema), SF).collect()}
    assert out == {1: passage, 3: "a\n\n\nb"}


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF)
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert per and all(r.first == 0 and r.n == r.end <= 2048 for r in per)
    assert queries.QUERIES.keys() == {f"op{n}_{name}" for n, name in enumerate(
        ["benchmark_decontamination", "inverted_multi_index", "personal_data", "host_reputation", "language_id", "line_dedup", "suffix_array_dedup", "quality_classifier", "best_fit_packing", "minhash_near_dedup", "ranked_search", "vector_approximation", "hard_negatives"], 1)}
