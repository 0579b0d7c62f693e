"""Chunking, diffs, retrieval and replies on small texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.text import jaccard
from corpuslens.operators import chunks, diffing, graph, redact, responses, retrieval


def test_jaccard(spark):
    rows = [("SQL injection", "sql-injection in login"), ("!!!", "@@@")]
    d = spark.createDataFrame(rows, "a string, b string").select(jaccard("a", "b").alias("j"))
    assert [r["j"] for r in d.collect()] == [0.5, 0.0]


def brace_bounds(text):
    return chunks._brace_chunks(text)


def test_braces_close_after_five_lines():
    fn = "function a() {\n" + "  x\n" * 6 + "}\n"
    bounds = brace_bounds(fn * 3)
    assert bounds[0] == (0, 8)
    assert bounds[-1][1] == (fn * 3).count("\n") + 1


def test_braces_in_literals_do_not_count():
    text = "function a() {\n" + "  s = '}'\n" * 6 + "  // }\n  /* } */\n  r = /}/\n}\nend"
    assert brace_bounds(text)[0] == (0, 11)


def test_open_literal_runs_on():
    text = "a {\n}\n`open\n" + "x\n" * 20 + "end` b"
    assert brace_bounds(text)[0][1] >= 24


def test_no_braces_uses_long_chunks():
    bounds = brace_bounds("x = 1\n" * 400)
    assert bounds[0] == (0, 150) and bounds[1][0] == 120


def test_chunks_cover_every_line():
    rng = random.Random(3)
    text = "\n".join(rng.choice(["{", "}", "x", "'", "", "/* a", "*/", "f() {"]) for _ in range(900))
    seen = set()
    for s, e in brace_bounds(text):
        seen.update(range(s, e))
    assert seen == set(range(900))


def _chunk(spark, text, prefix=None):
    rows = [(0, 1, "a.ts", 0, "a.ts:1-9", 1, text.count("\n") + 1, text, prefix, -(-len((prefix or "") + text) // 4))]
    return spark.createDataFrame(
        rows, "project_id long, file_seq long, path string, chunk_seq int, chunk_id string, start_line int, end_line int,"
        " content string, context_prefix string, token_count int",
    )


@pytest.mark.parametrize("text", ["x" * 40000, "\n".join(f"line {i} " + "y" * 30 for i in range(900)), "z" * 30000 + "\nshort\n" + "w" * 9000])
def test_pieces_fit_and_cover(spark, text):
    got = chunks.split_to_limit(_chunk(spark, text), 1000).orderBy("piece").collect()
    assert len(got) > 1 and all(r["token_count"] <= 850 for r in got)
    if "line 0" in text:
        lines = set()
        for r in got:
            lines.update(range(r["start_line"], r["end_line"] + 1))
        assert lines == set(range(1, 901))


def test_huge_prefix_is_dropped(spark):
    got = chunks.split_to_limit(_chunk(spark, "a\nb\nc", "p" * 9000), 1000).collect()
    assert all(r["token_count"] <= 850 for r in got)


def test_prefix_only_on_first_window(spark):
    text = "\n".join("q" * 60 for _ in range(500))
    got = chunks.split_windows(_chunk(spark, text, "ctx" * 100), 1200).orderBy("part").collect()
    assert got[0]["context_prefix"] and all(r["context_prefix"] is None for r in got[1:])
    assert got[0]["token_count"] <= 1020 and got[1]["start_line"] == got[0]["end_line"] - 29
    assert got[-1]["end_line"] == 500


DIFF = """diff --git a/a.ts b/a.ts
--- a/a.ts
+++ b/a.ts
@@ -1,3 +1,4 @@
 one
+two
+++three
-four
+five
@@ -20,2 +30,2 @@ f()
 a
--- b
+c
\\ No newline at end of file"""


def test_hunks(spark):
    d = spark.createDataFrame([(0, "a.ts", DIFF)], "project_id long, path string, diff string")
    s = diffing.diff_stats(d).first()
    assert (s["additions"], s["deletions"]) == (4, 2)
    got = diffing.added_ranges(d, ["project_id", "path"]).collect()
    assert sorted((r["range_start"], r["range_end"]) for r in got) == [(2, 3), (4, 4), (31, 31)]


def test_specifiers_resolve(spark):
    files = [
        (0, "src/a.ts", "import x from './b.js'\nimport { y } from './c'\nconst z = require('../lib')\nimport 'react'"),
        (0, "src/b.ts", ""), (0, "src/c/index.ts", ""), (0, "lib/index.js", ""),
    ]
    f = spark.createDataFrame(files, "project_id long, path string, content string")
    got = {(r["importer"], r["importee"]) for r in graph.import_edges(f).collect()}
    assert got == {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c/index.ts"), ("src/a.ts", "lib/index.js")}


def test_no_escape_above_the_root(spark):
    f = spark.createDataFrame([(0, "a.ts", "import '../../b'"), (0, "b.ts", "")], "project_id long, path string, content string")
    assert graph.import_edges(f).count() == 0


WORDS = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golf", "hotel"]


def random_chunks(spark, seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, weights=[50, 30, 10, 5, 3, 1, 1, 1], k=rng.randint(1, 25)))
        name = rng.choice(WORDS[:3]) if rng.random() < 0.3 else f"n{i}"
        rows.append((0, i, f"src/{name}.ts", f"c{i}", "sym" if i % 3 else "alpha", text))
    return rows, spark.createDataFrame(rows, "project_id long, seq long, path string, chunk_id string, symbol_name string, content string")


@pytest.mark.parametrize("seed", range(3))
def test_keyword_search_equals_full_scan(spark, seed):
    rows, df = random_chunks(spark, seed)
    want = {}
    for _, _, _, cid, sym, text in rows:
        terms = set(re.findall(r"\b[a-z]{4,}\b", f"{sym} {text[:200]}"))
        scored = []
        for _, seq, _, other, _, t in rows:
            w = re.findall(r"\b[a-z]{4,}\b", t)
            s = sum(x in terms for x in w) / (len(w) + 1)
            if other != cid and s > 0:
                scored.append((-s, seq, other))
        want[cid] = [o for _, _, o in sorted(scored)[:3]]
    for rare, champions in ((0, 1), (5, 2), (1000, 1)):
        got = {}
        for r in retrieval.keyword_search(df, rare=rare, champions=champions).orderBy("subject", "rank").collect():
            got.setdefault(r["subject"], []).append(r["chunk_id"])
        assert got == {k: v for k, v in want.items() if v}


def test_keyword_search_opens_few_blocks(spark, monkeypatch):
    """One word in every chunk: only its densest postings are met, and the k-th score closes the rest."""
    n = 600
    rows = [(0, i, f"src/n{i}.ts", f"c{i}", "sym", "common " * (1 + i % 7) + " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(i % 11 + 1))) for i in range(n)]
    df = spark.createDataFrame(rows, "project_id long, seq long, path string, chunk_id string, symbol_name string, content string")
    lists, cut = [], retrieval.cut_lineage

    def counted(frame):
        if frame.columns == ["project_id", "subject", "chunk_id", "seq", "score"]:
            lists.append(frame)
        return cut(frame)

    monkeypatch.setattr(retrieval, "cut_lineage", counted)
    got = retrieval.keyword_search(df, rare=10, champions=8).collect()
    words = {r[3]: re.findall(r"\b[a-z]{4,}\b", r[5]) for r in rows}
    for i in range(0, n, 97):
        own = set(words[f"c{i}"])
        score = {c: sum(x in own for x in w) / (len(w) + 1) for c, w in words.items() if c != f"c{i}"}
        best = sorted(score, key=lambda c: (-score[c], int(c[1:])))[:3]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.subject == f"c{i}"] == best
    # the list of the rare words and the first block of eight postings; the word's other 592 are not opened
    assert len(got) == 3 * n and len(lists) == 2


def test_keyword_search_keeps_pairs_in_tasks(spark):
    """Each chunk shares a word with most others: millions of pairs, of which only the best are written or shuffled."""
    rng, n = random.Random(5), 1500
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i % 2, i, f"src/n{i}.ts", f"c{i}", "sym", " ".join(rng.choices(words, k=rng.randint(5, 20)))) for i in range(n)]
    df = spark.createDataFrame(rows, "project_id long, seq long, path string, chunk_id string, symbol_name string, content string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    got = retrieval.keyword_search(df).collect()
    assert shuffled() - before < 3_000_000
    texts = {r[3]: (r[0], r[5].split()) for r in rows}
    for i in range(0, n, 101):
        own, project = set(texts[f"c{i}"][1]), i % 2
        score = {c: sum(x in own for x in w) / (len(w) + 1) for c, (p, w) in texts.items() if c != f"c{i}" and p == project}
        best = sorted(score, key=lambda c: (-score[c], int(c[1:])))[:3]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.subject == f"c{i}"] == best


@pytest.mark.parametrize("seed", range(2))
def test_related_chunks_equal_full_scan(spark, seed):
    rows, df = random_chunks(spark, seed)
    want = {}
    for _, _, path, cid, _, text in rows:
        base = path[4:-3]
        scored = []
        for _, seq, _, other, _, t in rows:
            s = 4 * (base in t) + min(4, len(set(text.split()) & set(t.split())))
            if other != cid and s >= 4:
                scored.append((-s, seq, other))
        want[cid] = [o for _, _, o in sorted(scored)[:4]]
    for common, blocks in ((0, (2, 5)), (3, (8,)), (1000, ())):
        got = {}
        for r in retrieval.related_chunks(df, common=common, blocks=blocks).orderBy("subject", "rank").collect():
            got.setdefault(r["subject"], []).append(r["chunk_id"])
        assert got == {k: v for k, v in want.items() if v}


def test_related_chunks_through_list_heads(spark):
    """One early chunk only, so that most subjects go through heads of 8 places and more; two projects."""
    rows, _ = random_chunks(spark, 7, 90)
    rows = [(i % 3 // 2, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "project_id long, seq long, path string, chunk_id string, symbol_name string, content string")
    want = {}
    for project, _, path, cid, _, text in rows:
        scored = []
        for p, seq, _, other, _, t in rows:
            s = 4 * (path[4:-3] in t) + min(4, len(set(text.split()) & set(t.split())))
            if p == project and other != cid and s >= 4:
                scored.append((-s, seq, other, s))
        want.update({(cid, i + 1): x[2:] for i, x in enumerate(sorted(scored)[:4])})
    got = retrieval.related_chunks(df, common=3, blocks=(1,)).collect()
    assert {(r["subject"], r["rank"]): (r["chunk_id"], r["score"]) for r in got} == want


def test_containing_equals_full_scan(spark):
    """Short, spaced, repeated, blank and NULL needles; long runs; many needles that share grams."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \nc", k=rng.randint(0, 40))) for _ in range(80)] + ["", None, "index1 index22", "x" * 3000 + "needle"]
    needles = ["a", "ab", "abc", "abca", "abcab", "a b", "ca bb", "ab\nc", "", " ", None, "needle", "xneedle", "nowhere", "a", "\u00e9"]
    needles += [f"index{i}" for i in range(300)]
    c = spark.createDataFrame([(i % 2, f"c{i}", t) for i, t in enumerate(texts)], "project_id long, chunk_id string, content string")
    n = spark.createDataFrame([(p, x) for p in (0, 1, 2) for x in needles], "project_id long, needle string")
    want = {(i % 2, x, f"c{i}") for i, t in enumerate(texts) if t for x in needles if x and x.strip() and x in t}
    got = [tuple(r) for r in retrieval.containing(c, n).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert retrieval.containing(c, n.limit(0)).count() == 0 and retrieval.containing(c.limit(0), n).count() == 0


def test_containing_writes_only_runs_that_may_hold_a_name(spark, monkeypatch):
    prose = "the quick brown fox and f7 jumps over lazy dogs of f12"
    c = spark.createDataFrame([(0, f"c{i}", f"{prose} {i}") for i in range(50)], "project_id long, chunk_id string, content string")
    n = spark.createDataFrame([(0, f"f{i}") for i in range(10, 20)], "project_id long, needle string")
    runs, cut = [], retrieval.cut_lineage

    def counted(frame):
        out = cut(frame)
        if out.columns == ["project_id", "chunk_id", "run"]:
            runs.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "cut_lineage", counted)
    got = [tuple(r) for r in retrieval.containing(c, n).collect()]
    assert sorted(got) == sorted((0, "f12", f"c{i}") for i in range(50))
    # only f12 is as long as a name and made of its characters: f, 1 and what follows
    assert len(runs) == 1 and runs[0] <= 50 * 3


def test_synthesis_is_parsed_once(spark):
    good = '{"executiveSummary": "S", "priorityFixes": [{"title": "t", "rationale": "r", "rank": 3, "estimatedHours": " 2.5 h"}, {"title": "no reason"}, 7]}'
    odd = ['{"executiveSummary": 5}', '{"executiveSummary": null}', "[1]", "", None, "no JSON"]
    texts = [good, f"text {good} text", f"```json\n{good}\n```", '{"executiveSummary": "", "priorityFixes": "none"}', *odd]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, content string")
    s = responses.parse_synthesis(d)
    fix = (3.0, "t", "r", 2.5, [])
    got = [(r["seq"], r["summary"], [tuple(f) for f in r["fixes"]], r["observations"], r["best_fix"]) for r in s.collect()]
    assert sorted(got) == [*((i, "S", [fix], [], "") for i in range(3)), (3, "", [], [], "")]
    one = F.col("fixes")[0]
    used = s.select("summary", one["rank"], one["title"], F.size("fixes"), F.size("observations"), "best_fix")
    # the whole text, else its outermost braces; however often the result is used
    assert used._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson(") == 2


def test_snippets_travel_without_the_rest_of_their_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000)) for _ in range(20)]
    rows = [(0, f"c{i}", f"p{i}", 1, 9, None, t) for i, t in enumerate(texts)]
    shape = "project_id long, chunk_id string, path string, start_line int, end_line int, symbol_name string, content string"
    c = spark.createDataFrame(rows, shape)
    related = spark.createDataFrame([(0, f"c{i}", f"c{(i + 1) % 20}", 5, 1) for i in range(20)], "project_id long, subject string, chunk_id string, score int, rank int")
    found = spark.createDataFrame([(0, f"c{i}", f"c{(i + j) % 20}", 0.5, j) for i in range(20) for j in (1, 2)], "project_id long, subject string, chunk_id string, score double, rank int")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = {r["subject"]: r["context"] for r in retrieval.merge_context(retrieval.render_snippets(related, found, c)).collect()}
        assert shuffled() - before < 500_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    more = "\n... (truncated)"
    first = f"// --- p1 (score 5, lines 1-9) ---\n{texts[1][:900]}{more}"
    second = f"// --- p2 (lines 1-9) ---\n{texts[2][:1000]}{more}"
    assert got["c0"] == f"\n\n/* [REPOSITORY CONTEXT] */\n{first}\n\n{second}\n/* [END REPOSITORY CONTEXT] */\n\n" and len(got) == 20


def test_redaction(spark):
    text = "key sk_live-0123456789abcdefXYZ, short abc123, path/with.dots"
    got = redact.redact_text(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert got["t"] == "key sk_l...fXYZ, short abc123, path/with.dots" and got["hits"] == 1


@pytest.mark.parametrize(
    ("reply", "status", "n"),
    [
        ('[{"title":"a","severity":"HIGH ","description":"d"}]', "ok", 1),
        ('text ```js\nx\n``` and ```json\n[{"title":"a","severity":"low","description":"d"}]\n```', "ok", 1),
        ("", "empty", 0),
        ("nothing to see", "no_array", 0),
        ('{"findings": 1}', "no_array", 0),
        ('[{"title":"a","severity":"low","description":"d, ]"},]', "ok", 1),
        ('[{"title":"a","severity":"low","description":"b } c"},{"title":"cut', "ok", 1),
        ("[broken", "unparsable", 0),
        ("[]", "ok", 0),
    ],
)
def test_replies(spark, reply, status, n):
    d = spark.createDataFrame([(1, "logic", 1, "p", "m", reply)], "batch_id long, agent_name string, attempt int, provider string, model string, content string")
    p = responses.parse_findings(d)
    assert p.first()["status"] == status
    assert responses.validate_fields(p).where("reject IS NULL").count() == n


def test_nested_redaction(spark):
    from corpuslens.operators.redact import redact_json, redact_nested

    schema = "o struct<userToken:int, name:string, list:array<struct<Secret:string, n:int>>, deep:array<array<struct<password:string>>>, m:map<string, int>>"
    rows = [((1, "a", [("x", 1), None], [[("p",)], []], {"apiKey": 5, "n": 6}),), ((None, None, None, None, None),), (None,)]
    d = redact_nested(spark.createDataFrame(rows, schema), "o")
    got = [r["o"] and r["o"].asDict(True) for r in d.collect()]
    assert got[0] == {
        "userToken": "[REDACTED]", "name": "a", "list": [{"Secret": "[REDACTED]", "n": 1}, None],
        "deep": [[{"password": "[REDACTED]"}], []], "m": {"apiKey": "[REDACTED]", "n": "6"},
    }
    assert got[1] == {"userToken": "[REDACTED]", "name": None, "list": None, "deep": None, "m": None} and got[2] is None
    texts = [('{"user":{"token":"t","id":3},"calls":[{"key":"k"}]}',), ("{broken",), (None,)]
    j = redact_json(spark.createDataFrame(texts, "j string"), "j", "user struct<token:string, id:int>, calls array<struct<key:string>>")
    got = [r["j"] for r in j.collect()]
    assert got[0] == '{"user":{"token":"[REDACTED]","id":3},"calls":[{"key":"[REDACTED]"}]}'
    assert "broken" not in (got[1] or "") and got[2] is None


def test_postings_lie_on_disk_as_compressed_columns(spark, tmp_path, monkeypatch):
    """What searches write between their steps is far smaller than the text it comes from, let alone its rows."""
    monkeypatch.setattr("corpuslens.session.shared_folder", lambda s: str(tmp_path))
    rows = [(0, i, f"src/n{i}.ts", f"src/n{i}.ts:1-9", " ".join(f"word{chr(97 + (i * j) % 26)}" for j in range(200))) for i in range(300)]
    df = spark.createDataFrame(rows, "project_id long, seq long, path string, chunk_id string, content string")
    index = retrieval.keyword_index(df)
    assert retrieval.cut_lineage(index).count() == index.count()
    assert 0 < sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(len(r[-1]) for r in rows) / 3


def test_keyword_index_searches_each_text_once(spark):
    """No optimisation may carry the search for words into a test of each single word of a text."""
    rows = [(0, 0, "a:1-1", " ".join(f"{w} {w}" for w in ("alpha", "beta", "gone"))), (0, 1, "b:1-1", "no"), (0, 2, "c:1-1", None)]
    index = retrieval.keyword_index(spark.createDataFrame(rows, "project_id long, seq long, chunk_id string, content string"))
    assert index._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1
    assert {tuple(r) for r in index.select("seq", "word", "tf", "n_words").collect()} == {(0, w, 2, 6) for w in ("alpha", "beta", "gone")}


def test_joins_on_stored_tables_do_not_gather_packed_rows(spark, tmp_path, monkeypatch):
    """A few compressed bytes may be very many rows, which no join may collect on the driver."""
    from corpuslens.session import stored

    monkeypatch.setattr("corpuslens.session.shared_folder", lambda s: str(tmp_path))
    other = spark.range(5_000_000)
    for rows, method in ((2_000_000, "SortMergeJoin"), (10, "BroadcastHashJoin")):
        table = stored(spark.range(0, rows, 1, 4).withColumn("n", F.lit(7)), "packed", joined=True)
        d = other.join(table.select("id", F.explode(F.array("n")).alias("n")), "id")
        assert method in d._jdf.queryExecution().sparkPlan().toString() and d.count() == rows


def _first_join(df):
    return re.search(r"\w+Join", df._jdf.queryExecution().sparkPlan().toString())[0]


def test_lists_of_subjects_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "cut_lineage", lambda df: df)
    c = spark.range(50).selectExpr("0L AS project_id", "'c' || id AS chunk_id", "id AS no", "array('some', 'word', 'here') AS terms")
    open_ = c.selectExpr("project_id", "no AS s_no", "terms AS s_terms", "'b' AS base", "4 AS top")
    names = spark.createDataFrame([], "project_id long, base string, chunk_id string")
    own, _ = retrieval._lists(open_, c, names, 4)
    assert _first_join(own) == "SortMergeJoin" and own.count() == 150


def test_snippets_are_not_gathered(spark):
    pairs = spark.range(20).selectExpr("0L AS project_id", "'s' AS subject", "'c' || id AS chunk_id", "CAST(id AS INT) AS rank", "4 AS score")
    c = spark.range(20).selectExpr(
        "0L AS project_id", "'c' || id AS chunk_id", "'a.ts' AS path", "1 AS start_line", "2 AS end_line", "'' AS symbol_name", "'x' AS content"
    )
    d = retrieval.render_snippets(pairs, pairs.where("rank < 5"), c)
    assert _first_join(d) == "SortMergeJoin" and d.count() == 25
