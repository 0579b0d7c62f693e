"""Streams equal their batch form; sources and sinks round-trip."""

import datetime
import json

from pyspark.sql import functions as F

from corpuslens.operators import groundtruth
from corpuslens.plans.fixtures import Fixtures
from corpuslens.sources import corpus, decisions, records, reports
from corpuslens.streaming import watch

SF = "/root/testdata/sf0.001"
GAP = 6 * 3600 * 1000


def test_stream_debounce_equals_batch(spark, tmp_path):
    events = Fixtures(spark, SF).changes.withColumn("ts", F.col("ts").cast("timestamp"))
    (events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in")))
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    end = spark.createDataFrame([(10**9, last, "zz/flush.ts", "change")], "seq long, ts timestamp, path string, kind string")
    end = end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.change_stream(spark, str(tmp_path / "in"), delay="35 days")
    fires = watch.debounce_stream(stream, GAP)
    q = (
        fires.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    q.awaitTermination(240)
    got = {(r["path"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["path"], r["seq"]) for r in watch.debounce(events, GAP).where(F.col("fire_ts") < F.lit(last)).collect()}
    assert want <= got
    every = {(r["path"], r["seq"]) for r in watch.debounce(events, GAP).collect()}
    assert {g for g in got if g[0] != "zz/flush.ts"} <= every


def test_review_stream_runs_batch_code(spark, tmp_path):
    Fixtures(spark, SF).changes.limit(50).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = watch.change_stream(spark, str(tmp_path / "in"))
    q = watch.review_stream(stream, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() > 0


def test_read_corpus(spark, tmp_path):
    (tmp_path / "r" / "src").mkdir(parents=True)
    (tmp_path / "r" / "src" / "a.ts").write_text("one\ntwo")
    (tmp_path / "r" / "b.py").write_text("x")
    got = {r["path"]: r["lines_of_code"] for r in corpus.read_corpus(spark, str(tmp_path / "r")).collect()}
    assert got == {"src/a.ts": 2, "b.py": 1}


def test_claims_and_scores(spark, tmp_path):
    claims = [{"file": "src/a.ts", "lineStart": 12, "claim": "x"}, {"file": "a.ts", "lineStart": 50, "claim": "y"}]
    (tmp_path / "one.json").write_text(json.dumps(claims))
    c = records.read_claims(spark, str(tmp_path))
    d = spark.createDataFrame(
        [(0, "D1", "src/a.ts", 10, "real-bug"), (1, "D2", "src/a.ts", 14, "fixed-bug"), (2, "D3", "src/a.ts", 55, "false-positive")],
        "seq long, id string, file string, line_start int, category string",
    )
    m = groundtruth.match_claims(c, d)
    assert {(r["line_start"], r["defect_id"]) for r in m.collect()} == {(12, "D1"), (50, "D3")}
    s = groundtruth.score_agents(m, d).first()
    assert (s["agent_name"], s["tp"], s["fp"], s["precision"], s["recall"]) == ("one", 1, 1, 0.5, 1.0)


def test_history_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00Z", "runId": "r", "score": 80, "kind": "full",
            "breakdown": {"total": 80, "categories": [], "findingCount": 0, "crossAgentCount": 0}}
    (tmp_path / "h.json").write_text(json.dumps(good) + "\n{oops\n" + json.dumps({**good, "score": None}))
    h = records.read_history(spark, str(tmp_path / "h.json"))
    assert [r["valid"] for r in h.collect()].count(True) == 1


def test_sinks(spark, tmp_path):
    f = Fixtures(spark, SF).findings.limit(200)
    from corpuslens.operators.correlate import correlate_symbols

    reports.write_markdown_report(f, str(tmp_path / "md"))
    lines = spark.read.text(str(tmp_path / "md"))
    assert lines.count() == 200 + 2 * f.select("project_id").distinct().count()
    reports.write_json_report(f, correlate_symbols(f), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).where("kind = 'bug'").count() == 200
    watch.write_current_findings(f, str(tmp_path / "now"))
    assert spark.read.parquet(str(tmp_path / "now")).count() == f.where("path IS NOT NULL").count()


def test_decision_retention(spark, tmp_path):
    rows = [(0, f"s{i}", "a.ts", i, i, "d", f"2024-01-{i + 1:02d}") for i in range(9)]
    schema = "project_id long, slug string, path string, line_start int, line_end int, decision string, day string"
    old = spark.createDataFrame(rows, schema).withColumn("modified_at", F.col("day").cast("timestamp")).drop("day")
    new = spark.createDataFrame([(0, "x", "b.ts", 1, 2, "z", "2024-02-01")], schema).withColumn("modified_at", F.col("day").cast("timestamp")).drop("day", "slug")
    decisions.append_decisions(old, new, str(tmp_path / "adr"), 4)
    got = [r["slug"] for r in spark.read.parquet(str(tmp_path / "adr")).orderBy("modified_at").collect()]
    assert len(got) == 4 and got[:3] == ["s6", "s7", "s8"] and got[3].startswith("b-")


def test_stream_of_latest_findings_equals_the_batch(spark, tmp_path):
    import random

    rng = random.Random(3)
    schema = "seq long, ts timestamp, project_id long, path string, n_findings long, errored boolean"
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(120):
        n = rng.choice([0, 0, 1, 2])
        rows.append((i, start + datetime.timedelta(seconds=i), i % 2, f"f{rng.randrange(9)}", n, n == 0 and rng.random() < 0.4))
    folder = tmp_path / "in"
    for b in range(4):
        part = rows[30 * b : 30 * b + 30]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = {}

    def keep(df, batch_id):
        for r in df.collect():
            seen[(r["project_id"], r["path"])] = r

    q = watch.latest_stream(stream).writeStream.outputMode("update").foreachBatch(keep)
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    want = watch.latest_findings(spark.createDataFrame(rows, schema)).collect()
    fields = ("n_findings", "seq", "first_seen", "first_seq")
    assert {k: tuple(r[f] for f in fields) for k, r in seen.items() if r["n_findings"]} == {
        (r["project_id"], r["path"]): tuple(r[f] for f in fields) for r in want
    }


def test_whole_report(spark, tmp_path):
    findings = spark.createDataFrame(
        [(3, 1, "logic", "low", "t|1", "d", "b.ts", 4, 9), (1, 1, "style", "critical", "t2", "d" * 99, None, None, None)],
        "seq long, project_id long, agent_name string, severity string, title string, description string, path string, line_start int, line_end int",
    )
    cross = spark.createDataFrame(
        [(1, "high", "both", "logic,style", "a.ts,b.ts", 2, 1)],
        "project_id long, severity string, title string, agents string, path string, blast_radius long, first_seq long",
    )
    scores = spark.createDataFrame(
        [(1, 52, "D", 2, 1, -3), (2, 100, "A+", 0, 0, None)],
        "project_id long, score int, grade string, finding_count long, cross_agent_count long, delta int",
    )
    categories = spark.createDataFrame([(1, "deadCode", 50, 0), (1, "own", 7, 2)], "project_id long, category string, score int, finding_count long")
    timings = spark.createDataFrame([(1, "logic", 5), (1, "style", 40), (9, "logic", 1)], "project_id long, agent_name string, duration_ms long")
    reports.write_report(reports.report_lines(findings, cross, scores, categories, timings), str(tmp_path / "md"))
    texts = spark.read.text(str(tmp_path / "md"))
    lines = reports.report_lines(findings, cross, scores, categories, timings).orderBy("project_id", "section", "rank", "path", "seq").collect()
    one, two = ([r["row"] for r in lines if r["project_id"] == p] for p in (1, 2))
    assert len(one) + len(two) == len(lines) == texts.count()  # project 9 has no score, so no report
    assert one[:6] == ["## Score: 52/100 (D) ↓ -3", "", "```", "█" * 10 + "░" * 10, "```", ""]
    for row in (
        "| Dead Code | 50 | ████░░░░ | 0 |", "| Own | 7 | █░░░░░░░ | 2 |", "| 1 | 0 | 0 | 1 | 0 | 2 |",
        "| 🟠 high | both | logic, style | a.ts (+1) | 2 |", "| style | 1 | 1 | 0 |", "| 🔵 low | b.ts:4-9 | logic | t\\|1 | d |",
        "| 🔴 critical | N/A | style | t2 | " + "d" * 36 + "… |",
    ):
        assert row in one, row
    assert one.index("| style | 40 |") < one.index("| logic | 5 |") and one.index("| style | 1 | 1 | 0 |") < one.index("| logic | 1 | 0 | 0 |")
    assert two[0] == "## Score: 100/100 (A+) → No change" and "*No cross-agent findings.*" in two and "*No individual findings.*" in two
    assert "| 0 | 0 | 0 | 0 | 0 | 0 |" in two
