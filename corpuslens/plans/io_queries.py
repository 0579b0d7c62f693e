"""Queries on sources, sinks and the batch side of the watch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import correlate, history, scoring
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query
from corpuslens.session import shared_folder
from corpuslens.sources import corpus, records, reports
from corpuslens.streaming import watch

SIX_HOURS = 6 * 3600 * 1000


@query
def churn(fx: Fixtures) -> DataFrame:
    """Every event as a log line touching one module, with the blank lines a log has."""
    lines = fx.changes.select(
        F.explode(F.array(F.concat(F.lit("  "), "path"), F.lit(""))).alias("value")
    )
    files = fx.modules.select("path").unionByName(fx.code_meta.select("path"))
    return corpus.with_churn(files, corpus.churn(lines)).select("path", "churn_count")


@query
def parse_history(fx: Fixtures) -> DataFrame:
    """The history table as JSON texts, some with a bad score, breakdown or category."""
    n = F.col("run_id") % 7
    score = F.when(n == 1, F.lit("null")).otherwise(F.col("score").cast("string"))
    cat = lambda s: F.concat(F.lit('{"category":"logic","score":'), s, F.lit(',"findingCount":1,"criticalCount":0,"highCount":0}'))
    breakdown = F.when(n == 2, '{"total":1}').otherwise(
        F.concat(F.lit('{"total":'), F.col("score").cast("string"), F.lit(',"findingCount":3,"crossAgentCount":1,"categories":['),
                 cat(F.lit("50")), F.lit(","), cat(F.when(n == 3, "null").otherwise("60")), F.lit("]}"))
    )
    text = F.when(n == 4, "{broken").otherwise(
        F.concat(F.lit('{"timestamp":"2024-01-01T00:00:00Z","runId":"'), F.col("run_id").cast("string"), F.lit('","score":'),
                 score, F.lit(',"kind":"'), F.coalesce("kind", F.lit("other")), F.lit('","breakdown":'), breakdown, F.lit("}"))
    )
    h = records.parse_history(fx.history.select(F.col("run_id").alias("k"), text.alias("value")))
    return h.where("valid").select("k", "run_id", "score", "delta", "kind", "total", F.size("categories").alias("n_categories"), "finding_count")


def new_folder(fx: Fixtures, name: str) -> str:
    return f"{shared_folder(fx.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def append_history(fx: Fixtures) -> DataFrame:
    """The history appended run by run of three, read back, and cut to what is retained."""
    folder = new_folder(fx, "history")
    for part in range(3):
        records.append_history(fx.history.where(F.col("run_id") % 3 == part), folder)
    kept = history.trim_history(records.read_appended_history(fx.spark, folder), 50)
    return kept.select("project_id", "run_id", "ts", "score", "kind")


@query
def change_stream(fx: Fixtures) -> DataFrame:
    """All events read as a stream, some of ignored folders or with other separators, until none is left."""
    inputs, out = new_folder(fx, "changes"), new_folder(fx, "seen")
    n = F.col("seq") % 5
    path = F.when(n == 0, F.concat(F.lit("node_modules/x/"), "path")).when(n == 1, F.translate("path", "/", "\\")).otherwise(F.col("path"))
    fx.changes.select("seq", F.col("ts").cast("timestamp").alias("ts"), path.alias("path"), "kind").write.parquet(inputs)
    q = (
        watch.change_stream(fx.spark, inputs).writeStream.format("parquet").option("checkpointLocation", new_folder(fx, "position"))
        .trigger(availableNow=True).start(out)
    )
    q.awaitTermination()
    return fx.spark.read.schema(watch.EVENT_SCHEMA).parquet(out).select("seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "path", "kind")


@query
def json_report(fx: Fixtures) -> DataFrame:
    r = reports.json_rows(fx.findings, correlate.correlate_symbols(fx.findings))
    return r.select("project_id", "kind", "seq", F.get_json_object("entry", "$.title").alias("title"),
                    F.get_json_object("entry", "$.lineStart").cast("int").alias("line"))


@query
def json_documents(fx: Fixtures) -> DataFrame:
    d = reports.json_documents(fx.findings, correlate.correlate_symbols(fx.findings))
    doc = F.from_json("document", "bugs array<string>, architecturalIssues array<string>")
    return d.select("project_id", F.size(doc["bugs"]).alias("bugs"), F.size(doc["architecturalIssues"]).alias("issues"))


@query
def markdown_rows(fx: Fixtures) -> DataFrame:
    return reports.markdown_rows(fx.findings)


@query
def markdown_table(fx: Fixtures) -> DataFrame:
    return reports.table_text(fx.findings)


@query
def markdown_report(fx: Fixtures) -> DataFrame:
    """All lines of the report of every project, with symbols as places that several agents flag."""
    f = fx.findings
    first = correlate.symbol_files(f).groupBy("project_id", "symbol_name").agg(F.min("path").alias("path"))
    cross = correlate.correlate_symbols(f).drop("path").withColumn("n_files", F.col("blast_radius")).join(first, ["project_id", "symbol_name"])
    scores = scoring.with_grade(scoring.health_score(f, cross)).withColumn("delta", (F.col("project_id") % 3 - 1).cast("int"))
    calls = f.select("project_id", "agent_name", (F.col("seq") % 90 + 1).alias("duration_ms"))
    timings = calls.groupBy("project_id", "agent_name").agg(F.sum("duration_ms").alias("duration_ms"))
    return reports.report_lines(f, cross, scores, scoring.category_scores(f), timings)


@query
def debounce(fx: Fixtures) -> DataFrame:
    d = watch.debounce(watch.clean_events(fx.changes), SIX_HOURS)
    return d.withColumn("fire_ts", F.col("fire_ts").cast("timestamp_ntz"))


def results(fx: Fixtures) -> DataFrame:
    """One review result per change event: findings, clean, or failed."""
    n = F.col("seq") % 7
    return fx.changes.select(
        "seq", "ts", F.lit(0).cast("long").alias("project_id"), "path",
        F.when(n < 4, n).otherwise(0).alias("n_findings"), (n == 5).alias("errored"),
    )


@query
def latest_findings(fx: Fixtures) -> DataFrame:
    return watch.latest_findings(results(fx)).drop("project_id")


@query
def bound_files(fx: Fixtures) -> DataFrame:
    return watch.bound_files(watch.latest_findings(results(fx)), 30).select("path", "first_seen")


@query
def current_report(fx: Fixtures) -> DataFrame:
    return watch.current_report(fx.findings.where("path IS NOT NULL"))
