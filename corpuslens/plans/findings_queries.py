"""Queries on findings: validation, merging, correlation, scoring, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import correlate, findings, history, scoring
from corpuslens.operators.clusters import cluster_findings, similar_sets
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query


@query
def norm_paths(fx: Fixtures) -> DataFrame:
    raw = fx.findings_raw
    messy = F.concat(F.lit("../x/./"), "path_raw", F.when(F.col("seq") % 3 == 0, "\\..\\b.ts").otherwise(""))
    return raw.select(
        "seq",
        tx.norm_path("path_raw").alias("path"),
        tx.path_key("path_raw").alias("key"),
        tx.norm_path(messy).alias("messy"),
    )


@query
def validate_findings(fx: Fixtures) -> DataFrame:
    v = findings.validate_findings(fx.findings_raw, fx.finding_chunks)
    return v.select("seq", "status", "path", "line_start", "line_end")


@query
def finding_fingerprints(fx: Fixtures) -> DataFrame:
    f = fx.findings
    tags = F.array(F.concat(F.lit("t"), (F.col("seq") % 3).cast("string")), "agent_name", "agent_name")
    return findings.with_fingerprint(f, tags).select("seq", "fingerprint")


@query
def annotate_complexity(fx: Fixtures) -> DataFrame:
    node = F.struct(
        F.col("start_line").alias("start_line"),
        (F.col("start_line") + 40).cast("int").alias("end_line"),
        (F.col("chunk_seq") + 3).cast("int").alias("complexity"),
    )
    chunks = fx.finding_chunks.withColumn("complexity", (F.col("chunk_seq") * 10 + 7).cast("int")).withColumn(
        "node_complexities", F.array(node)
    )
    return findings.annotate_complexity(fx.findings, chunks).select("seq", "complexity")


@query
def title_similarity(fx: Fixtures) -> DataFrame:
    """Similar titles inside a project, from the word-set join."""
    sets = fx.findings.select("project_id", F.array_join(tx.word_set("title"), " ").alias("ws")).where("ws <> ''")
    pairs = similar_sets(sets.distinct(), ["project_id"], "ws", 0.5)
    return pairs.select("project_id", "a", "b", F.round("sim", 6).alias("sim"))


@query
def cluster_members(fx: Fixtures) -> DataFrame:
    return cluster_findings(fx.findings).select("seq", "component")


@query
def merge_findings(fx: Fixtures) -> DataFrame:
    m = findings.merge_findings(fx.findings)
    return m.select(
        "component", "seq", "project_id", "agent_name", "severity", "title", "description", "path", "line_start",
        "line_end", F.when(F.isnan("score_penalty"), F.lit(-1.0)).otherwise(F.col("score_penalty")).alias("score_penalty"),
        F.array_join("merged_from", ",").alias("merged_from"), "n_merged",
    )


@query
def merged_description_parts(fx: Fixtures) -> DataFrame:
    """Whole merged texts as parts, numbered in reading order."""
    parts = findings.description_parts(cluster_findings(fx.findings))
    order = Window.partitionBy("component").orderBy("part")
    return parts.select("component", F.row_number().over(order).alias("no"), "text")


@query
def severity_counts(fx: Fixtures) -> DataFrame:
    return findings.by_severity(fx.findings)


@query
def correlate_lines(fx: Fixtures) -> DataFrame:
    return correlate.correlate_lines(fx.findings)


@query
def correlate_files(fx: Fixtures) -> DataFrame:
    return correlate.correlate_files(fx.findings)


@query
def correlate_symbols(fx: Fixtures) -> DataFrame:
    return correlate.correlate_symbols(fx.findings)


@query
def symbol_files(fx: Fixtures) -> DataFrame:
    return correlate.symbol_files(fx.findings)


@query
def dedupe_correlations(fx: Fixtures) -> DataFrame:
    return correlate.cross_findings(fx.findings)


@query
def valence(fx: Fixtures) -> DataFrame:
    return correlate.with_valence(fx.findings).select("seq", "sign", "margin")


@query
def detect_conflicts(fx: Fixtures) -> DataFrame:
    return correlate.detect_conflicts(findings.merge_findings(fx.findings))


@query
def inject_verdicts(fx: Fixtures) -> DataFrame:
    """Conflicts of the raw findings table with a derived reply for some pairs."""
    f = fx.findings
    conflicts = correlate.detect_conflicts(f)
    pick = (F.col("seq_a") + F.col("seq_b")) % 7
    verdicts = conflicts.select(
        "seq_a",
        "seq_b",
        (pick < 3).alias("is_conflict"),
        F.concat(F.lit("keep "), F.col("seq_a").cast("string")).alias("decision"),
        F.lit("slower").alias("tradeoff"),
        F.when(pick == 1, F.lit("adr-1")).alias("slug"),
    )
    return correlate.inject_verdicts(f, conflicts, verdicts).drop("score_penalty")


@query
def finding_penalties(fx: Fixtures) -> DataFrame:
    return scoring.with_penalty(fx.findings).select("seq", "penalty")


@query
def configured_penalties(fx: Fixtures) -> DataFrame:
    """Weights from a bad configuration: negative and non-finite values are cleaned first."""
    cfg = {
        "severity": {"critical": -3, "high": float("nan"), "medium": 4},
        "caps": {"category": float("inf"), "total": 60},
        "complexity": {"low_threshold": 30, "high_threshold": 10, "low_factor": -1.0},
    }
    return scoring.category_scores(fx.findings, config=cfg)


@query
def category_scores(fx: Fixtures) -> DataFrame:
    return scoring.category_scores(fx.findings)


@query
def cross_penalties(fx: Fixtures) -> DataFrame:
    s = correlate.correlate_symbols(fx.findings)
    return s.groupBy("project_id").agg(F.round(F.sum(correlate.cross_penalty()), 6).alias("cross_penalty"))


@query
def health_score(fx: Fixtures) -> DataFrame:
    """Health of each project from raw findings: merge, correlate, score, grade."""
    f = fx.findings
    failed = scoring.executed_categories(_batches(fx), f)
    scores = scoring.health_score(
        findings.merge_findings(f), correlate.cross_findings(f), failed.where("NOT failed").drop("failed")
    )
    return scoring.with_grade(scores)


def _batches(fx: Fixtures) -> DataFrame:
    b = fx.agent_batches
    broken = b.select("project_id").distinct().select(
        "project_id", F.lit("deadCode").alias("agent_name"), F.lit(0).cast("long").alias("batch_no"),
        F.lit(True).alias("errored"),
    )
    return b.unionByName(broken)


@query
def executed_categories(fx: Fixtures) -> DataFrame:
    return scoring.executed_categories(_batches(fx), fx.findings)


@query
def grades(fx: Fixtures) -> DataFrame:
    return scoring.with_grade(fx.history.select("run_id", "score"))


@query
def debt_counts(fx: Fixtures) -> DataFrame:
    return scoring.debt_estimate(fx.findings)


@query
def debt_hours(fx: Fixtures) -> DataFrame:
    return scoring.debt_estimate(fx.findings, "estimated_hours")


@query
def wasted_hours(fx: Fixtures) -> DataFrame:
    return scoring.debt_estimate(fx.findings, "hours_wasted")


@query
def sample_findings(fx: Fixtures) -> DataFrame:
    return scoring.sample_findings(fx.findings).select("project_id", "seq", "penalty", "pick")


@query
def omitted_counts(fx: Fixtures) -> DataFrame:
    return scoring.omitted_counts(fx.findings)


@query
def agent_summary(fx: Fixtures) -> DataFrame:
    return scoring.agent_summary(fx.findings)


@query
def agent_timings(fx: Fixtures) -> DataFrame:
    return scoring.agent_timings(fx.call_log, ["role", "provider"])


@query
def fallback_stats(fx: Fixtures) -> DataFrame:
    return scoring.fallback_stats(fx.call_log)


@query
def error_classes(fx: Fixtures) -> DataFrame:
    """Call log with a derived status and body per call."""
    s = F.col("seq") % 11
    body = (
        F.when(s == 3, '{"error":{"type":"insufficient_quota"}}')
        .when(s == 4, "Daily limit reached")
        .when(s == 5, '{"error":{"type":"rate_limit","message":"Monthly limit"}}')
        .otherwise("slow down")
    )
    log = fx.call_log.withColumn("status", F.when(s == 0, 401).when(s == 1, 403).otherwise(429)).withColumn(
        "body", body
    )
    return scoring.classify_errors(log)


@query
def providers_used(fx: Fixtures) -> DataFrame:
    return scoring.providers_used(fx.call_log.withColumn("shift", F.col("seq") % 3), ["role", "shift"])


@query
def trim_history(fx: Fixtures) -> DataFrame:
    return history.trim_history(fx.history, 50)


@query
def history_delta(fx: Fixtures) -> DataFrame:
    return history.with_delta(fx.history).select("project_id", "run_id", "score", "previous_score", "delta")


@query
def trend_levels(fx: Fixtures) -> DataFrame:
    return history.trend_levels(fx.history)


@query
def recent_scores(fx: Fixtures) -> DataFrame:
    return history.recent_scores(fx.history)


@query
def score_as_of(fx: Fixtures) -> DataFrame:
    """Base score at every diff run, one hour before it was taken."""
    cuts = fx.history.where("kind = 'diff'").select(
        "project_id", F.col("run_id").alias("cut_id"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("cut_ts")
    )
    return history.score_as_of(fx.history, cuts)
