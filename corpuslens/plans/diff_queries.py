"""Queries on diffs, decisions and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import diffing, groundtruth
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query
from corpuslens.sources import decisions as dec

KEYS = ["project_id", "file_seq", "path"]


def ranges(fx: Fixtures) -> DataFrame:
    return diffing.added_ranges(fx.changed_files, KEYS)


@query
def diff_stats(fx: Fixtures) -> DataFrame:
    return diffing.diff_stats(fx.changed_files).select("file_seq", "path", "additions", "deletions")


@query
def added_ranges(fx: Fixtures) -> DataFrame:
    return ranges(fx)


@query
def scope_to_diff(fx: Fixtures) -> DataFrame:
    return diffing.scope_to_diff(fx.head_findings, ranges(fx)).select("seq", "path", "line_start", "line_end")


def compared(fx: Fixtures) -> DataFrame:
    base = fx.base_findings.withColumn("score_penalty", F.col("score_penalty"))
    return diffing.compare_findings(fx.head_findings, base, fx.changed_files)


@query
def compare_findings(fx: Fixtures) -> DataFrame:
    return compared(fx).select("bucket", "seq", "path", "line_start", "title")


@query
def compare_without_base(fx: Fixtures) -> DataFrame:
    d = diffing.compare_findings(fx.head_findings, None, fx.changed_files, ranges(fx))
    return d.select("bucket", "seq", "path", "line_start")


@query
def exact_matches(fx: Fixtures) -> DataFrame:
    """First pass alone: pairs of equal file, line and title start, in order."""
    fp = ["project_id", "path", "at", "t40"]
    tag = lambda d: diffing.rank_in_order(
        d.where("path IS NOT NULL").withColumn("at", F.coalesce("line_start", F.lit(0))).withColumn(
            "t40", F.substring("title", 1, 40)
        ), fp, "seq", "nth",
    ).select(*fp, "nth", "seq")
    h, b = tag(fx.head_findings), tag(fx.base_findings).withColumnRenamed("seq", "base_seq")
    return h.join(b, [*fp, "nth"]).select("seq", "base_seq")


@query
def rank_introduced(fx: Fixtures) -> DataFrame:
    d = diffing.compare_findings(fx.head_findings, None, fx.changed_files)
    return diffing.rank_introduced(d).select("seq", "severity", "severity_rank")


@query
def diff_gate(fx: Fixtures) -> DataFrame:
    return diffing.diff_gate(compared(fx))


@query
def diff_gate_without_base(fx: Fixtures) -> DataFrame:
    return diffing.diff_gate(diffing.compare_findings(fx.head_findings, None, fx.changed_files, ranges(fx)))


@query
def parse_name_status(fx: Fixtures) -> DataFrame:
    n = F.col("file_seq") % 6
    line = F.when(
        n < 2, F.concat(F.lit("R09"), n.cast("string"), F.lit("\told/"), "path", F.lit("\t"), "path")
    ).otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in "AMDT"]), (n - 1).cast("int")), F.lit("\t"), "path"))
    return diffing.parse_name_status(fx.code_meta.select("file_seq", line.alias("value")))


@query
def parse_decisions(fx: Fixtures) -> DataFrame:
    return dec.parse_decisions(fx.decisions)


@query
def decision_drift(fx: Fixtures) -> DataFrame:
    d = dec.parse_decisions(fx.decisions).join(
        fx.code_meta.select((F.col("file_seq") % 150).alias("m"), "project_id").distinct(),
        F.concat(F.lit("src/m"), F.col("m").cast("string"), F.lit(".ts")) == F.col("path"),
    )
    return diffing.decision_drift(d, ranges(fx)).select("slug", "path", "line_start", "line_end")


@query
def drift_by_finding(fx: Fixtures) -> DataFrame:
    """Every located finding as a decided place, so that many places meet many ranges."""
    d = fx.findings.where("line_start IS NOT NULL AND line_end IS NOT NULL").select(
        F.col("seq").alias("slug"), "project_id", "path", "line_start", "line_end"
    )
    return diffing.decision_drift(d, ranges(fx)).select("slug", "path", "line_start", "line_end")


@query
def stale_decisions(fx: Fixtures) -> DataFrame:
    d = dec.parse_decisions(fx.decisions).withColumn("modified_at", F.col("decided_on").cast("timestamp"))
    return dec.stale_decisions(d, F.lit("2024-02-14 12:00:00").cast("timestamp")).select("slug", "age_days")


@query
def retained_decisions(fx: Fixtures) -> DataFrame:
    d = dec.parse_decisions(fx.decisions).select(
        "slug", F.lit(0).alias("project_id"), "path", "line_start", "decision",
        F.col("decided_on").cast("timestamp_ntz").alias("modified_at"),
    )
    return dec.retain(dec.with_slug(d), 100).select("slug", "modified_at")


@query
def match_claims(fx: Fixtures) -> DataFrame:
    m = groundtruth.match_claims(fx.claims, fx.defects)
    return m.select("seq", "agent_name", "defect_id", "category", "outcome")


@query
def score_agents(fx: Fixtures) -> DataFrame:
    return groundtruth.score_agents(groundtruth.match_claims(fx.claims, fx.defects), fx.defects)


@query
def score_overall(fx: Fixtures) -> DataFrame:
    return groundtruth.score_overall(groundtruth.match_claims(fx.claims, fx.defects), fx.defects)
