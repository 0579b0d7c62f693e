"""Penalties, category and health scores, debt, samples and call statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import (
    CATEGORY_FLOOR,
    COLOUR_BANDS,
    COMPLEXITY_SCALING,
    CROSS_WEIGHTS,
    DOMAINS,
    GRADE_BANDS,
    PENALTY_CAPS,
    QUOTA_PHRASES,
    SEVERITIES,
    SEVERITY_WEIGHTS,
    TOTAL_FLOOR,
)
from corpuslens.functions.text import finite, half_up
from corpuslens.operators.correlate import cross_penalty


def clean_weights(config: dict | None = None) -> dict:
    """Defaults overlaid by ``config``; bad numbers fall back, negatives become zero."""
    config = config or {}

    def overlay(name: str, defaults: dict[str, float]) -> dict[str, float]:
        given = config.get(name) or {}
        merged = {}
        for k in [*defaults, *[x for x in given if x not in defaults]]:
            v = given.get(k, defaults.get(k))
            ok = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
            merged[k] = max(0.0, float(v if ok else defaults.get(k, 0.0)))
        return merged

    scaling = {**COMPLEXITY_SCALING, **(config.get("complexity") or {})}
    for k in ("low_factor", "high_factor"):
        v = scaling[k]
        scaling[k] = max(0.0, float(v if math.isfinite(v) else COMPLEXITY_SCALING[k]))
    if scaling["low_threshold"] >= scaling["high_threshold"]:
        scaling["high_threshold"] = scaling["low_threshold"] + 1
    return {
        "severity": overlay("severity", SEVERITY_WEIGHTS),
        "cross": overlay("cross", CROSS_WEIGHTS),
        "caps": overlay("caps", PENALTY_CAPS),
        "complexity": scaling,
    }


def _lookup(c: str, table: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(F.col(c) == k, F.lit(float(v))).otherwise(out)
    return out


def with_penalty(findings: DataFrame, config: dict | None = None) -> DataFrame:
    """``penalty``: explicit when finite, else by severity; scaled by complexity for maintainability."""
    cfg = clean_weights(config)
    sc = cfg["complexity"]
    base = F.coalesce(finite("score_penalty"), _lookup("severity", cfg["severity"]))
    scaled = (
        F.when(F.col("complexity") < sc["low_threshold"], base * sc["low_factor"])
        .when(F.col("complexity") > sc["high_threshold"], base * sc["high_factor"])
        .otherwise(base)
    )
    return findings.withColumn(
        "penalty", F.when(F.col("agent_name") == "maintainability", scaled).otherwise(base)
    )


def agent_penalties(findings: DataFrame, config: dict | None = None) -> DataFrame:
    return (
        with_penalty(findings, config)
        .groupBy("project_id", F.col("agent_name").alias("category"))
        .agg(
            F.sum("penalty").alias("penalty"),
            F.count("*").alias("finding_count"),
            F.count_if(F.col("severity") == "critical").alias("critical_count"),
            F.count_if(F.col("severity") == "high").alias("high_count"),
        )
    )


def category_scores(
    findings: DataFrame, executed: DataFrame | None = None, config: dict | None = None
) -> DataFrame:
    """Score per (project, category); seeded categories without findings score 100.

    ``executed`` lists ``(project_id, category)`` that ran. Without it every
    built-in domain counts for every project that has a finding.
    """
    cap = clean_weights(config)["caps"]["category"]
    sums = agent_penalties(findings, config)
    if executed is None:
        projects = findings.select("project_id").distinct()
        executed = projects.select("project_id", F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("category"))
    score = F.greatest(F.lit(CATEGORY_FLOOR), half_up(100 - F.least(F.coalesce("penalty", F.lit(0.0)), F.lit(cap))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        executed.distinct()
        .join(sums, ["project_id", "category"], "full")
        .select(
            "project_id",
            "category",
            score.cast("int").alias("score"),
            zero("finding_count"),
            zero("critical_count"),
            zero("high_count"),
            F.coalesce("penalty", F.lit(0.0)).alias("penalty"),
        )
    )


def health_score(
    findings: DataFrame,
    cross: DataFrame,
    executed: DataFrame | None = None,
    projects: DataFrame | None = None,
    config: dict | None = None,
) -> DataFrame:
    """0-100 per project: 60 % mean category score, 40 % what total penalty leaves."""
    cfg = clean_weights(config)
    cats = (
        category_scores(findings, executed, config)
        .groupBy("project_id")
        .agg(
            F.sum("score").alias("score_sum"),
            F.count("*").alias("n_categories"),
            F.sum("penalty").alias("penalty"),
            F.sum("finding_count").alias("finding_count"),
        )
    )
    crossed = cross.groupBy("project_id").agg(
        F.sum(cross_penalty(cfg["cross"])).alias("cross_penalty"), F.count("*").alias("cross_agent_count")
    )
    base = cats.join(crossed, "project_id", "full")
    if projects is not None:
        base = projects.select("project_id").distinct().join(base, "project_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.round(zero("penalty") + zero("cross_penalty"), 6)
    mean = F.coalesce(F.col("score_sum") / F.col("n_categories"), F.lit(100.0))
    left = F.greatest(F.lit(TOTAL_FLOOR), half_up(100 - F.least(total, F.lit(cfg["caps"]["total"]))))
    score = F.least(F.lit(100), half_up(mean * 0.6 + left * 0.4)).cast("int")
    return base.select(
        "project_id",
        score.alias("score"),
        zero("n_categories").cast("long").alias("n_categories"),
        zero("finding_count").cast("long").alias("finding_count"),
        zero("cross_agent_count").cast("long").alias("cross_agent_count"),
        total.alias("total_penalty"),
    )


def _bands(c: Column, bands: list, low: str) -> Column:
    out = F.lit(low)
    for bound, name in reversed(bands):
        out = F.when(c >= bound, F.lit(name)).otherwise(out)
    return out


def with_grade(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.withColumn("grade", _bands(s, GRADE_BANDS, "F")).withColumn(
        "colour", _bands(F.least(F.greatest(s, F.lit(0)), F.lit(100)), COLOUR_BANDS, "red")
    )


def executed_categories(batches: DataFrame, findings: DataFrame) -> DataFrame:
    """Categories that ran; an agent failed when a batch errored and it has no finding at all."""
    ran = batches.groupBy("project_id", "agent_name").agg(F.bool_or("errored").alias("errored"))
    found = findings.groupBy("project_id", "agent_name").agg(F.count("*").alias("n"))
    return (
        ran.join(found, ["project_id", "agent_name"], "left")
        .select(
            "project_id",
            F.col("agent_name").alias("category"),
            (F.col("errored") & F.col("n").isNull()).alias("failed"),
        )
    )


def debt_estimate(findings: DataFrame, measure: str = "count") -> DataFrame:
    """Per severity below info: number of findings, or summed ``estimated_hours`` / ``hours_wasted``."""
    value = F.lit(1).cast("long") if measure == "count" else F.coalesce(finite(measure), F.lit(0.0))
    zero = F.lit(0).cast("long") if measure == "count" else F.lit(0.0)
    tiers = SEVERITIES[:4]
    out = findings.groupBy("project_id").agg(
        *[F.sum(F.when(F.col("severity") == s, value).otherwise(zero)).alias(s) for s in tiers]
    )
    return out.withColumn("total", sum((F.col(s) for s in tiers[1:]), F.col(tiers[0])))


def sample_findings(findings: DataFrame, cap: int = 50, config: dict | None = None) -> DataFrame:
    """The ``cap`` findings shown per project: each file's worst first, then by penalty.

    Only ``cap + 1`` rows per file can matter, and both rankings are top-k
    filters that Spark applies before shuffling.
    """
    cfg = clean_weights(config)
    p = findings.withColumn("penalty", F.coalesce(finite("score_penalty"), _lookup("severity", cfg["severity"])))
    p = p.withColumn("unit", F.coalesce("path", F.concat(F.lit("#"), F.col("seq").cast("string"))))
    in_file = Window.partitionBy("project_id", "unit").orderBy(F.desc("penalty"), "seq")
    p = p.withColumn("file_rank", F.row_number().over(in_file)).where(F.col("file_rank") <= cap + 1)
    overall = Window.partitionBy("project_id").orderBy(F.col("file_rank") > 1, F.desc("penalty"), "seq")
    return p.withColumn("pick", F.row_number().over(overall)).where(F.col("pick") <= cap).drop("unit")


def omitted_counts(findings: DataFrame, cap: int = 50) -> DataFrame:
    """How many findings per agent the sample leaves out."""
    shown = sample_findings(findings, cap).groupBy("project_id", "agent_name").agg(F.count("*").alias("shown"))
    return (
        findings.groupBy("project_id", "agent_name")
        .agg(F.count("*").alias("n"))
        .join(shown, ["project_id", "agent_name"], "left")
        .select("project_id", "agent_name", (F.col("n") - F.coalesce("shown", F.lit(0))).alias("omitted"))
        .where("omitted > 0")
    )


def agent_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", "agent_name").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )


def agent_timings(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Total duration per group, its rank and its share of the longest.

    The windows run over the few group totals, not over the calls.
    """
    total = calls.groupBy(*keys).agg(F.round(F.sum("duration_ms"), 3).alias("duration_ms"))
    rest = keys[:-1]
    w = Window.partitionBy(*rest) if rest else Window.partitionBy(F.lit(0))
    return total.withColumn("rank", F.row_number().over(w.orderBy(F.desc("duration_ms"), keys[-1]))).withColumn(
        "share", F.round(F.col("duration_ms") / F.max("duration_ms").over(w), 6)
    )


def fallback_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("role").agg(
        F.count("*").alias("total"), F.count_if("used_fallback").alias("fallbacks")
    )


def error_class(status: Column, body: Column) -> Column:
    """``auth`` for 401/403, ``quota`` when the body names an exhausted quota, else ``retryable``."""
    phrases = "|".join(p.replace("-", "\\-") for p in QUOTA_PHRASES)
    return (
        F.when(status.isin(401, 403), "auth")
        .when(F.lower(body).rlike(phrases), "quota")
        .otherwise("retryable")
    )


def classify_errors(errors: DataFrame) -> DataFrame:
    return (
        errors.withColumn("error_class", error_class(F.col("status"), F.col("body")))
        .groupBy("provider", "error_class")
        .agg(F.count("*").alias("n"))
    )


def providers_used(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct providers per group; more than one means a degraded run."""
    return (
        calls.where("provider IS NOT NULL")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("provider")).alias("p"))
        .select(*keys, F.array_join("p", ",").alias("providers"), (F.size("p") > 1).alias("degraded"))
    )
