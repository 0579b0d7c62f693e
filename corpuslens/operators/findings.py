"""Findings: validation, fingerprints, merging, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.constants import SEVERITIES
from corpuslens.functions.text import half_up, let, norm_path, path_key, severity_rank
from corpuslens.operators.clusters import cluster_findings
from corpuslens.session import cut_lineage

MORE = "\n\nAdditional context: "


def chunk_index(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file with its chunk ranges in order.

    Only ranges are gathered, never text, and a file keeps at most the
    per-file chunk cap, so a row stays small however large the corpus is.
    """
    extra = [c for c in ("symbol_name", "complexity", "node_complexities") if c in chunks.columns]
    span = F.struct("chunk_seq", "start_line", "end_line", *extra)
    return (
        chunks.withColumn("k", path_key("path"))
        .groupBy(*keys, "k")
        .agg(F.array_sort(F.collect_list(span)).alias("spans"))
    )


def validate_findings(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Check every finding against the reviewed chunks.

    Adds ``status``: ``ok``, ``unknown_path`` or ``outside_chunks``; rejected rows
    stay visible. Lines are rounded half up; the end is clamped into the first
    chunk that holds the whole range, else the first that holds its start.
    """
    keys = ["project_id"] if "project_id" in chunks.columns else []
    start, end = half_up("line_start_raw").cast("int"), half_up("line_end_raw").cast("int")
    has_path = F.coalesce("path_raw", F.lit("")) != ""
    f = (
        findings.withColumn("k", F.when(has_path, path_key("path_raw")))
        .withColumn("s", start)
        .withColumn("e", end)
        .join(chunk_index(chunks, keys), [*keys, "k"], "left")
    )
    holds = F.filter(
        "spans", lambda c: F.col("s").isNull() | ((c["start_line"] <= F.col("s")) & (c["end_line"] >= F.col("s")))
    )
    whole = lambda c: F.col("s").isNull() | F.col("e").isNull() | (c["end_line"] >= F.col("e"))
    first = lambda spans: F.get(spans, F.lit(0))
    f = f.withColumn("hit", let(holds, lambda h: F.coalesce(first(F.filter(h, whole)), first(h))))
    symbol = F.nullif("symbol_name", F.lit(""))
    if "symbol_name" in chunks.columns:
        symbol = F.coalesce(symbol, F.col("hit.symbol_name"))
    clamped = F.when(F.col("s").isNull(), F.col("e")).otherwise(
        F.greatest("s", F.least("e", F.col("hit.end_line")))
    )
    status = (
        F.when(~has_path, "ok")
        .when(F.col("spans").isNull(), "unknown_path")
        .when(F.col("hit").isNull(), "outside_chunks")
        .otherwise("ok")
    )
    return (
        f.withColumn("status", status)
        .withColumn("path", F.when(has_path, norm_path("path_raw")))
        .withColumn("line_start", F.when(~has_path, F.col("s")).otherwise(F.col("s")))
        .withColumn("line_end", F.when(has_path & F.col("e").isNotNull(), clamped).otherwise(F.col("e")))
        .withColumn("symbol_name", F.when(has_path, symbol).otherwise(F.col("symbol_name")))
        .drop("spans", "hit", "k", "s", "e")
    )


def with_fingerprint(findings: DataFrame, tags: Column | None = None) -> DataFrame:
    """``agent:severity:path:symbol:`` and 12 hex digits over the identifying fields."""
    file = F.when(F.coalesce("path", F.lit("")) == "", F.lit("global")).otherwise(norm_path("path"))
    symbol = F.coalesce(F.nullif(F.trim("symbol_name"), F.lit("")), F.lit("file"))
    line = F.coalesce(F.col("line_start").cast("string"), F.lit("file"))
    tag_key = F.array_join(F.array_sort(F.array_distinct(tags)), ",") if tags is not None else F.lit("")
    title = F.substring(F.lower(F.trim(F.coalesce("title", F.lit("")))), 1, 40)
    head = [F.col("agent_name"), F.col("severity"), file, symbol]
    basis = F.concat_ws(":", *head, line, tag_key, title)
    return findings.withColumn(
        "fingerprint", F.concat_ws(":", *head, F.substring(F.sha1(basis.cast("binary")), 1, 12))
    )


def annotate_complexity(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Complexity of the enclosing top-level node, else of the first enclosing chunk."""
    keys = ["project_id"] if "project_id" in chunks.columns else []
    idx = chunk_index(chunks, keys)
    inside = lambda c: (c["start_line"] <= F.col("line_start")) & (c["end_line"] >= F.col("line_start"))
    f = findings.drop("complexity").withColumn("k", path_key("path")).join(idx, [*keys, "k"], "left")
    f = f.withColumn("c", F.get(F.filter("spans", inside), F.lit(0)))
    value = F.col("c.complexity")
    if "node_complexities" in chunks.columns:
        value = F.coalesce(F.get(F.filter("c.node_complexities", inside), F.lit(0))["complexity"], value)
    return f.withColumn("complexity", value).drop("k", "spans", "c")


def _cluster_stats(clustered: DataFrame) -> DataFrame:
    """One pass per cluster: the kept member, totals, first text, first ``seq`` of every severity."""
    c = clustered.withColumn("rank", severity_rank("severity"))
    kept = [x for x in clustered.columns if x not in ("component", "description", "score_penalty")]
    firsts = [F.min(F.when(F.col("rank") == i, F.col("seq"))) for i in range(len(SEVERITIES))]
    return c.groupBy("component").agg(
        F.min_by(F.struct(*kept), F.struct("rank", "seq")).alias("keep"),
        F.count("*").alias("n_merged"),
        F.max(F.coalesce("score_penalty", F.lit(0.0))).alias("penalty"),
        F.max("score_penalty").alias("explicit"),
        F.array_sort(F.collect_set("agent_name")).alias("agents"),
        F.min("seq").alias("head_seq"),
        F.min_by("description", "seq").alias("head_text"),
        F.array(*firsts).alias("firsts"),
    )


def _parts(clustered: DataFrame, stats: DataFrame) -> DataFrame:
    many = stats.where("n_merged > 1").select("component", "head_seq", "head_text", "firsts")
    c = clustered.select("component", "seq", "description", severity_rank("severity").alias("rank")).join(
        many, "component"
    )
    differs = c.where(~F.col("description").eqNullSafe(F.col("head_text"))).groupBy("component").agg(
        F.min("seq").alias("diff_seq")
    )
    c = c.join(differs, "component", "left")
    earlier = F.array_min(F.slice("firsts", F.lit(1), F.col("rank") + 1))
    place = (
        F.when(F.col("seq") == F.col("head_seq"), F.lit(0).cast("long"))
        .when(earlier == F.col("seq"), -F.col("seq") - 1)
        .otherwise(F.col("seq") + 1)
    )
    return c.where("seq = head_seq OR seq >= diff_seq").select(
        "component", place.alias("part"), F.col("description").alias("text")
    )


def description_parts(clustered: DataFrame) -> DataFrame:
    """The merged description of every cluster, one row per part, in reading order.

    Members fold in ``seq`` order: a member more severe than all before it goes
    to the front, any other to the back, and members repeating the very first
    text before anything else was added leave no part. A severity goes to the
    front at most once, so the order follows from one row of aggregates per
    cluster and no cluster has to pass through one task.
    """
    stats = _cluster_stats(clustered)
    single = stats.where("n_merged = 1").select(
        "component", F.lit(0).cast("long").alias("part"), F.col("head_text").alias("text")
    )
    return single.unionByName(_parts(clustered, stats))


def merge_findings(findings: DataFrame, **bars) -> DataFrame:
    """One row per cluster of duplicates.

    The most severe member wins (the earliest on ties); penalty is the maximum,
    agents the union. ``description`` joins all parts of ``description_parts``,
    which has the same text in rows for those who need no single value.
    """
    return merge_clustered(cut_lineage(cluster_findings(findings, **bars)))


def merge_clustered(clustered: DataFrame) -> DataFrame:
    stats = _cluster_stats(clustered)
    text = (
        _parts(clustered, stats)
        .groupBy("component")
        .agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
        .select("component", F.array_join(F.transform("parts", lambda p: p["text"]), MORE).alias("joined"))
    )
    many = F.col("n_merged") > 1
    penalty = F.when(~many, F.col("explicit")).when(F.col("explicit").isNotNull(), F.col("penalty"))
    return stats.join(text, "component", "left").select(
        "component",
        "keep.*",
        F.when(many, F.col("joined")).otherwise(F.col("head_text")).alias("description"),
        penalty.alias("score_penalty"),
        F.when(many, F.col("agents")).alias("merged_from"),
        "n_merged",
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """Count per project and severity, one column each."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return findings.groupBy("project_id").agg(*counts, F.count("*").alias("total"))
