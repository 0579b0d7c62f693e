"""Findings of several reviewers about the same place: clusters, symbols, conflicts, verdicts."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import CROSS_WEIGHTS, HARDEN_WORDS, NEAR_LINES, RELAX_WORDS, SEVERITIES
from corpuslens.functions.text import ascii_word, severity_rank
from corpuslens.operators.clusters import cluster_findings
from corpuslens.session import cut_lineage


def _severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def _summarise(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of at least two agents: agents, worst severity, three leading titles, line span.

    The three titles come from a ranked top-3, which Spark prunes before the
    shuffle, so no group is gathered.
    """
    c = clustered.withColumn("rank", severity_rank("severity"))
    groups = (
        c.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set("agent_name")).alias("agents"),
            F.min("rank").alias("rank"),
            F.min("line_start").alias("line_lo"),
            F.max("line_start").alias("line_hi"),
            F.min("seq").alias("first_seq"),
        )
        .where(F.size("agents") >= 2)
    )
    w = Window.partitionBy(*keys).orderBy("rank", "seq")
    titles = (
        c.select(*keys, "rank", "seq", "title")
        .withColumn("rn", F.row_number().over(w))
        .where("rn <= 3")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rn", "title"))).alias("t"))
        .select(*keys, F.array_join(F.transform("t", lambda x: x["title"]), "; ").alias("description"))
    )
    return (
        groups.join(titles, keys)
        .withColumn("severity", _severity_name(F.col("rank")))
        .withColumn("agents", F.array_join("agents", ","))
        .drop("rank")
    )


def correlate_lines(findings: DataFrame) -> DataFrame:
    """Clusters of nearby similar findings in one file that involve two or more agents."""
    return _line_rows(located(findings.where("line_start IS NOT NULL")))


def located(findings: DataFrame) -> DataFrame:
    """Findings with a path, clustered by the correlation rules."""
    return cluster_findings(findings.where("path <> ''"), same_line_rule=False)


def _line_rows(clustered: DataFrame) -> DataFrame:
    s = _summarise(clustered, ["project_id", "path", "component"])
    place = F.when(
        F.col("line_lo") == F.col("line_hi"), F.concat("path", F.lit(":"), F.col("line_lo").cast("string"))
    ).otherwise(
        F.concat("path", F.lit(":"), F.col("line_lo").cast("string"), F.lit("-"), F.col("line_hi").cast("string"))
    )
    return s.select(
        "project_id",
        F.lit("lines").alias("kind"),
        F.concat(F.lit("Multi-domain issues near "), place).alias("title"),
        "description",
        "agents",
        "path",
        F.lit(None).cast("string").alias("symbol_name"),
        "severity",
        F.lit(1).cast("long").alias("blast_radius"),
        "line_lo",
        "line_hi",
        "first_seq",
    )


def correlate_files(findings: DataFrame) -> DataFrame:
    """The same for findings without a line, by title or description."""
    return _file_rows(located(findings.where("line_start IS NULL")))


def _file_rows(clustered: DataFrame) -> DataFrame:
    s = _summarise(clustered, ["project_id", "path", "component"])
    return s.select(
        "project_id",
        F.lit("file").alias("kind"),
        F.concat(F.lit("Multi-domain issues in "), "path").alias("title"),
        "description",
        "agents",
        "path",
        F.lit(None).cast("string").alias("symbol_name"),
        "severity",
        F.lit(1).cast("long").alias("blast_radius"),
        F.lit(None).cast("int").alias("line_lo"),
        F.lit(None).cast("int").alias("line_hi"),
        "first_seq",
    )


def correlate_symbols(findings: DataFrame) -> DataFrame:
    """Symbols flagged by two or more agents; blast radius is the number of files."""
    f = findings.where("path IS NOT NULL AND path <> '' AND symbol_name <> ''")
    keys = ["project_id", "symbol_name"]
    files = f.select(*keys, "path").distinct().groupBy(*keys).agg(F.count("*").alias("blast_radius"))
    return (
        _summarise(f, keys)
        .join(files, keys)
        .select(
            "project_id",
            F.lit("symbol").alias("kind"),
            F.concat(F.lit('Symbol "'), "symbol_name", F.lit('" flagged across domains')).alias("title"),
            "description",
            "agents",
            F.lit(None).cast("string").alias("path"),
            "symbol_name",
            "severity",
            "blast_radius",
            F.lit(None).cast("int").alias("line_lo"),
            F.lit(None).cast("int").alias("line_hi"),
            "first_seq",
        )
    )


def symbol_files(findings: DataFrame) -> DataFrame:
    """The files behind ``correlate_symbols``, one row each."""
    return (
        findings.where("path IS NOT NULL AND path <> '' AND symbol_name <> ''")
        .select("project_id", "symbol_name", "path")
        .distinct()
    )


def dedupe_correlations(lines: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Drop a line cluster that overlaps an earlier kept one of the same file and agents.

    Only line clusters carry ranges, and symbols and files never repeat, so the
    other two kinds pass through. Clusters that touch through others form a stretch of
    the line axis; each stretch is decided on its own, in ``first_seq`` order.
    """
    kept = _first_non_overlapping(lines.withColumn("id", F.col("first_seq")))
    return kept.drop("id").unionByName(files).unionByName(symbols)


def _first_non_overlapping(lines: DataFrame) -> DataFrame:
    keys = ["project_id", "path", "agents"]
    by_line = Window.partitionBy(*keys).orderBy("line_lo", "line_hi", "id")
    before = F.max("line_hi").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum("starts").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    spans = lines.select(*keys, "id", "line_lo", "line_hi")
    spans = spans.withColumn("starts", F.when(before >= F.col("line_lo"), 0).otherwise(1)).withColumn("stretch", stretch)

    def decide(f: pd.DataFrame) -> pd.DataFrame:
        kept, low, high = [], [], []
        for row in f.sort_values("id").itertuples():
            i = bisect_left(high, row.line_lo)
            if i == len(low) or low[i] > row.line_hi:
                low.insert(i, row.line_lo)
                high.insert(i, row.line_hi)
                kept.append(row.Index)
        return f.loc[kept, [*keys, "id"]]

    alone = F.count("*").over(Window.partitionBy(*keys, "stretch"))
    sized = spans.withColumn("n", alone)
    schema = spans.select(*keys, "id").schema
    won = sized.where("n > 1").groupBy(*keys, "stretch").applyInPandas(decide, schema)
    return lines.join(sized.where("n = 1").select(*keys, "id").unionByName(won), [*keys, "id"], "left_semi")


def cross_findings(findings: DataFrame) -> DataFrame:
    """All correlations of a findings table; lines and files share one clustering."""
    c = cut_lineage(located(findings))
    return dedupe_correlations(
        _line_rows(c.where("line_start IS NOT NULL")),
        _file_rows(c.where("line_start IS NULL")),
        correlate_symbols(findings),
    )


def valence(text: Column) -> tuple[Column, Column]:
    """``(sign, margin)``: do more distinct hardening or more relaxing words occur."""
    t = F.lower(text)
    hits = lambda words: sum((F.when(t.rlike(ascii_word(w)), 1).otherwise(0) for w in words), F.lit(0))
    diff = hits(HARDEN_WORDS) - hits(RELAX_WORDS)
    return F.signum(diff).cast("int"), F.abs(diff)


def with_valence(findings: DataFrame) -> DataFrame:
    """Valence of each finding's title and description; a NULL one says nothing."""
    sign, margin = valence(F.concat_ws(" ", "title", "description"))
    return findings.withColumn("sign", sign).withColumn("margin", margin)


def detect_conflicts(findings: DataFrame, window: int = NEAR_LINES) -> DataFrame:
    """Pairs of findings of different agents whose lines are within ``window`` in one file.

    Meant for merged findings. The join key is file and line block, the other
    side repeated into its neighbour blocks, so a crowded file spreads over its
    blocks and only pairs that can be near are formed.
    """
    ok = findings.where("path <> '' AND line_start IS NOT NULL AND line_end IS NOT NULL")
    side = with_valence(ok).select(
        "project_id", "path", "seq", "agent_name", "line_start", "line_end", "sign", "margin",
        F.floor(F.col("line_start") / (window + 1)).alias("blk"),
    )
    keys = ["project_id", "path", "blk"]
    mine = ["seq", "agent_name", "line_start", "line_end", "sign", "margin"]
    a = side.select(*keys, *[F.col(c).alias(f"{c}_a") for c in mine])
    b = side.withColumn("blk", F.explode(F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1))).select(
        *keys, *[F.col(c).alias(f"{c}_b") for c in mine]
    )
    near = (
        (F.col("seq_a") < F.col("seq_b"))
        & (F.col("agent_name_a") != F.col("agent_name_b"))
        & (F.abs(F.col("line_start_a") - F.col("line_start_b")) <= window)
    )
    clear = (F.col("sign_a") * F.col("sign_b") == -1) & (F.least("margin_a", "margin_b") > 1)
    return a.join(b, keys).where(near).select(
        "project_id",
        "path",
        F.least("line_start_a", "line_start_b").alias("line_start"),
        F.greatest("line_end_a", "line_end_b").alias("line_end"),
        "seq_a",
        "seq_b",
        "agent_name_a",
        "agent_name_b",
        F.when(clear, "high").otherwise("low").alias("confidence"),
    )


def inject_verdicts(findings: DataFrame, conflicts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Append an informational finding for every arbitrated conflict that is real."""
    spot = F.concat(
        F.lit("[VERDICT] "), "path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"),
        F.col("line_end").cast("string"),
    )
    saved = F.when(F.col("slug").isNotNull(), F.concat(F.lit("\nSaved as: "), "slug", F.lit(".md"))).otherwise("")
    new = (
        conflicts.join(verdicts.where("is_conflict"), ["seq_a", "seq_b"])
        .select(
            F.lit(None).cast("long").alias("seq"),
            "project_id",
            F.lit("architecture").alias("agent_name"),
            F.lit("info").alias("severity"),
            spot.alias("title"),
            F.concat(F.lit("Decision: "), "decision", F.lit("\nTradeoff: "), "tradeoff", saved).alias("description"),
            "path",
            "line_start",
            "line_end",
            F.lit(0.0).alias("score_penalty"),
            F.lit("architectural-decision,arbitration-verdict").alias("tags"),
        )
    )
    old = findings.withColumn("tags", F.lit("")).select(*new.columns)
    return old.unionByName(new)


def cross_penalty(weights: dict[str, float] = CROSS_WEIGHTS) -> Column:
    """Base weight by severity, growing with the log of the blast radius up to threefold."""
    base = F.lit(0.0)
    for s, v in weights.items():
        base = F.when(F.col("severity") == s, F.lit(float(v))).otherwise(base)
    radius = F.greatest(F.lit(1.0), F.coalesce(F.col("blast_radius").cast("double"), F.lit(1.0)))
    return base * F.least(F.lit(1.0) + F.log2(radius) * 0.2, F.lit(3.0))
