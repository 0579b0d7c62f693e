"""Claims of reviewers scored against labelled defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _suffixes(c: str) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(F.col(c), i, F.length(c))
    )


def file_pairs(claims: DataFrame, defects: DataFrame) -> DataFrame:
    """Distinct ``(claim_file, defect_file)`` where one ends with the other.

    Every suffix of the distinct names on one side is looked up among the names
    of the other: two equi-joins over file names, however many claims there are.
    """
    norm = F.translate("file", "\\", "/")
    c = claims.select(norm.alias("claim_file")).distinct()
    d = defects.select(norm.alias("defect_file")).distinct()
    claim_longer = c.withColumn("k", F.explode(_suffixes("claim_file"))).join(d.withColumn("k", F.col("defect_file")), "k")
    defect_longer = d.withColumn("k", F.explode(_suffixes("defect_file"))).join(c.withColumn("k", F.col("claim_file")), "k")
    return claim_longer.select("claim_file", "defect_file").unionByName(
        defect_longer.select("claim_file", "defect_file")
    ).distinct()


def match_claims(claims: DataFrame, defects: DataFrame, tolerance: int = 10) -> DataFrame:
    """Every claim with its defect: same file up to a suffix, nearest line within ``tolerance``.

    Ties go to a real bug, then to catalogue order. Equal (file, line) claims are
    matched once; lines meet by block, the defect repeated into its neighbours.
    """
    norm = F.translate("file", "\\", "/")
    width = tolerance + 1
    d = defects.select(
        norm.alias("defect_file"), F.col("line_start").alias("d_line"), F.col("seq").alias("d_seq"), "id", "category"
    ).withColumn("blk", F.explode(F.array(*[(F.floor(F.col("d_line") / width) + i) for i in (-1, 0, 1)])))
    spots = claims.select(norm.alias("claim_file"), "line_start").distinct()
    spots = spots.withColumn("blk", F.floor(F.col("line_start") / width))
    dist = F.abs(F.col("line_start") - F.col("d_line"))
    best = (
        spots.join(file_pairs(claims, defects), "claim_file")
        .join(d, ["defect_file", "blk"])
        .where(dist <= tolerance)
        .groupBy("claim_file", "line_start")
        .agg(
            F.min_by(
                F.struct(F.col("id").alias("defect_id"), F.col("category")),
                F.struct(dist, F.col("category") != "real-bug", "d_seq"),
            ).alias("m")
        )
        .select("claim_file", "line_start", "m.*")
    )
    return (
        claims.withColumn("claim_file", norm)
        .join(best, ["claim_file", "line_start"], "left")
        .withColumn("outcome", F.when(F.col("category") == "real-bug", "tp").otherwise("fp"))
        .drop("claim_file")
    )


def _metrics(grouped: DataFrame, defects: DataFrame) -> DataFrame:
    d = grouped.withColumn("real_bugs", defects.agg(F.count_if(F.col("category") == "real-bug")).scalar())
    precision = F.when(F.col("claims") == 0, 0.0).otherwise(F.col("tp") / F.col("claims"))
    recall = F.when(F.col("real_bugs") == 0, 1.0).otherwise(F.col("found") / F.col("real_bugs"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    fpr = F.when(F.col("claims") == 0, 0.0).otherwise(F.col("fp") / F.col("claims"))
    return (
        d.withColumn("precision", F.round(precision, 6))
        .withColumn("recall", F.round(recall, 6))
        .withColumn("f1", F.round(f1, 6))
        .withColumn("fp_rate", F.round(fpr, 6))
    )


def _counts() -> list[Column]:
    tp = F.col("outcome") == "tp"
    return [
        F.count("*").alias("claims"),
        F.count_if(tp).alias("tp"),
        F.count_if(~tp).alias("fp"),
        F.count_distinct(F.when(tp, F.col("defect_id"))).alias("found"),
    ]


def score_agents(matches: DataFrame, defects: DataFrame) -> DataFrame:
    """Precision, recall on distinct real bugs, F1 and false-positive rate per agent."""
    return _metrics(matches.groupBy("agent_name").agg(*_counts()), defects)


def score_overall(matches: DataFrame, defects: DataFrame) -> DataFrame:
    return _metrics(matches.agg(*_counts()), defects)
