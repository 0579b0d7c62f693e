"""Score history: retention, deltas, trends, listings, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.ordered import carry_last
from corpuslens.functions.text import half_up



def _kind():
    return F.coalesce("kind", F.lit("full"))


def trim_history(history: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` rows per project for full and for diff runs separately."""
    if keep <= 0:
        return history.limit(0)
    w = Window.partitionBy("project_id", F.when(_kind() == "diff", "diff").otherwise("full")).orderBy(
        F.desc("ts"), F.desc("run_id")
    )
    return history.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def with_delta(history: DataFrame, unit: str = "month") -> DataFrame:
    """``previous_score`` of the last full run before, and the change; 0 without one."""
    h = carry_last(
        history,
        ["project_id"],
        F.date_trunc(unit, "ts"),
        ["ts", "run_id"],
        F.when(_kind() != "diff", F.col("score")),
        "previous_score",
    )
    return h.withColumn("delta", F.coalesce(F.col("score") - F.col("previous_score"), F.lit(0)))


def trend_levels(history: DataFrame, last: int = 20, levels: int = 8) -> DataFrame:
    """The last ``last`` full scores per project scaled between the lowest and highest ever."""
    full = history.where(_kind() != "diff")
    span = full.groupBy("project_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    w = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("run_id"))
    recent = full.withColumn("age", F.row_number().over(w)).where(F.col("age") <= last)
    width = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.col("hi") - F.col("lo"))
    level = half_up((F.col("score") - F.col("lo")) / width * (levels - 1)).cast("int")
    return recent.join(span, "project_id").select("project_id", "run_id", "ts", "score", "age", level.alias("level"))


def recent_scores(history: DataFrame, last: int = 10) -> DataFrame:
    """Newest full runs per project with their position."""
    w = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("run_id"))
    return (
        history.where(_kind() != "diff")
        .withColumn("position", F.row_number().over(w))
        .where(F.col("position") <= last)
    )


def score_as_of(history: DataFrame, cuts: DataFrame, unit: str = "month") -> DataFrame:
    """``cuts(project_id, cut_id, cut_ts)`` to the latest full score at or before each cut.

    Both sides are merged on one time axis, so no cut is paired with every run.
    """
    runs = history.where(_kind() != "diff").select(
        "project_id", "ts", F.lit(0).alias("side"), F.col("run_id").alias("tie"), F.col("score").alias("value"),
        F.lit(None).cast("long").alias("cut_id"),
    )
    marks = cuts.select(
        "project_id", F.col("cut_ts").alias("ts"), F.lit(1).alias("side"), F.col("cut_id").alias("tie"),
        F.lit(None).cast("int").alias("value"), F.col("cut_id").cast("long").alias("cut_id"),
    )
    axis = runs.unionByName(marks)
    out = carry_last(
        axis, ["project_id"], F.date_trunc(unit, "ts"), ["ts", "side", "tie"], F.col("value"), "base_score"
    )
    return out.where("side = 1").select("project_id", "cut_id", F.col("ts").alias("cut_ts"), "base_score")
