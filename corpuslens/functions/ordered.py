"""Order-dependent lookups that split a hot key by blocks of the order column.

A plain window puts a whole key into one task. These cut the key into blocks,
look inside each block, and carry one summary row per block across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stored


def carry_last(df: DataFrame, keys: list[str], block: Column, order: list, value: Column, out: str) -> DataFrame:
    """``out``: last non-null ``value`` on the rows strictly before, per key in ``order``.

    ``block`` must be monotone in ``order``.
    """
    d = df.withColumn("_blk", block).withColumn("_v", value)
    k = [*keys, "_blk"]
    inside = Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = d.where("_v IS NOT NULL").groupBy(*k).agg(F.max_by("_v", F.struct(*order)).alias("_top"))
    seen = d.select(*k).distinct().join(tops, k, "left")
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = seen.withColumn("_before", F.last("_top", ignorenulls=True).over(across)).drop("_top")
    return (
        d.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
        .join(before, k, "left")
        .withColumn(out, F.coalesce("_in", "_before"))
        .drop("_blk", "_v", "_in", "_before")
    )


def next_value(df: DataFrame, keys: list[str], block: Column, order: list, value: Column, out: str) -> DataFrame:
    """``out``: ``value`` of the following row per key in ``order``; NULL on the last row."""
    d = df.withColumn("_blk", block).withColumn("_v", value)
    k = [*keys, "_blk"]
    first = d.groupBy(*k).agg(F.min_by("_v", F.struct(*order)).alias("_first"))
    after = first.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_blk"))).drop("_first")
    return (
        d.withColumn("_in", F.lead("_v").over(Window.partitionBy(*k).orderBy(*order)))
        .join(after, k)
        .withColumn(out, F.coalesce("_in", "_after"))
        .drop("_blk", "_v", "_in", "_after")
    )


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: dense position from 0 of each row in ``order``, by a range sort and one offset per partition.

    How the order columns are spaced does not matter. Ties get different numbers.
    """
    at = F.monotonically_increasing_id()
    d = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "numbered")
    d = d.withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row per partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_off"))
    return (
        d.join(offsets, "_part")
        .withColumn(out, F.col("_off") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at", "_part", "_off")
    )


def rank_in_order(df: DataFrame, keys: list[str], seq: str, out: str) -> DataFrame:
    """1-based position per key ordered by the unique ``seq``."""
    d = numbered(df, [*keys, seq], "_no")
    first = d.groupBy(*keys).agg(F.min("_no").alias("_first"))
    return d.join(first, keys).withColumn(out, F.col("_no") - F.col("_first") + 1).drop("_no", "_first")
