"""Vectors of whole numbers, and the meeting of a query set with all rows block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stored

#: Rows of a stripe at most, rows of one where there are fewer than the cores could share, queries that meet it at once.
STRIPE = 65_536
LEAST_STRIPE = 4096
BLOCK = 1024


def integer_vectors(vectors: DataFrame, is_query: Column, scale: int, copies: int, label: Column | None = None) -> tuple[DataFrame, int]:
    """Stored table ``vec_id, x, label, q, copy`` of the rows that take part, and their length.

    ``x`` is ``floor(scale * component)`` in 64 bits. No part take: a NULL id; a vector that is NULL or
    has a NULL or non-finite component; one whose integer square sum needs more than 62 bits (so
    inner products of any two fit 64 bits); a length that is not the most frequent (of equally frequent
    ones the shortest counts). Of rows with equal ids one stays, that of the least vector. ``copy``
    numbers equal vectors of a label by id; beyond ``copies`` only queries are kept.
    """
    double = F.col("embedding").cast("array<double>")
    finite = F.forall(double, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("v"), (F.lit(0) if label is None else label).alias("label"), is_query.alias("q"), finite.alias("finite"))
    own = own.where("vec_id IS NOT NULL AND label IS NOT NULL AND finite").withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    own = own.where(square < float(1 << 62)).select("vec_id", F.col("v").alias("x"), "label", F.coalesce("q", F.lit(False)).alias("q"))
    one = own.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("least"), F.bool_or("q").alias("q"))
    one = one.select("vec_id", "least.x", "least.label", "q")
    length = one.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = length["dim"] if length else 0
    same = Window.partitionBy(F.xxhash64("x"), "x", "label").orderBy("vec_id")
    numbered = one.where(F.size("x") == dim).withColumn("copy", F.row_number().over(same))
    return stored(numbered.where((F.col("copy") <= copies) | F.col("q")), "integer-vectors"), dim


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as 64-bit integers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(flat), dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` and ``b``.

    Doubles hold every partial sum exactly as long as the norms allow it; else 64-bit integers do.
    """
    most = [np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties to the smaller id."""
    if len(score) > k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= limit)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def in_blocks(queries: DataFrame, entries: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(query block, stripe)`` for every block of queries and stripe of entries, as one table.

    Both have ``vec_id``. Ids are dealt by their hash, so a block holds about ``BLOCK`` queries, a stripe
    at most about ``STRIPE`` entries, whatever the data; no task grows with the input.
    """
    spark = entries.sparkSession
    n, asked = entries.count(), queries.count()
    stripes = max(-(-n // STRIPE), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_STRIPE)), 1)
    blocks = max(-(-asked // BLOCK), 1)

    def number(parts: int, seed: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")

    # fresh names: both may come from one table
    queries, entries = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (queries, entries))
    left = queries.withColumn("block", number(blocks, "query")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = entries.withColumn("stripe", number(stripes, "entry")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "stripe").cogroup(right.groupBy("block", "stripe")).applyInArrow(work, schema)
