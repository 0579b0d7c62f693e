"""Exact top-k search by inner product over a vector-approximation file.

Each component is replaced by the number of its cell, one byte, with cell borders at the quantiles of
a bounded sample. A query scans the cells of all rows: they bound each inner product from both
sides, and only rows that may reach the k-th best lower bound remain. Their exact vectors are
read in the order of the upper bounds, first as many as the answer has rows, then those that may
still pass the k-th of these; after that the answer is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.integer_vectors import in_blocks, integer_vectors, matrix
from corpuslens.session import discard, stored

#: Vectors whose quantiles are the cell borders; cells of a component; queries whose bounds are in memory at once.
SAMPLE = 8192
CELLS = 256
AT_ONCE = 64


def borders(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> list[np.ndarray]:
    """First whole number of each cell, per component; the last number ends the last cell.

    ``low`` and ``high`` are the extremes over all rows, so every value lies in a cell.
    """
    out = []
    for d in range(sample.shape[1]):
        inside = np.quantile(sample[:, d], np.arange(1, cells) / cells, method="lower").astype(np.int64)
        starts = np.unique(np.concatenate([low[d : d + 1], inside[(inside > low[d]) & (inside <= high[d])]]))
        out.append(np.append(starts, high[d] + 1))
    return out


def coded(x: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """Cell number of every component."""
    out = np.empty(x.shape, np.uint8)
    for d, mark in enumerate(marks):
        out[:, d] = np.searchsorted(mark[1:-1], x[:, d], side="right")
    return out


def bounds(code: np.ndarray, query: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of ``query`` rows with the rows in these cells.

    Rounding of large sums is added on both sides.
    """
    middle, width = np.empty(code.shape), np.empty(code.shape)
    for d, mark in enumerate(marks):
        low, high = mark[:-1].astype(np.float64), mark[1:].astype(np.float64) - 1
        middle[:, d], width[:, d] = ((low + high) / 2)[code[:, d]], ((high - low) / 2)[code[:, d]]
    q = query.astype(np.float64)
    between, around = q @ middle.T, np.abs(q) @ width.T
    slack = np.abs(q) @ (np.abs(middle) + width).max(0, initial=0) * (2.0**-50 * max(1, len(marks)))
    slack = np.where(slack < 0.25, 0, slack)[:, None]
    return np.floor(between - around - slack), np.ceil(between + around + slack)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query, exactly.

    ``vectors`` has ``vec_id, embedding``; components become ``floor(scale * x)``. Queries are the rows
    for which ``is_query`` holds (NULL: no); candidates are all rows of another id. Equal scores go by
    the smaller id, fewer candidates than ``k`` are all returned, an empty table gives none. Rows that
    take no part and rows of equal ids: see ``integer_vectors``. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    own, dim = integer_vectors(vectors, is_query, scale, k + 1)
    entries, queries = own.where(F.col("copy") <= k + 1), own.where("q").select("vec_id", "x")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dim)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = entries.select("x").mapInArrow(extremes, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = ends.orderBy("d").toArrow()
    fitted = matrix(entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()["x"], dim)
    if not len(fitted):
        discard(own)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    marks = borders(fitted, ends["low"].to_numpy(), ends["high"].to_numpy(), cells)

    def approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = coded(matrix(batch.column(1), dim), marks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in code], pa.binary())], ["vec_id", "code"])

    file = stored(entries.select("vec_id", "x").mapInArrow(approximated, "vec_id long, code binary"), "approximation")

    def scanned(asked: pa.Table, stripe: pa.Table) -> pa.Table:
        """Rows of the stripe that may be among its own ``k`` best, with their bounds."""
        code = np.frombuffer(b"".join(stripe["code"].to_pylist()), np.uint8).reshape(stripe.num_rows, dim)
        query, x, ids = asked["vec_id"].to_numpy(), matrix(asked["x"], dim), stripe["vec_id"].to_numpy()
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        for a in range(0, len(query) if len(ids) else 0, AT_ONCE):
            low, high = bounds(code, x[a : a + AT_ONCE], marks)
            own_row = query[a : a + AT_ONCE, None] == ids
            low[own_row] = high[own_row] = -np.inf
            bar = np.partition(low, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            row, at = np.nonzero((high >= bar[:, None]) & ~own_row)
            parts.append((query[a + row], ids[at], low[row, at], high[row, at]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "low", "high"])

    near = in_blocks(queries, file, scanned, "query_id long, vec_id long, low double, high double")
    best_low = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "vec_id"))
    near = near.withColumn("r", best_low).withColumn("bar", F.max(F.when(F.col("r") == k, F.col("low"))).over(Window.partitionBy("query_id")))
    near = near.where("bar IS NULL OR high >= bar")
    reading = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id"))
    near = stored(near.select("query_id", "vec_id", "high", reading.alias("turn")), "reading-order")
    exact = own.select("vec_id", "x")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    product = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)

    def read(turns: DataFrame) -> DataFrame:
        return turns.join(exact, "vec_id").join(asked, "query_id").select("query_id", "vec_id", product.alias("score"))

    early = stored(read(near.where(F.col("turn") <= k)), "first-read")
    certain = early.groupBy("query_id").agg(F.min("score").alias("kth"))
    late = read(near.where(F.col("turn") > k).join(certain, "query_id").where("high >= kth").select("query_id", "vec_id"))
    ranked = early.unionByName(late).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = stored(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-inner-products")
    discard(own, file, near, early)
    return out
