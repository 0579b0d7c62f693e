"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors is quantised on its own, so a vector's cell is a pair of centroids and
a few centroids make many cells. A query walks the pairs by summed distance with a heap until
the cells seen hold a given share of all entries; those entries are ranked by exact distance.
The share is what pseudo-queries on the fitting sample need for the wanted recall: small on
clustered vectors, large on shapeless ones.

Centroids, cell sizes and the share are bounded by parameters; every vector is indexed. Cells are
grouped into shards of a bounded number of entries, a large cell being split, and a shard's
entries meet its queries in blocks, so no task grows with a cell or with the queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpuslens.llm.common import mixed
from corpuslens.session import stored

#: Centroids of a half; bound of the sample that they are fitted on; recall that the share aims at.
CENTROIDS = 64
SAMPLE = 20_000
RECALL = 0.96
PSEUDO_QUERIES = 200
ROUNDS = 8
#: Entries of a shard, and queries that meet it at once.
SHARD = 8192
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Centroids of both halves and the walk over their pairs."""

    def __init__(self, sample: np.ndarray, centroids: int):
        rng = np.random.default_rng(5)
        self.half = sample.shape[1] // 2
        k = max(1, min(centroids, len(sample) // 8))
        self.c = _means(sample[:, : self.half], k, rng), _means(sample[:, self.half :], k, rng)
        self.k = k

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = x[:, : self.half], x[:, self.half :]
        return _squares(a, self.c[0]).argmin(1) * self.k + _squares(b, self.c[1]).argmin(1)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells by summed distance of their centroids."""
        d = [_squares(part[None], c)[0] for part, c in zip((q[: self.half], q[self.half :]), self.c, strict=True)]
        order = [np.argsort(x, kind="stable") for x in d]
        d = [x[o].tolist() for x, o in zip(d, order, strict=True)]
        order = [o.tolist() for o in order]
        heap = [(d[0][0] + d[1][0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield order[0][i] * self.k + order[1][j]
            if j + 1 < self.k:
                heapq.heappush(heap, (d[0][i] + d[1][j + 1], i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (d[0][i + 1] + d[1][0], i + 1, 0))

    def probe(self, q: np.ndarray, sizes: np.ndarray, entries: float) -> list[int]:
        out, n = [], 0
        for cell in self.walk(q):
            if sizes[cell]:
                out.append(cell)
                n += sizes[cell]
                if n >= entries:
                    break
        return out

    def share(self, sample: np.ndarray, k: int, recall: float) -> float:
        """Share of the entries that holds ``recall`` of the sample's own neighbours."""
        rng = np.random.default_rng(6)
        rows = rng.choice(len(sample), min(PSEUDO_QUERIES, len(sample)), replace=False)
        d = _squares(sample[rows], sample)
        d[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(d, min(k, len(sample) - 1), axis=1)[:, :k]
        cell = self.cells(sample)
        sizes = np.bincount(cell, minlength=self.k**2)
        seen = []
        for row, best in zip(rows, near, strict=True):
            at = {c: n for n, c in enumerate(self.walk(sample[row]))}
            place = np.array([at[c] for c in range(self.k**2)])
            upto = np.zeros(self.k**2 + 1)
            upto[place + 1] = sizes
            upto = np.cumsum(upto)
            seen += (upto[place[cell[best]] + 1] / len(sample)).tolist()
        return float(np.quantile(seen, recall)) if seen else 1.0


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, centroids: int = CENTROIDS, sample: int = SAMPLE, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query, by Euclidean distance.

    ``vectors`` has ``vec_id, embedding``; queries are the rows for which ``is_query`` holds, and
    a query is compared with every row of another id. Rows with a NULL id and vectors that are
    NULL, zero, not finite, or of another than the most frequent length take no part. Repeated
    rows count once. Ties go to the smaller id. Fewer candidates than ``k`` are all returned.
    """
    # 32-bit components stay as they are, all others are taken in double precision
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "array<double>"
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"), is_query.alias("q"))
    own = own.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = length["dim"]
    own = own.where(F.size("v") == dim)
    # of equal vectors only the smallest ids can be among the k nearest, and one more for the query's own
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    entries = own.select("vec_id", "v").distinct().withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1)
    picked = own.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    fitted = _matrix(picked["v"], dim)
    index = Index(fitted, centroids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cells(_matrix(batch.column(1), dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["vec_id", "v", "cell"])

    indexed = stored(entries.select("vec_id", "v").mapInArrow(placed, f"vec_id long, v {kind}, cell int"), "cells")
    sizes = np.zeros(index.k**2, np.int64)
    for row in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # centroids squared at most
        sizes[row["cell"]] = row["n"]
    wanted = index.share(fitted, k, recall) * sizes.sum()
    # neighbouring cells share a shard until it is full; a larger cell takes several of its own
    first, parts, shard, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for cell in np.flatnonzero(sizes):
        n = int(sizes[cell])
        if n > room:
            shard += 1
            room = SHARD
        first[cell], parts[cell] = shard, max(1, -(-n // SHARD))
        shard += int(parts[cell]) - 1
        room = room - n if parts[cell] == 1 else 0

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for query, at, v in zip(batch.column(0).to_pylist(), range(batch.num_rows), _matrix(batch.column(1), dim), strict=True):
                to: dict[int, list[int]] = {}
                for cell in index.probe(v, sizes, wanted):
                    for s in range(first[cell], first[cell] + parts[cell]):
                        to.setdefault(int(s), []).append(cell)
                rows += [(query, at, s, cells) for s, cells in to.items()]
            query, at, to_, cells = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(to_, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                ["query_id", "v", "shard", "cells"],
            )

    asked = own.where("q").select("vec_id", "v").distinct()
    visits = stored(asked.mapInArrow(probed, f"query_id long, v {kind}, shard int, cells array<int>"), "visits")
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            salt = (mixed(batch.column(0).to_numpy().astype(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)  # ids may have a stride
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((first[cell] + salt).astype(np.int32))], ["vec_id", "v", "cell", "shard"])

    left = indexed.mapInArrow(sharded, f"vec_id long, v {kind}, cell int, shard int").join(blocks, "shard")
    left = left.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v",
        F.array("cell").alias("cells"),
    )
    right = visits.join(blocks, "shard").select(
        "shard", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), F.col("query_id").alias("id"), "v", "cells"
    )
    met = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", "side")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None

        def best() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            side, ids, v = t["side"].to_numpy(), t["id"].to_numpy(), _matrix(t["v"], dim)
            of = int((side == 0).sum())
            out: list[tuple] = []
            cells = t["cells"].to_pylist()
            cell = np.array([c[0] for c in cells[:of]], np.int64)
            for low in range(of, len(side) if of else 0, 64):
                d = _squares(v[low : low + 64], v[:of])
                for i in range(len(d)):
                    seen = np.zeros(len(sizes), bool)
                    seen[cells[low + i]] = True
                    d[i, ~seen[cell] | (ids[:of] == ids[low + i])] = np.inf
                    limit = np.partition(d[i], min(k, of) - 1)[min(k, of) - 1]
                    near = np.flatnonzero(d[i] <= (limit * (1 + 1e-9) + 1e-12 if np.isfinite(limit) else 1e308))
                    exact = np.sqrt(((v[near] - v[low + i]) ** 2).sum(1))
                    for j in np.lexsort((ids[near], exact))[:k]:
                        out.append((int(ids[low + i]), int(ids[near[j]]), float(exact[j])))
            query, vec, score = zip(*out, strict=True) if out else ((),) * 3
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            shard, part = batch.column("shard").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held and block != (shard[a], part[a]):
                    yield best()
                    held = []
                block = (shard[a], part[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield best()

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        met.mapInArrow(ranked, "query_id long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
