"""Ranked lexical search: the highest-scoring documents of each item, through document FP-trees.

Documents are cut down to the terms of the items, each a list of terms by falling document frequency, so
that documents share leading terms. Sorted by these lists and range partitioned, neighbours form a trie
whose paths are shared; a task holds one stretch of it at a time. Of every subtree it knows the highest
frequency of each term and the smallest length norm, which bound any score below it; an item walks
the tree depth first, best child first, and leaves out what cannot reach its k-th score so far.

Items are taken in blocks of a bounded number of terms, each with one pass over the documents, so
neither the terms a task looks up nor the items it searches for grow with the tables.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import discard, stored

#: Terms of the items of one pass (an item of more terms is a pass of its own), documents of a tree and of a leaf.
BLOCK_TERMS = 100_000
TREE = 16_384
LEAF = 32
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Fixed values of the score: ASCII characters that are no part of a term, and the constants of the length norm and of the gain.
APART = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NORM, GAIN, SCALE, STEP = 75, 1_000_000_000, 1000, 8

_FOLD = bytes.maketrans(APART + bytes(range(0x41, 0x5B)), b" " * len(APART) + bytes(range(0x61, 0x7B)))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in bounded lists, A-Z lower-cased."""
    text = text.translate(_FOLD)  # blanks are the only separators left
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def gain(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (GAIN * tf) // (SCALE * tf + STEP * norm)


class Tree:
    """FP-tree over documents sorted by their term lists, paths of one child joined.

    ``start`` has the first entry of each document in ``term`` and ``tf``. Nodes are stretches of
    documents; children of a node are numbered in a row. Small sibling stretches share a leaf.
    """

    def __init__(self, ids: np.ndarray, norm: np.ndarray, start: np.ndarray, term: np.ndarray, tf: np.ndarray, leaf: int):
        self.ids, self.start, self.term = ids, start, term
        self.gain = gain(tf, np.repeat(norm, np.diff(start)))
        spans, children, todo = [(0, len(ids))], {}, [0]
        for node in todo:  # grows while it is walked
            lo, hi = spans[node]
            parts = self._parts(lo, hi, leaf) if hi - lo > leaf else []
            if len(parts) > 1:
                children[node] = (len(spans), len(spans) + len(parts))
                todo += range(len(spans), len(spans) + len(parts))
                spans += parts
        self.spans, self.children = spans, children
        self.least = [int(ids[lo:hi].min()) for lo, hi in spans]
        at, names, gains = [0, 0], [], []
        for lo, hi in spans[1:]:
            a, b = start[lo], start[hi]
            order = np.argsort(term[a:b], kind="stable")
            name = term[a:b][order]
            cut = np.flatnonzero(np.diff(name, prepend=-1))
            names.append(name[cut])
            most = np.maximum.reduceat(tf[a:b][order], cut)
            gains.append(gain(most, norm[lo:hi].min()))
            at.append(at[-1] + len(cut))
        self.bound_at = np.array(at, np.int64)
        self.bound_term = np.concatenate([np.empty(0, term.dtype), *names])
        self.bound_gain = np.concatenate([np.empty(0, np.int64), *gains])

    def _parts(self, lo: int, hi: int, leaf: int) -> list[tuple[int, int]]:
        a, b = (self.term[self.start[i] : self.start[i + 1]] for i in (lo, hi - 1))
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        depth = int(differ[0]) if len(differ) else n
        at = self.start[lo:hi] + depth
        follows = at < self.start[lo + 1 : hi + 1]
        next_ = np.where(follows, self.term[np.minimum(at, len(self.term) - 1)], -1)
        cuts = [lo, *(np.flatnonzero(np.diff(next_)) + lo + 1).tolist(), hi]
        parts: list[tuple[int, int]] = []
        joined = False
        for x, y in zip(cuts, cuts[1:], strict=False):
            small = y - x <= leaf
            if small and joined and y - parts[-1][0] <= leaf:
                parts[-1] = (parts[-1][0], y)
            else:
                parts.append((x, y))
            joined = small
        return parts

    def search(self, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put the documents among the ``k`` highest ``(score, -id)`` into the heap ``best``."""
        stack = [(1 << 62, 0)]
        while stack:
            bound, node = stack.pop()
            if len(best) == k and (bound, -self.least[node]) <= best[0]:
                continue
            inside = self.children.get(node)
            if inside is None:
                lo, hi = self.spans[node]
                a, b = self.start[lo], self.start[hi]
                score = np.add.reduceat(weight[self.term[a:b]] * self.gain[a:b], self.start[lo:hi] - a)
                least = best[0][0] if len(best) == k else 1
                for i in np.flatnonzero(score >= least).tolist():
                    found = int(score[i]), -int(self.ids[lo + i])
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                continue
            c, d = inside
            a, b = self.bound_at[c], self.bound_at[d]
            bounds = np.add.reduceat(weight[self.bound_term[a:b]] * self.bound_gain[a:b], self.bound_at[c:d] - a)
            live = np.flatnonzero(bounds >= (best[0][0] if len(best) == k else 1))
            stack += [(int(bounds[i]), c + int(i)) for i in live[np.argsort(bounds[live], kind="stable")]]


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, scores above 0.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``. Ties go to the smaller id. NULL or empty texts
    have no terms, and an item without terms that occur has no rows. Rows with a NULL id take no part. Every
    row of ``docs`` is a document of its own, so a repeated row may come repeatedly; of items with equal ids
    the one of the least text stays. Either table empty gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    asked = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").cast("binary").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: Counter = Counter()
                for part in terms(text or b""):
                    seen.update(part)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(seen), pa.int64()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["item_id", "term", "times"])

    wanted = stored(asked.mapInArrow(listed, "item_id long, term binary, times long"), "item-terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    out = None
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        found = _block(docs, part, k)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, wanted: pa.Table, k: int) -> DataFrame:
    spark, schema = docs.sparkSession, "item_id long, doc_id long, score long"
    names = sorted(set(wanted["term"].to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    if not names:
        return spark.createDataFrame([], schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = number.get
        for batch in batches:
            size, term, tf = [], [], []
            for text in batch.column(1):
                n, seen = 0, Counter()
                for part in terms(text.as_buffer().to_pybytes()):
                    n += len(part)
                    seen.update(map(look, part))
                seen.pop(None, None)
                size.append(n)
                term.append(list(seen))
                tf.append(list(seen.values()))
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    vectors = docs.mapInArrow(counted, "doc_id long, n long, term array<int>, tf array<int>").where("n > 0")
    vectors = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "restricted-vectors")
    totals = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.when(F.size("term") > 0, 1)).alias("met")).first()
    held = vectors.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(names), np.int64)
    df[held["term"].to_numpy()] = held["df"].to_numpy()
    weight = [math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * d + 1))) for d in df.tolist()]
    # terms by falling frequency; of weight 0 none is kept
    order = np.argsort(-df, kind="stable")
    place = np.full(len(names), -1, np.int32)
    kept = [t for t in order.tolist() if df[t] and weight[t]]
    place[kept] = np.arange(len(kept))
    queries: dict[int, tuple[list[int], list[int]]] = {}
    for item, term, times in zip(*(wanted[c].to_pylist() for c in ("item_id", "term", "times")), strict=True):
        at = place[number[term]]
        if at >= 0:
            ranks, weights = queries.setdefault(item, ([], []))
            ranks.append(int(at))
            weights.append(weight[number[term]] * times)
    n_docs, n_terms, n_kept = totals["docs"], totals["terms"], len(kept)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = pa.array([100 - NORM + (NORM * n * n_docs) // n_terms for n in batch.column(1).to_pylist()], pa.int64())
            lists = batch.column(2)
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            rank, tf = place[lists.flatten().to_numpy()], batch.column(3).flatten().to_numpy()
            keep = np.flatnonzero(rank >= 0)
            keep = keep[np.lexsort((rank[keep], doc[keep]))]
            start = np.searchsorted(doc[keep], np.arange(len(lists) + 1)).astype(np.int32)
            columns = [batch.column(0), norm, *(pa.ListArray.from_arrays(pa.array(start), pa.array(x[keep])) for x in (rank, tf)), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "norm", "path", "tf", "row"])

    paths = vectors.where(F.size("term") > 0).mapInArrow(ordered, "doc_id long, norm long, path array<int>, tf array<int>, row long").where(F.size("path") > 0)
    # about one tree a task, so that none grows with the input;
    # documents of equal paths are many where texts are copies; ids and rows part them
    sorted_ = paths.repartitionByRange(max(1, -(-totals["met"] // TREE)), "path", "doc_id", "row").sortWithinPartitions("path", "doc_id", "row")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {item: [] for item in queries}
        scratch = np.zeros(n_kept, np.int64)

        def grown(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            path, tf = t["path"].combine_chunks(), t["tf"].combine_chunks()
            start = path.offsets.to_numpy().astype(np.int64)
            tree = Tree(t["doc_id"].to_numpy(), t["norm"].to_numpy(), start - start[0], path.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64), LEAF)
            for item, (ranks, weights) in queries.items():
                scratch[ranks] = weights
                tree.search(scratch, best[item], k)
                scratch[ranks] = 0

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, TREE - n)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == TREE:
                    grown(held)
                    held, n = [], 0
        if held:
            grown(held)
        rows = [(item, -doc, score) for item, top in best.items() for score, doc in top]
        columns = zip(*rows, strict=True) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    out = stored(sorted_.mapInArrow(searched, schema), "ranked")
    discard(vectors)
    return out
