"""Benchmark decontamination by greedy string tiling.

Items and documents meet on equal runs of a few words (seeds), found by rolling hashes over
whole texts. For every document and item that share a seed, the longest common passages are
marked one after the other, each word at most once on either side (running Karp-Rabin, greedy
string tiling), so passages count in whatever order they come. The share of the item's words
under tiles decides.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WordHashes, bit_filter, mixed, passes
from corpuslens.session import stored

#: Shortest tile, and the share of an item's words that must lie under tiles.
TILE = 5
COVERAGE = 0.5

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str | None, known: WordHashes) -> np.ndarray:
    return known.of([w.encode("utf-8", "replace") for w in _WORD.findall((text or "").lower())])


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words as signed 64 bits."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    s = np.full(n, np.uint64(width))
    for k in range(width):
        s = mixed(s * _STEP + h[k : n + k])
    return s.view(np.int64)


def _places(seeds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(seeds, kind="stable")
    values, first = np.unique(seeds[order], return_index=True)
    return values, np.split(order, first[1:]) if len(values) else []


def _matches(doc: dict[int, np.ndarray], item: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal seeds as ``(doc start, item start, seeds)``.

    Only pairs of places that begin a run are held, so a text of one repeated word against an item of the
    same is as many rows as the two have words, not their product.
    """
    ids = {s: i for i, s in enumerate(doc)}

    def by_place(places: dict[int, np.ndarray], none: int) -> np.ndarray:
        """Seed number at every place from -1 to one past the last; ``none`` where there is no shared one."""
        row = np.full(2 + max((int(places[s][-1]) + 1 for s in ids), default=0), none, np.int64)
        for s, i in ids.items():
            row[np.asarray(places[s]) + 1] = i
        return row

    d, t = by_place(doc, -1), by_place(item, -2)
    known = list(doc)
    starts = []
    for b in np.flatnonzero(t >= 0):  # place in the item, plus one
        a = np.asarray(doc[known[t[b]]], np.int64) + 1
        a = a[d[a - 1] != t[b - 1]]
        starts.append((a, np.full(len(a), b)))
    p, q = (np.concatenate([x[k] for x in starts] or [np.zeros(0, np.int64)]) for k in (0, 1))
    sizes, alive, n = np.ones(len(p), np.int64), np.arange(len(p)), 1
    while len(alive):
        alive = alive[d[p[alive] + n] == t[q[alive] + n]]
        sizes[alive] += 1
        n += 1
    return p - 1, q - 1, sizes


def tiles(doc: dict[int, np.ndarray], item: dict[int, np.ndarray], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling ``(doc start, item start, words)`` from the places of the seeds that both hold.

    Longest first; ties go to the earlier place in the item, then in the document.
    """
    p, q, sizes = _matches({s: doc[s] for s in item if s in doc}, item)
    sizes += width - 1
    heap = [(-int(n), int(b), int(a)) for a, b, n in zip(p, q, sizes, strict=True)]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item: set[int] = set()
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if a + k not in used_doc and b + k not in used_item]
        if len(free) == n:
            used_doc.update(range(a, a + n))
            used_item.update(range(b, b + n))
            out.append((a, b, n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, b + free[start], a + free[start]))
                start = k
    return out


def item_seeds(bench: DataFrame, width: int) -> DataFrame:
    """``item_key, item_id, words, width, seed, item_at``: seeds of each item; shorter items are one seed of their own width."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for key, item_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = _hashes(text, known)
                if len(h):
                    w = min(width, len(h))
                    rows += [(key, item_id, len(h), w, s, at) for s, at in zip(*_places(_runs(h, w)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            names = ["item_key", "item_id", "words", "width", "seed", "item_at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    bench = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return (
        bench.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text")
        .distinct()
        .mapInArrow(seeded, "item_key long, item_id long, words int, width int, seed long, item_at array<int>")
    )


def contaminated(docs: DataFrame, bench: DataFrame, width: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, row_key, words, covered, tiles, coverage`` for every document and item at or above ``coverage``.

    Words are runs of letters, digits and underscores, without regard to case. Items of fewer
    than ``width`` words must occur whole; items without words, and NULL or empty texts, match
    nothing. Items that share a NULL or equal id count as different where their texts differ.
    Repeated document rows give one result; a NULL doc_id is kept as it is. Other columns are
    ignored.
    """
    items = stored(item_seeds(bench, width), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    bits = bit_filter(items, F.col("seed"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = _hashes(text.as_py(), known)
                for w in widths:
                    runs = _runs(h, w)
                    at = np.flatnonzero(passes(bits, runs))
                    rows += [(doc_id, key, s, at[k]) for s, k in zip(*_places(runs[at]), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "row_key", "seed", "doc_at"]
            )

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, (defaultdict(dict), defaultdict(dict))

        def result() -> list[tuple]:
            doc_id, key, _, item_id, words, w = held
            marks = tiles(*of, w)
            n = sum(m[2] for m in marks)
            return [(doc_id, item_id, key, words, n, len(marks), n / words)] if n >= coverage * words else []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            names = ["doc_id", "item_id", "row_key", "words", "covered", "tiles", "coverage"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            names = ("doc_id", "row_key", "item_key", "item_id", "words", "width")
            keys = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            for key, s, a, b in zip(keys, batch.column("seed").to_pylist(), batch.column("doc_at"), batch.column("item_at"), strict=True):
                if key != held:
                    if held:
                        rows += result()
                    held, of = key, ({}, {})
                of[0][s], of[1][s] = (x.values.to_numpy() for x in (a, b))
            yield packed(rows)
        if held:
            yield packed(result())

    hits = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string")
    ).mapInArrow(found, "doc_id long, row_key long, seed long, doc_at array<int>")
    return (
        hits.join(items, "seed")
        .repartition("row_key", "item_key")
        .sortWithinPartitions("row_key", "doc_id", "item_key")
        .select("doc_id", "row_key", "item_key", "item_id", "words", "width", "seed", "doc_at", "item_at")
        .mapInArrow(tiled, "doc_id long, item_id long, row_key long, words int, covered int, tiles int, coverage double")
    )


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    bad = contaminated(docs, bench, width, coverage).select(F.col("row_key").alias("_decontamination_row")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.withColumn("_decontamination_row", key).join(bad, "_decontamination_row", "left_anti").drop("_decontamination_row")
