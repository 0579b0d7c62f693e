"""Repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

Two places hold the same window exactly if their suffixes agree over the window's length, so
suffixes are refined digit by digit only to that depth, and groups of one fall out after each
pass. A digit is a slice of bytes around the window's anchor, its leftmost least gram: equal
windows have equal anchors at equal offsets, and neighbouring windows mostly share one.

1. the anchor's gram;
2. all bytes of the windows that share an anchor: where these occur again, all the windows do;
3. of the rest, a slice that a quarter of an anchor's windows have in common;
4. the windows themselves.

Each pass counts keys with map-side sums and joins the counts back, so a gram that stands in
every document is no larger a task than others. Keys are 64-bit hashes of the slice, together
with that of the gram; equal strings always meet, and different ones only if both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import bit_filter, mixed, passes
from corpuslens.llm.windows import STRETCH, Rolling, anchors
from corpuslens.session import discard, stored

WIDTH = 200
GRAM = 64
#: Slices of the third pass per anchor.
PARTS = 4


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("binary"))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchored(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``row_key, at, gram, bytes``: anchors of all windows.

    ``at`` holds first window start, windows less one, and the anchor's offset in the first;
    ``bytes`` is the hash of everything those windows cover.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for key, text in zip(_column(batch, "row_key"), batch.column("text"), strict=True):
                whole = np.frombuffer(text.as_buffer(), np.uint8)
                for base in range(0, len(whole) - width + 1, STRETCH - width + 1):
                    part = whole[base : base + STRETCH]
                    rolling = Rolling(part)
                    grams = rolling.grams(gram)
                    p, first, last = anchors(grams, width - gram + 1)
                    at = (first + base << 16) | (last - first << 8) | (p - first)
                    out.append((np.full(len(p), key), at, grams[p].view(np.int64), rolling.of(first, last + width).view(np.int64)))
                if len(out) >= 2000:
                    yield packed(out)
                    out = []
            yield packed(out)

    def packed(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_key", "at", "gram", "bytes"])

    return docs.select("row_key", "text").mapInArrow(found, "row_key long, at long, gram long, bytes long")


def _surroundings(docs: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """``row_key, at, gram, slice``: the bytes that the windows of each active anchor cover."""
    bits = bit_filter(active, F.col("row_key"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, _column(batch, "row_key"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, places in zip(batch.column("row_key"), batch.column("text"), batch.column("places"), strict=True):
                whole = memoryview(text.as_buffer())
                at, gram = (places.values.field(i).to_numpy() for i in (0, 1))
                first, more = at >> 16, at >> 8 & 255
                slices = [bytes(whole[s : s + n + width]) for s, n in zip(first.tolist(), more.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), key.as_py())), pa.array(at), pa.array(gram), pa.array(slices, pa.binary())],
                    ["row_key", "at", "gram", "slice"],
                )

    texts = docs.select("row_key", "text").mapInArrow(wanted, "row_key long, text binary")
    lists = active.groupBy("row_key").agg(F.collect_list(F.struct("at", "gram")).alias("places"))
    return texts.join(lists, "row_key").mapInArrow(cut, "row_key long, at long, gram long, slice binary")


def _slices(batch: pa.RecordBatch, low: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes over some rows' slices, where each begins, and anchor offsets of first and last window."""
    part = batch.slice(low, 2000)
    texts = part.column("slice").to_pylist()
    start = np.cumsum([0, *map(len, texts)])[:-1]
    at = _column(part, "at")
    high = at & 255
    return Rolling(np.frombuffer(b"".join(texts), np.uint8)), start, high - (at >> 8 & 255), high, _column(part, "gram").view(np.uint64)


def _parts(active: DataFrame, width: int, gram: int) -> DataFrame:
    """``row_key, at, part, key``: for each quarter of offsets that an anchor's windows have, the bytes they share."""
    step = (width - gram) // PARTS

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                rolling, start, least, most, grams = _slices(batch, low)
                for k in range(PARTS):
                    end = step * (k + 1) - 1 if k + 1 < PARTS else width - gram
                    rows = np.flatnonzero((least <= end) & (most >= step * k))
                    s = start[rows] + most[rows] - step * k
                    shared = gram + width - gram - (end + 1 if k + 1 < PARTS else end) + step * k
                    key = mixed(rolling.of(s, s + shared) ^ mixed(grams[rows] + np.uint64(k)))
                    part = batch.slice(low, 2000).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row_key"), part.column("at"), pa.array(np.full(len(rows), k, np.int32)), _signed(key)],
                        ["row_key", "at", "part", "key"],
                    )

    return active.mapInArrow(keys, "row_key long, at long, part int, key long")


def _windows(active: DataFrame, width: int, gram: int) -> DataFrame:
    """``row_key, start, gram, key`` for every window in the parts listed."""
    step = (width - gram) // PARTS

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                rolling, start, least, most, grams = _slices(batch, low)
                part = batch.slice(low, 2000)
                k, row, first = (_column(part, c) for c in ("part", "row_key", "at"))
                begin = np.maximum(least, step * k)
                end = np.minimum(most, np.where(k + 1 < PARTS, step * (k + 1) - 1, width - gram))
                n = np.maximum(end - begin + 1, 0)
                rows = np.repeat(np.arange(len(k)), n)
                offset = begin[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                s = start[rows] + most[rows] - offset
                key = mixed(rolling.of(s, s + width) ^ offset.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[rows]), pa.array((first[rows] >> 16) + most[rows] - offset), _signed(grams[rows]), _signed(key)],
                    ["row_key", "start", "gram", "key"],
                )

    return active.mapInArrow(keys, "row_key long, start long, gram long, key long")


def _covered(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``row_key, ranges``: starts and ends of all repeated windows per document, overlapping freely."""
    occurring = stored(anchored(docs, width, gram), "anchors")
    often = occurring.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    often = stored(often, "grams")
    bits = bit_filter(often, F.col("gram"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, _column(batch, "gram"))))

    hits = stored(occurring.mapInArrow(likely, occurring.schema).join(often, "gram"), "hits")
    discard(occurring, often)
    same = (
        hits.groupBy("gram", "bytes")
        .agg(F.count("*").alias("n"), F.min(F.struct("row_key", "at")).alias("one"))
        .where("n > 1")
        .select("gram", "bytes", "one")
    )
    # of each group of equal bytes one stands for all in what follows
    first = F.col("one").isNull() | ((F.col("one.row_key") == F.col("row_key")) & (F.col("one.at") == F.col("at")))
    marked = hits.join(same, ["gram", "bytes"], "left").select(
        "row_key", "at", F.when(first, F.col("gram")).alias("gram"), F.col("one").isNotNull().alias("again")
    )
    marked = stored(marked, "marked")
    discard(hits)
    active = stored(marked.where("gram IS NOT NULL").select("row_key", "at", "gram").distinct(), "active")
    around = stored(_surroundings(docs, active, width), "slices")
    parts = stored(_parts(around, width, gram), "parts")
    met = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    left = parts.join(met, "key").select("row_key", "at", "part").distinct()
    windows = stored(_windows(around.join(left, ["row_key", "at"]), width, gram), "windows")
    discard(active, around, parts)
    again = windows.groupBy("gram", "key").agg(F.count("*").alias("n")).where("n > 1").select("gram", "key")
    single = windows.join(again, ["gram", "key"]).select("row_key", F.col("start").alias("s"), (F.col("start") + width).alias("e"))
    start = F.shiftright("at", 16)
    whole = marked.where("again").select(
        "row_key", start.alias("s"), (start + F.shiftright("at", 8).bitwiseAND(255) + width).alias("e")
    )
    ranges = whole.unionByName(single).groupBy("row_key").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    covered = stored(ranges, "covered")
    discard(marked, windows)
    return covered


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per document row.

    ``spans`` are the maximal runs ``(s, e)`` of bytes under windows of ``width`` bytes that
    start anywhere else too, in another document or the same one, overlaps included; ``kept`` is
    what is left, as bytes, for a cut may fall inside a character. NULL texts are empty ones.
    Of repeated rows each counts as a place of its own. Other columns are ignored.
    """
    docs = _keyed(docs)
    covered = _covered(docs, width, gram)
    bits = bit_filter(covered, F.col("row_key"))
    schema = "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary"
    ends = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def result(doc_id: list, size: list[int], spans: list, kept: list[bytes]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), ends, pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip((doc_id, size, spans, kept), types, strict=True)], ["doc_id", "n_bytes", "spans", "kept"]
        )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~passes(bits, _column(batch, "row_key"))))
            texts = rest.column("text")
            yield pa.RecordBatch.from_arrays(
                [rest.column("doc_id"), pa.array([len(t.as_buffer()) for t in texts], pa.int64()), pa.array([[]] * len(texts), ends), texts],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, _column(batch, "row_key"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges"), strict=True):
                whole, runs = text.as_py(), []
                if ranges.is_valid:
                    s, e = (ranges.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    runs = list(zip(s[new].tolist(), e[np.r_[new[1:], len(s)] - 1].tolist(), strict=True))
                edges = [0, *(x for run in runs for x in run), len(whole)]
                kept = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, len(whole), [{"s": a, "e": b} for a, b in runs], kept))
            if rows:
                yield result(*map(list, zip(*rows, strict=True)))

    named = "doc_id long, row_key long, text binary"
    some = docs.mapInArrow(touched, named).join(covered, "row_key", "left").select("doc_id", "text", "ranges")
    return docs.mapInArrow(untouched, schema).unionByName(some.mapInArrow(cut, schema))
