"""Best-fit packing of tokenized documents, improved by a swap-based local search.

Tokenizing, ranking and placing run as Spark jobs. What a plan of bins depends on is only how
many pieces there are of each length, so the packing works on that histogram, whose size is the
sequence limit whatever the corpus: bins with the same contents form one class with a count.
Best fit decreasing fills classes in bulk, then the search exchanges pieces between underfull
classes (one for one, two for one, or a plain move), every step raising the squared fill, until
none helps. Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stored

LIMIT = 2048
VOCABULARY = "byte_bpe_50k"
WORDS_KEPT = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: White space beside blank and line end; texts with any of it are encoded in one go.
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, by a public byte-level vocabulary.

    Such a vocabulary never joins characters across a blank or line end that stands alone
    between words, so words are encoded once and then looked up. Texts with longer white space
    go through the encoder whole; texts with the end marker in them through ``tokenizers``,
    which reads it as one id. Equal to ``tokenizers`` on whole texts (see the tests).
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.json = public_tokenizers.path(f"{vocabulary}.json")
        self.whole = None
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.line_end = self._ids("\n")

    def _ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if (
            "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or text[0] in " \n"
            or text[-1] in " \n"
            or any(c in text for c in _RARE_SPACE)
        ):
            return self._ids(text)
        if len(self.first) + len(self.later) > WORDS_KEPT:
            self.first.clear()
            self.later.clear()
        first, later, out = self.first, self.later, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            if (ids := first.get(head)) is None:
                ids = first[head] = self._ids(head)
            out.append(ids)
            try:
                out.extend([later[w] for w in rest])
            except KeyError:
                for w in rest:
                    if w not in later:
                        later[w] = self._ids(" " + w)
                out.extend([later[w] for w in rest])
            out.append(self.line_end)
        out.pop()
        return b"".join(out)


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for every document.

    A document is its ids and a closing id 0; only longer ones than ``limit`` are cut, and then
    the first piece takes what does not fill a whole one. NULL or empty text: the closing id
    alone. Repeated rows are packed as often as they occur.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + b"\0\0\0\0"
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = limit if (n - at) % limit == 0 else (n - at) % limit
                    rows.append((doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


Bin = tuple[tuple[int, int], ...]  # (length, copies), longest first


def _fill(b: Bin) -> int:
    return sum(n * k for n, k in b)


def _changed(b: Bin, out: tuple[int, ...], into: tuple[int, ...]) -> Bin:
    c = Counter(dict(b))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((n, k) for n, k in c.items() if k), reverse=True))


def best_fit(lengths: dict[int, int], limit: int) -> Counter:
    """Best fit decreasing over a histogram: bins as classes of equal contents with their counts."""
    open_: dict[int, Counter] = defaultdict(Counter)  # room left: bins
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        while left:
            i = bisect_left(rooms, n)
            room = rooms[i] if i < len(rooms) else limit
            b, have = next(iter(open_[room].items())) if i < len(rooms) else ((), left)
            each = min(room // n, left)
            many = min(have, left // each)
            left -= each * many
            if i < len(rooms):
                open_[room][b] -= many
                if not open_[room][b]:
                    del open_[room][b]
                if not open_[room]:
                    rooms.pop(i)
            after = room - each * n
            if not open_[after]:
                insort(rooms, after)
            open_[after][_changed(b, (), (n,) * each)] += many
    return Counter({b: m for bins in open_.values() for b, m in bins.items() if m})


def _exchange(a: Bin, b: Bin, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What goes from ``a`` to ``b`` and back so that ``b`` gains most within its room."""
    best, gain = None, 0
    ones = [n for n, _ in a]
    back = [n for n, _ in b]
    pairs = [(x, y) for i, (x, k) in enumerate(a) for y, _ in a[i if k > 1 else i + 1 :]]
    pairs_back = [(x, y) for i, (x, k) in enumerate(b) for y, _ in b[i if k > 1 else i + 1 :]]
    for out, into in (
        *(((x,), ()) for x in ones),
        *(((x,), (y,)) for x in ones for y in back),
        *(((x,), p) for x in ones for p in pairs_back),
        *((p, (y,)) for p in pairs for y in back),
    ):
        d = sum(out) - sum(into)
        if gain < d <= room:
            best, gain = (out, into), d
    return best


def _sums(b: Bin) -> tuple[list[int], list[int]]:
    """Lengths of a class, and sums of two of its pieces."""
    twos = {x + y for i, (x, k) in enumerate(b) for y, _ in b[i if k > 1 else i + 1 :]}
    return [x for x, _ in b], sorted(twos)


class _Underfull:
    """Classes with room, and by class what it can give back that is nearest below a length.

    An exchange that brings ``x`` to a class raises its fill within its room just when the largest
    return below ``x`` leaves no more than the room, so one row of the table tests all classes.
    """

    def __init__(self, limit: int):
        self.limit, self.clock = limit, 0
        self.place: dict[Bin, int] = {}
        self.classes: list[Bin] = []
        self.free: list[int] = []
        self.tried: dict[Bin, int] = {}  # until when a class has been tried against all others
        self.fill, self.born = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.below = np.zeros((2, limit + 2, 0), np.int16 if limit < 1 << 14 else np.int32)

    def grow(self, b: Bin) -> None:
        """A class comes to be, or has more bins than before."""
        self.clock += 1
        if b not in self.place:
            if not self.free:
                n = len(self.classes)
                self.free = list(range(n, 2 * n + 64))
                more = n + 64
                self.classes += [()] * more
                self.fill, self.born = (np.r_[c, np.full(more, -1)] for c in (self.fill, self.born))
                self.below = np.concatenate([self.below, np.zeros((*self.below.shape[:2], more), self.below.dtype)], 2)
            i = self.place[b] = self.free.pop()
            self.classes[i], self.fill[i] = b, _fill(b)
            ones, twos = _sums(b)
            for table, sums in enumerate(([0, *ones, *twos], ones)):
                column = np.full(self.limit + 2, -self.limit - 1)
                column[np.array(sums) + 1] = sums
                self.below[table, :, i] = np.maximum.accumulate(column)
        self.born[self.place[b]] = self.clock

    def drop(self, b: Bin) -> None:
        i = self.place.pop(b)
        self.fill[i] = -1
        self.free.append(i)
        self.tried.pop(b, None)

    def taker(self, giver: Bin, alone: bool) -> Bin | None:
        """The class nearest in fill that can take from ``giver``, among those it was not tried against."""
        ok = (self.fill >= _fill(giver)) & (self.born > self.tried.get(giver, 0))
        if alone:
            ok[self.place[giver]] = False
        at = np.flatnonzero(ok)
        room, hit = self.limit - self.fill[at], np.zeros(len(at), bool)
        for table, sums in enumerate(_sums(giver)) if len(at) else ():
            for x in sums:
                hit |= self.below[table, x, at] >= x - room
        at = at[hit]
        if len(at):
            return self.classes[at[np.argmin(self.fill[at])]]
        self.tried[giver] = self.clock
        return None


def improve(bins: Counter, limit: int) -> Counter:
    """Exchange pieces between underfull classes while the squared fill rises.

    Rounds go over the classes, emptiest first; each gives to the class nearest to it in fill as long as
    one can take. A class that fitted nowhere is tried again only against classes that are new since, or
    have more bins. The search ends when no class can give, or when no packing has fewer bins.
    """
    bins = Counter(bins)
    least = -(-sum(_fill(b) * k for b, k in bins.items()) // limit)
    count, moved, pool = sum(bins.values()), True, _Underfull(limit)
    for b in sorted(bins):
        if count > least and _fill(b) < limit:
            pool.grow(b)
    while moved and count > least:
        moved = False
        for giver in sorted(pool.place, key=lambda b: (_fill(b), b)):
            while count > least and bins[giver] and (taker := pool.taker(giver, bins[giver] < 2)):
                moved = True
                out, into = _exchange(giver, taker, limit - _fill(taker))
                many = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
                after = _changed(giver, out, into), _changed(taker, into, out)
                count -= 0 if after[0] else many
                for b, c in ((giver, -many), (taker, -many), (after[0], many), (after[1], many)):
                    if b:
                        bins[b] += c
                        if c > 0 and _fill(b) < limit:
                            pool.grow(b)
                        elif not bins[b]:
                            del bins[b]
                            pool.drop(b)
    return bins


def _slots(bins: Counter) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first bin, copies per bin, offset in the bin, for each class that holds it."""
    rank: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    first = 0
    for b, many in sorted(bins.items()):
        at = 0
        for n, k in b:
            rows[n].append((rank[n], first, k, at))
            rank[n] += k * many
            at += n * k
        first += many
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """``rank`` from 0 among the pieces of a length; a frequent length is split by a salt of the piece."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    d = cut.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = d.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    return d.join(offsets, ["length", "salt"]).withColumn("rank", F.col("first") + within - 1).drop("salt", "first")


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it, gapless from 0.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    cut = stored(pieces(docs, limit, vocabulary), "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(improve(best_fit(lengths, limit), limit))
    salts = min(4096, max(64, sum(lengths.values()) // 50_000))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                start, first, each, offset = slots[int(size)]
                k = np.searchsorted(start, rank[rows], "right") - 1
                t = rank[rows] - start[k]
                seq[rows] = first[k] + t // each[k]
                at[rows] = offset[k] + t % each[k] * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(seq), pa.array(at)], [*names, "sequence_id", "offset"]
            )

    return ranked(cut, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)
