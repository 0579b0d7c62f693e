"""Near-duplicate documents by MinHash signatures in an LSH forest.

Each document becomes the set of its distinct word shingles, documents with equal sets become
one node, and each node gets a signature of minimum hashes. Every tree of the forest orders the
nodes by its own part of the signature. In this order a node's candidate is the head of the
longest prefix that it shares with others, so the candidates of a tree are never more than its
nodes; the best candidate of each node is confirmed on the full sets, which links the large
groups. What is left are regions, prefixes that hold nodes of several groups: there signatures
are compared across groups, in blocks, and groups that may be linked form clusters. In a cluster
the full sets are compared across groups, again in blocks, so no pair is ever written out. A region
is as shallow as its crowd allows: two values, beyond ``CROWD[0]`` nodes three, beyond
``CROWD[1]`` four. Two sets of similarity 0.80 meet in no tree with a chance of 1e-9, 6e-7 and
3e-5 at these depths, of 0.85 with 7e-12, 5e-9 and 4e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WordHashes, bit_filter, mixed, passes
from corpuslens.llm.components import components
from corpuslens.session import discard, stored

TREES = 20
VALUES = 6
DEPTHS = (6, 4, 3, 2)
CROWD = (256, 8192)
#: Nodes per side of a block in which signatures are compared, shingles where sets are.
BLOCK = 2000
LOAD = 1_500_000
#: Documents that one copy of a head's text is compared with.
FAN = 256
#: How far below the bar the estimate of a true link may lie; over four deviations at 120 values and a bar of 0.8.
SLACK = 0.15

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1 << 62, 1 << 63, TREES * VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; words end at ASCII white space, A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < width:
        whole = np.array([len(words)], np.uint64)
        for k in range(len(h)):
            whole = mixed(whole * _STEP ^ h[k : k + 1])
        return whole
    s = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        s = mixed(s * _STEP + h[k : len(h) - width + 1 + k])
    return np.unique(s)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signature(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(s), 2048):
            np.minimum(out, (_FACTORS[:, None] * s[None, low : low + 2048]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _row_key():
    return F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, row_key, n, digest, values, brief`` per document; ``brief`` has a byte of each value."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digest, values, brief = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py() or b"", hashes, width)
                v = _signature(s) if len(s) else np.zeros(0, np.uint32)
                n.append(len(s))
                digest.append(set_digest(s) if len(s) else None)
                values.append(v.astype(">u4").tobytes())
                brief.append((v & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, values, brief))],
                ["doc_id", "row_key", "n", "digest", "values", "brief"],
            )

    return docs.select("doc_id", _row_key(), F.col("text").cast("binary")).mapInArrow(
        signed, "doc_id long, row_key long, n long, digest binary, values binary, brief binary"
    )


def forest(nodes: DataFrame) -> DataFrame:
    """``node, k8, k4, k3, k2, region`` for each tree in which a node shares at least two values with another."""
    trees = nodes.select("digest", "values", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keys = trees.select(
        F.col("digest").alias("node"),
        *(F.expr(f"xxhash64(tree, substring(values, tree * {4 * VALUES} + 1, {4 * d}))").alias(f"k{d}") for d in DEPTHS),
    )
    shared = keys.groupBy("k2").agg(F.count("*").alias("n2")).where("n2 > 1")
    rows = stored(keys.join(shared, "k2"), "forest")
    crowded = rows.where(f"n2 > {CROWD[0]}").groupBy("k3").agg(F.count("*").alias("n3"))
    return rows.join(crowded, "k3", "left").select(
        "node",
        *(f"k{d}" for d in DEPTHS),
        F.when(F.col("n2") <= CROWD[0], F.col("k2")).when(F.col("n3") <= CROWD[1], F.col("k3")).otherwise(F.col("k4")).alias("region"),
    )


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct ``(node, head)``: the head of the longest prefix that a node shares in a tree."""
    out, left = None, rows.select("node", *(f"k{d}" for d in DEPTHS))
    for d in DEPTHS:
        key = f"k{d}"
        heads = left.groupBy(key).agg(F.min("node").alias("head"))
        both = left.join(heads, key)
        found = both.where("node <> head").select("node", "head")
        out = found if out is None else out.unionByName(found)
        left = both.where("node = head").drop("head", key)
    return out.distinct()


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    return (x == y).mean(axis=1)


def estimated(pairs: DataFrame, nodes: DataFrame, bar: float) -> DataFrame:
    """``(node, head, likeness)`` of the pairs whose signatures agree in at least ``bar``."""
    brief = nodes.select("digest", "brief")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _agreement(batch.column(2), batch.column(3))
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], ["node", "head", "likeness"])
                yield out.filter(pa.array(like >= bar))

    return (
        pairs.join(brief.select(F.col("digest").alias("node"), F.col("brief").alias("x")), "node")
        .join(brief.select(F.col("digest").alias("head"), F.col("brief").alias("y")), "head")
        .select("node", "head", "x", "y")
        .mapInArrow(compare, "node binary, head binary, likeness double")
    )


def _dealt(members: DataFrame, key: str, weight: Column, room: int) -> DataFrame:
    """``members (key, node, group)`` of keys with several groups, dealt to blocks ``(key, b, o)``.

    The key's main group is not compared within itself: ``part`` 1, all nodes of other groups,
    meets ``part`` 0, all nodes, each side being split so that a block's part holds about ``room``.
    """
    weighed = members.withColumn("w", weight)
    per = weighed.groupBy(key, "group").agg(F.sum("w").alias("w"))
    several = (
        per.groupBy(key)
        .agg(F.count("*").alias("n"), F.sum("w").alias("all"), F.max_by("group", F.struct("w", "group")).alias("main"), F.max("w").alias("most"))
        .where("n > 1")
        .select(key, "main", F.ceil(F.col("all") / room).alias("bs"), F.ceil((F.col("all") - F.col("most")) / room).alias("os"))
    )
    both, side, zero = members.join(several, key), F.xxhash64("node"), F.lit(0).cast("long")
    wide = both.withColumn("part", F.lit(0)).withColumn("b", F.pmod(side, F.col("bs"))).withColumn("o", F.explode(F.sequence(zero, F.col("os") - 1)))
    narrow = both.where("`group` <> main").withColumn("part", F.lit(1)).withColumn("o", F.pmod(side, F.col("os"))).withColumn("b", F.explode(F.sequence(zero, F.col("bs") - 1)))
    return wide.unionByName(narrow).drop("main", "bs", "os")


class _Labels:
    """Groups seen in a block, united as links are found; keeps the links that unite."""

    def __init__(self, groups: list[bytes]):
        self.names, self.label = np.unique(np.array(groups, object), return_inverse=True)
        self.label = self.label.copy()
        self.links: list[tuple[int, int]] = []

    def unite(self, i: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.label[others], return_index=True)
        for label, at in zip(labels, first, strict=True):
            if label != self.label[i]:
                self.links.append((i, int(others[at])))
                self.label[self.label == label] = self.label[i]


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of one block after the other; the last ``keys`` columns name the block."""
    held, block = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[-keys:] != block:
                if held:
                    yield held
                held, block = [], row[-keys:]
            held.append(row)
    if held:
        yield held


def suspected(rows: DataFrame, groups: DataFrame, nodes: DataFrame, bar: float) -> DataFrame:
    """``(a, b)``: groups that hold nodes of one region with likely equal signatures; chains stand for crowds."""
    placed = rows.select("region", "node").distinct().join(groups, "node", "left")
    placed = placed.select("region", "node", F.coalesce("component", "node").alias("group"))
    dealt = _dealt(placed, "region", F.lit(1), BLOCK).join(nodes.select(F.col("digest").alias("node"), "brief"), "node")
    dealt = dealt.select("group", "brief", "part", "region", "b", "o").repartition("region", "b", "o").sortWithinPartitions("region", "b", "o")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, 3):
            labels = _Labels([r[0] for r in held])
            brief = np.frombuffer(b"".join(r[1] for r in held), np.uint8).reshape(len(held), -1)
            part = np.array([r[2] for r in held])
            wide = np.flatnonzero(part == 0)
            for i in np.flatnonzero(part == 1):
                far = wide[labels.label[wide] != labels.label[i]]
                labels.unite(i, far[(brief[far] == brief[i]).mean(axis=1) >= bar])
            ends = [(held[i][0], held[j][0]) for i, j in labels.links]
            got = list(zip(*ends, strict=True)) if ends else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary())], ["a", "b"])

    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def _texts(docs: DataFrame, routes: DataFrame) -> DataFrame:
    """``routes`` with ``text``, one row of ``docs`` per ``row_key``; other texts are not shuffled."""
    bits = bit_filter(routes, F.col("row_key"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passes(bits, batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep))

    return routes.join(docs.select(_row_key(), F.col("text").cast("binary")).mapInArrow(wanted, "row_key long, text binary"), "row_key")


def across_groups(docs: DataFrame, nodes: DataFrame, groups: DataFrame, clusters: DataFrame, width: int, need: int) -> DataFrame:
    """``(a, b)``: groups of one cluster with a true link between them, by full sets; enough to join all that are linked."""
    member = nodes.select(F.col("digest").alias("node"), "row_key", "n").join(groups, "node", "left")
    member = member.select("node", "row_key", "n", F.coalesce("component", "node").alias("group"))
    member = member.join(clusters.select(F.col("node").alias("group"), F.col("component").alias("cluster")), "group")
    routes = stored(_dealt(member, "cluster", F.col("n"), LOAD), "routes")
    dealt = _texts(docs, routes).select("node", "group", "part", "text", "cluster", "b", "o")
    dealt = dealt.repartition("cluster", "b", "o").sortWithinPartitions("cluster", "b", "o")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def read(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t.as_py(), hashes, width) for t in batch.column("text")]
            right = [set_digest(s) == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)]
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            return batch.set_column(batch.schema.get_field_index("text"), "text", packed).filter(pa.array(right))

        for held in _blocks(map(read, batches), 3):
            labels = _Labels([r[1] for r in held])
            sets = [np.frombuffer(r[3], np.uint64) for r in held]
            size = np.array([len(x) for x in sets])
            part = np.array([r[2] for r in held])
            wide = np.flatnonzero(part == 0)
            if not len(wide) or len(wide) == len(held):
                continue
            # nodes that have a shingle, by shingle
            values = np.concatenate([sets[i] for i in wide])
            owner = np.repeat(wide, size[wide])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for i in np.flatnonzero(part == 1):
                low, high = (np.searchsorted(values, sets[i], side) for side in ("left", "right"))
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(held))
                linked = (100 * common >= need * (size[i] + size - common)) & (labels.label != labels.label[i])
                labels.unite(i, np.flatnonzero(linked & (part == 0)))
            ends = [(held[i][1], held[j][1]) for i, j in labels.links]
            got = list(zip(*ends, strict=True)) if ends else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary())], ["a", "b"])

    return stored(dealt.mapInArrow(compare, "a binary, b binary").distinct(), "links")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, need: int) -> DataFrame:
    """The pairs ``(node, head)`` with ``100 * intersection >= need * union`` on their full sets.

    One text per node is read again. A head's text travels once per ``FAN`` of its pairs.
    """
    pairs = stored(pairs.select("node", "head"), "pairs")
    fan = pairs.groupBy("head").agg(F.ceil(F.count("*") / FAN).alias("salts"))
    dealt = pairs.join(fan, "head").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    routes = (
        dealt.select("head", "salt", F.lit(1).alias("part"), "node")
        .unionByName(dealt.select("head", "salt", F.lit(0).alias("part"), F.col("head").alias("node")).distinct())
        .join(nodes.select(F.col("digest").alias("node"), "row_key"), "node")
    )
    together = (
        _texts(docs, stored(routes, "routes"))
        .select("head", "salt", "part", "node", "text")
        .repartition("head", "salt")
        .sortWithinPartitions("head", "salt", "part")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, place, known = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            for head, salt, part, node, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                head, node = head.as_py(), node.as_py()
                s = shingles(text.as_py(), hashes, width)
                if set_digest(s) != node:
                    continue  # another row with the same key
                if part.as_py() == 0:
                    place, known = (head, salt.as_py()), s
                elif place == (head, salt.as_py()):
                    small, large = (s, known) if len(s) < len(known) else (known, s)
                    at = np.searchsorted(large, small)
                    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * common >= need * (len(s) + len(known) - common):
                        links.append((node, head))
            got = list(zip(*links, strict=True)) if links else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary())], ["a", "b"])

    return stored(together.mapInArrow(compare, "a binary, b binary").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, need: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document row.

    Documents are linked where ``100 * intersection >= need * union`` of their distinct shingles
    of ``width`` words; ``component_id`` is the smallest id that links reach. Texts with fewer
    words are one shingle; NULL texts and texts without words have none and are linked with
    nothing. A row without an id takes part in links and is kept only where its component has no
    id at all. Repeated rows give repeated results. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bar = need / 100 - SLACK
    signed = stored(signatures(docs, width), "signatures")
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    nodes = stored(
        signed.where("n > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("row_key", "n", "values", "brief"), best).alias("s"))
        .select("digest", "doc_id", "s.*"),
        "nodes",
    )
    rows = stored(forest(nodes), "regions")
    likely = stored(estimated(neighbours(rows), nodes, bar), "neighbours")
    first = likely.groupBy("node").agg(F.max_by("head", F.struct("likeness", "head")).alias("head"))
    links = confirmed(docs, nodes, first, width, need)
    groups = components(links)
    member = nodes.select(F.col("digest").alias("node"), "doc_id").join(groups, "node", "left")
    member = member.select("node", "doc_id", F.coalesce("component", "node").alias("component"))

    edges = stored(suspected(rows, groups, nodes, bar), "suspected")
    used = [signed, nodes, rows, likely, links, groups, edges]
    if not edges.isEmpty():
        clusters = components(edges)
        more = across_groups(docs, nodes, groups, clusters, width, need)
        # only groups meet here, so their components are named once more and nothing is done twice
        joined = components(more)
        renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        member = member.join(renamed, "component", "left").select("node", "doc_id", F.coalesce("whole", "component").alias("component"))
        used += [clusters, more, joined]

    lowest = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = member.join(lowest, "component").select(F.col("node").alias("digest"), "component_id")
    out = stored(
        signed.select("doc_id", F.col("n").alias("n_shingles"), "digest")
        .join(ids, "digest", "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")),
        "near-duplicates",
    )
    discard(*(t for t in used if hasattr(t, "stored_path")))
    return out
