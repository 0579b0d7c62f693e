"""Hard negatives of anchors, from score slots that all windows of an anchor share.

A positive of score ``p`` asks for the best rows of another label with a score from ``low`` to
``high`` hundredths of ``p``. The upper limits of an anchor's positives cut the scores into disjoint
slots; each block of rows keeps its best ``k`` per slot, and blocks are merged slot by slot. A
window's answer is then the first ``k`` of its own slot and the slots below, merged in descending
order and cut at its lower limit. So windows that overlap are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.integer_vectors import first, in_blocks, inner, integer_vectors, matrix
from corpuslens.session import discard, stored

#: Anchors whose scores are in memory at once.
AT_ONCE = 64


def _scores(asked: pa.Table, stripe: pa.Table, dim: int):
    """For each anchor of the block: its place, and its scores with the rows of the stripe."""
    x, y = matrix(asked["x"], dim), matrix(stripe["x"], dim)
    for a in range(0, len(x) if len(y) else 0, AT_ONCE):
        for i, score in enumerate(inner(x[a : a + AT_ONCE], y)):
            yield a + i, score


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    """``rows`` of (number, arrays of equal length); the number is repeated."""
    columns = [np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*((np.full(len(r[1]), r[0]), *r[1:]) for r in rows), strict=True)]
    return pa.Table.from_arrays([pa.array(c) for c in columns or [np.empty(0, np.int64)] * len(names)], names)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, label: str = "label"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding`` and a label column; components become ``floor(scale * x)`` and
    scores are integer inner products with the anchor, higher first, equal ones by the smaller id.
    An anchor's positives are its first ``positives`` other rows of its label; for each, the first ``k``
    rows of other labels with ``low * p <= 100 * score <= high * p`` are returned, or all if fewer. A
    negative ``p`` has no such rows. A NULL label takes no part; for other rows that do not, and rows of
    equal ids, see ``integer_vectors``. An empty table gives no rows. Other columns are not looked at.
    """
    if not 0 <= low < high:
        raise ValueError("limits must satisfy 0 <= low < high")
    own, dim = integer_vectors(vectors, is_anchor, scale, max(k, positives + 1), F.col(label))
    entries = own.where(F.col("copy") <= max(k, positives + 1)).select("vec_id", "x", "label")
    anchors = own.where("q").select("vec_id", "x", "label")

    def alike(asked: pa.Table, stripe: pa.Table) -> pa.Table:
        """The stripe's best rows of the anchor's label."""
        name, names = (t["label"].to_numpy() for t in (asked, stripe))
        query, ids = asked["vec_id"].to_numpy(), stripe["vec_id"].to_numpy()
        rows = []
        for i, score in _scores(asked, stripe, dim):
            at = np.flatnonzero((names == name[i]) & (ids != query[i]))
            at = at[first(score[at], ids[at], positives)]
            rows.append((query[i], ids[at], score[at]))
        return _table(rows, ["anchor_id", "positive_id", "positive_score"])

    found = in_blocks(anchors, entries, alike, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).where("positive_score >= 0")
    windows = stored(
        found.select(
            "anchor_id", "positive_id", "positive_score",
            F.expr(f"positive_score div 100 * {high} + (positive_score % 100) * {high} div 100").alias("top"),
            F.expr(f"positive_score div 100 * {low} + ((positive_score % 100) * {low} + 99) div 100").alias("bottom"),
        ),
        "negative-windows",
    )
    limits = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("top")).alias("tops"), F.min("bottom").alias("bottom"))

    def slotted(asked: pa.Table, stripe: pa.Table) -> pa.Table:
        """The stripe's best rows of other labels in each slot of the anchor; a slot is named by its upper limit."""
        name, names = (t["label"].to_numpy() for t in (asked, stripe))
        query, ids = asked["vec_id"].to_numpy(), stripe["vec_id"].to_numpy()
        tops, bottom = asked["tops"].to_pylist(), asked["bottom"].to_numpy()
        rows = []
        for i, score in _scores(asked, stripe, dim):
            top = np.array(tops[i], np.int64)
            at = np.flatnonzero((names != name[i]) & (score >= bottom[i]) & (score <= top[-1]))
            slot = np.searchsorted(top, score[at])
            for s in range(len(top)):
                inside = at[slot == s]
                inside = inside[first(score[inside], ids[inside], k)]
                rows.append((query[i], np.full(len(inside), top[s]), ids[inside], score[inside]))
        return _table(rows, ["anchor_id", "slot", "negative_id", "negative_score"])

    slots = in_blocks(anchors.join(limits, "vec_id"), entries, slotted, "anchor_id long, slot long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    slots = slots.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    # at most positives x positives x k rows of an anchor
    merged = windows.join(slots, "anchor_id").where("slot <= top")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    merged = merged.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("negative_score") >= F.col("bottom")))
    out = stored(merged.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    discard(own, windows)
    return out
