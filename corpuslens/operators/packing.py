"""Batches under a running token limit, for projects of any size.

Filling batches in order is sequential, yet a stretch of chunks acts on the
tokens carried into it as a short step function: only the first chunk that
overflows depends on what came in. So fixed blocks of files are summarised in
parallel, the summaries are chained twice (blocks into groups, groups into the
project), and every block is then replayed from its own entry value.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.constants import COMBINED_HARD_TOKENS, COMBINED_SOFT_TOKENS, SOFT_BATCH_TOKENS
from corpuslens.functions.grouped import fold_groups
from corpuslens.functions.ordered import numbered
from corpuslens.session import cut_lineage

FRESH = -1  # entry value of a project's first block: no batch is open yet

# A step: entry values from `lo` on give `value` (added to the entry when `add`) after `resets` new batches.
_STEP = "lo long, add boolean, value long, resets long"


def combined_limits(combined: bool, soft: int | None, hard: int | None) -> tuple[int | None, int | None]:
    """Token limits of a run; one combined call over all domains gets the tighter pair."""
    if not combined:
        return soft, hard
    return min(soft or COMBINED_SOFT_TOKENS, COMBINED_SOFT_TOKENS), min(hard or COMBINED_HARD_TOKENS, COMBINED_HARD_TOKENS)


def _starts(sizes: list[int], limit: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Prefix sums, and per position what a batch opened there leads to: (carry, resets)."""
    total = [0, *accumulate(sizes)]
    n = len(sizes)
    after = [(0, 0)] * (n + 1)
    for j in range(n - 1, -1, -1):
        nxt = max(j + 1, bisect_right(total, total[j] + limit) - 1)
        if nxt >= n:
            after[j] = (total[n] - total[j], 0)
        else:
            carry, resets = after[nxt]
            after[j] = (carry, resets + 1)
    return total, after


def _steps(sizes: list[int], limit: int) -> list[tuple]:
    total, after = _starts(sizes, limit)
    out = [(FRESH, False, *after[0])]
    if total[-1] <= limit:
        out.append((0, True, total[-1], 0))
    for j in range(len(sizes) - 1, -1, -1):
        lo, hi = limit - total[j + 1] + 1, limit - total[j]
        if hi >= max(lo, 0) or j == 0:
            carry, resets = after[j]
            out.append((max(lo, 0), False, carry, resets + 1))
    return out


def _apply(steps: list[tuple], entry: int) -> tuple[int, int]:
    if entry == FRESH:
        _, _, value, resets = steps[0]
        return value, resets
    i = bisect_right(steps, entry, lo=1, key=lambda s: s[0]) - 1
    _, add, value, resets = steps[i]
    return (entry + value if add else value), resets


def _chain(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """``second`` after ``first`` as one step function."""
    out = []
    for k, (lo, add, value, resets) in enumerate(first):
        if not add:
            v, r = _apply(second, value)
            out.append((lo, False, v, resets + r))
            continue
        hi = first[k + 1][0] - 1 if k + 1 < len(first) else None
        for lo2, add2, value2, resets2 in _cut(second, lo + value, None if hi is None else hi + value):
            out.append((lo2 - value, add2, value + value2 if add2 else value2, resets + resets2))
    return out


def _cut(steps: list[tuple], lo: int, hi: int | None) -> list[tuple]:
    """The steps valid on entry values ``lo..hi``."""
    body = steps[1:]
    i = max(0, bisect_right(body, lo, key=lambda s: s[0]) - 1)
    out = [(lo, *body[i][1:])]
    return out + [s for s in body[i + 1 :] if hi is None or s[0] <= hi]


def _tables(rows: list[tuple]) -> list[tuple[int, list[tuple]]]:
    """Rows ``(id, lo, add, value, resets)`` in order to one step table per id."""
    out: list[tuple[int, list[tuple]]] = []
    for ident, *step in rows:
        if not out or out[-1][0] != ident:
            out.append((ident, []))
        out[-1][1].append(tuple(step))
    return out


def pack_batches(
    chunks: DataFrame,
    limit: int = SOFT_BATCH_TOKENS,
    files_per_block: int = 2000,
    blocks_per_group: int = 256,
) -> DataFrame:
    """``batch_no`` per chunk: a new batch opens when the next chunk would exceed ``limit``.

    Needs ``(project_id, file_seq, chunk_seq, piece, token_count)``; only these travel. Blocks
    have equally many files however their numbers are spaced.
    """
    files = numbered(chunks.select("project_id", "file_seq").distinct(), ["project_id", "file_seq"], "no")
    items = cut_lineage(chunks.join(files, ["project_id", "file_seq"]).select(
        "project_id", F.floor(F.col("no") / files_per_block).cast("long").alias("blk"), "file_seq", "chunk_seq",
        "piece", F.col("token_count").cast("long").alias("size"),
    ))
    keys, order = ["project_id", "blk"], ["file_seq", "chunk_seq", "piece"]

    def summarise(_: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*_, *s) for s in _steps([r[-1] for r in rows], limit)]

    blocks = cut_lineage(fold_groups(items, keys, order, summarise, "project_id long, blk long, " + _STEP))
    grouped = blocks.select("project_id", F.floor(F.col("blk") / blocks_per_group).cast("long").alias("grp"), *blocks.columns[1:])

    def merge(key: tuple, rows: list[tuple]) -> list[tuple]:
        tables = _tables(rows)
        whole = tables[0][1]
        for _, t in tables[1:]:
            whole = _chain(whole, t)
        return [(*key, *s) for s in whole]

    groups = fold_groups(grouped, ["project_id", "grp"], ["blk", "lo"], merge, "project_id long, grp long, " + _STEP)

    def walk(key: tuple, rows: list[tuple]) -> list[tuple]:
        entry, batch, out = FRESH, 0, []
        for ident, table in _tables(rows):
            out.append((*key, ident, entry, batch))
            entry, resets = _apply(table, entry)
            batch += resets
        return out

    enter = fold_groups(groups, ["project_id"], ["grp", "lo"], walk, "project_id long, grp long, entry long, batch long")

    def descend(key: tuple, rows: list[tuple]) -> list[tuple]:
        entry, batch = rows[0][-2:]
        out = []
        for ident, table in _tables([r[:-2] for r in rows]):
            out.append((key[0], ident, entry, batch))
            entry, resets = _apply(table, entry)
            batch += resets
        return out

    starts = fold_groups(
        grouped.join(enter, ["project_id", "grp"]), ["project_id", "grp"], ["blk", "lo"], descend,
        "project_id long, blk long, entry long, batch long",
    )

    def number(key: tuple, rows: list[tuple]) -> list[tuple]:
        carry, batch = rows[0][-2:]
        out = []
        for f, c, p, size, *_ in rows:
            if carry != FRESH and carry + size > limit:
                carry, batch = 0, batch + 1
            carry = max(carry, 0) + size
            out.append((key[0], f, c, p, batch))
        return out

    batches = fold_groups(
        items.join(starts, keys), keys, order, number,
        "project_id long, file_seq long, chunk_seq int, piece int, batch_no long",
    )
    return chunks.join(batches, ["project_id", "file_seq", "chunk_seq", "piece"])


def batch_counts(chunks: DataFrame, limit: int = SOFT_BATCH_TOKENS) -> DataFrame:
    """Number of batches per project."""
    return pack_batches(chunks, limit).groupBy("project_id").agg((F.max("batch_no") + 1).alias("batches"))
