"""Scalar column expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.constants import CHARS_PER_TOKEN, SEVERITIES, SPLIT_MARGIN


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; plain nesting would repeat it per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column | str) -> Column:
    return F.ceil(F.length(col(c)) / F.lit(CHARS_PER_TOKEN)).cast("int")


def split_budget(limit: int) -> int:
    return max(1, int(limit * SPLIT_MARGIN))


def half_up(c: Column | str) -> Column:
    """Round half towards plus infinity; Spark's round goes away from zero."""
    return F.floor(col(c) + F.lit(0.5))


def ascii_word(pattern: str) -> str:
    """Word boundaries on ASCII only: Java's own treat accented letters as word characters."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def severity_rank(c: Column | str) -> Column:
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(col(c) == s, F.lit(i)).otherwise(out)
    return out


def word_set(c: Column | str) -> Column:
    """Sorted distinct ``[a-z0-9]+`` words of the lowercased text; NULL counts as empty."""
    parts = F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: w != "")))


def set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def jaccard(a: Column | str, b: Column | str) -> Column:
    return set_jaccard(word_set(a), word_set(b))


def fold_segments(c: Column, keep_up: bool = False) -> Column:
    """Resolve ``.``, ``..`` and empty segments of a ``/``-separated path.

    A ``..`` with nothing left to remove is dropped, or kept in front with ``keep_up``.
    """

    def step(acc: Column, s: Column) -> Column:
        empty = F.size(acc) == 0
        if keep_up:
            empty = empty | (F.get(acc, F.size(acc) - 1) == "..")
        up = F.when(empty, F.concat(acc, F.array(s)) if keep_up else acc).otherwise(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        return F.when(s.isin("", "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def join_path(folder: Column, relative: Column) -> Column:
    """``relative`` seen from ``folder``; a path above the root keeps its leading ``..``."""
    return fold_segments(F.concat(folder, F.lit("/"), relative), keep_up=True)


def norm_path(c: Column | str) -> Column:
    """Canonical relative posix path; clean paths skip the segment fold."""
    p = F.translate(F.trim(col(c)), "\\", "/")
    dirty = p.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(~dirty, p).when(dirty, fold_segments(p))


def path_key(c: Column | str) -> Column:
    return F.lower(norm_path(c))


def dirname(c: Column | str) -> Column:
    return F.when(F.instr(col(c), "/") > 0, F.regexp_replace(col(c), "/[^/]*$", "")).otherwise(F.lit(""))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def clean_prefix(c: Column | str) -> Column:
    """Drop a leading ``/`` or ``./``."""
    return F.regexp_replace(col(c), r"^\.?/+", "")


def ellipsis(c: Column | str, width: int, mark: str = "…") -> Column:
    s = col(c)
    return F.when(F.length(s) <= width, s).otherwise(
        F.concat(F.substring(s, 1, width - len(mark)), F.lit(mark))
    )


def escape_cell(c: Column | str) -> Column:
    """Escape backslash, pipe and backtick, and flatten newlines."""
    s = F.replace(col(c), F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit("|"), F.lit("\\|"))
    s = F.replace(s, F.lit("`"), F.lit("\\`"))
    return F.replace(s, F.lit("\n"), F.lit(" "))


def table_cell(c: Column | str, columns: int, table_width: int = 120) -> Column:
    return ellipsis(escape_cell(c), (table_width - columns * 3) // columns)


def table_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def finite(c: Column | str) -> Column:
    """NULL for NaN and the infinities."""
    v = col(c).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)
