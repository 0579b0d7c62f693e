"""Changed files, added line ranges, and findings compared between a base and a head."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.grouped import fold_groups
from corpuslens.functions.ordered import rank_in_order
from corpuslens.functions.text import severity_rank
from corpuslens.session import cut_lineage

LINE_TOLERANCE = 10
#: Lines of a block in which spans and ranges meet.
BLOCK_LINES = 64


def diff_stats(changed: DataFrame) -> DataFrame:
    """Additions and deletions of each unified diff; row-local.

    ``+++`` and ``---`` are file headers only before the first hunk.
    """
    lines = F.split("diff", "\n")
    first = F.array_position(F.transform(lines, lambda l: F.startswith(l, F.lit("@@"))), True)
    n = F.size(lines)
    head = F.when(first > 0, F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(lines)
    body = F.when(first > 0, F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), n)).otherwise(
        F.array().cast("array<string>")
    )
    header = lambda l: F.startswith(l, F.lit("+++")) | F.startswith(l, F.lit("---"))

    def count(sign: str) -> Column:
        starts = lambda l: F.startswith(l, F.lit(sign))
        return F.size(F.filter(body, starts)) + F.size(F.filter(head, lambda l: starts(l) & ~header(l)))

    return changed.withColumn("additions", count("+")).withColumn("deletions", count("-"))


def added_ranges(changed: DataFrame, keys: list[str]) -> DataFrame:
    """Head-side line ranges of added lines, one row per run of ``+`` lines.

    Only one marker per line is shuffled, never its text; a file's own length
    bounds each window.
    """
    kind = (
        F.when(F.startswith("line", F.lit("@@")), "@")
        .when(F.startswith("line", F.lit("+")), "+")
        .when(F.startswith("line", F.lit("-")), "-")
        .otherwise(" ")
    )
    start = F.when(kind == "@", F.coalesce(F.nullif(F.regexp_extract("line", r"\+(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))
    rows = (
        changed.where("diff IS NOT NULL AND diff <> ''")
        .select(*keys, F.posexplode(F.split("diff", "\n")).alias("pos", "line"))
        .select(*keys, "pos", kind.alias("kind"), start.alias("start"),
                (F.startswith("line", F.lit("+++")) | F.startswith("line", F.lit("---"))).alias("header"))
    )
    by_file = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("hunk", F.sum((F.col("kind") == "@").cast("int")).over(by_file))
    rows = rows.where("NOT (header AND hunk = 0)")
    hunk = Window.partitionBy(*keys, "hunk").orderBy("pos")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("base", F.coalesce(F.first("start").over(hunk), F.lit(0)))
        .withColumn("head", F.col("base") + F.coalesce(F.sum(F.col("kind").isin("+", " ").cast("int")).over(before), F.lit(0)))
        .withColumn("run", F.sum((F.col("kind") != "+").cast("int")).over(hunk))
    )
    return (
        rows.where("kind = '+'")
        .groupBy(*keys, "hunk", "run")
        .agg(F.min("head").cast("int").alias("range_start"), F.max("head").cast("int").alias("range_end"))
        .drop("hunk", "run")
    )


def _blocks(start: Column, end: Column) -> Column:
    """Blocks of lines that a span reaches into."""
    return F.explode(F.sequence(F.floor(start / BLOCK_LINES), F.floor(end / BLOCK_LINES)))


def _touching(rows: DataFrame, ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """``rows`` whose span overlaps a range of their file.

    Spans and ranges meet in blocks of lines, so a file with a long history of ranges is many
    small keys; of a span that overlaps several only its place goes on.
    """
    keys = ["project_id", "path"]
    rows = rows.withColumn("_s", start).withColumn("_e", end)
    spans = rows.select(*keys, "_s", "_e").distinct().withColumn("_b", _blocks(F.col("_s"), F.col("_e")))
    places = ranges.select(*keys, "range_start", "range_end").distinct().withColumn("_b", _blocks(F.col("range_start"), F.col("range_end")))
    met = spans.join(places, [*keys, "_b"]).where("_s <= range_end AND _e >= range_start").select(*keys, "_s", "_e").distinct()
    return rows.join(met, [*keys, "_s", "_e"], "left_semi").drop("_s", "_e")


def scope_to_diff(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings that touch an added range; one without lines needs only a changed file."""
    start = F.coalesce("line_start", F.lit(0))
    end = F.coalesce("line_end", start)
    anywhere = (start == 0) & (end == 0)
    changed = ranges.select("project_id", "path").distinct()
    whole = findings.where(anywhere).join(changed, ["project_id", "path"], "left_semi")
    return whole.unionByName(_touching(findings.where(~anywhere), ranges, start, end).select(*whole.columns))


def decision_drift(decisions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Decisions whose documented range overlaps an added range of the same file."""
    return _touching(decisions, ranges, F.col("line_start"), F.col("line_end"))


_LOOSE = ["project_id", "path", "t40"]


def _closest(_: tuple, rows: list[tuple]) -> list[tuple]:
    """1:1 matching inside one stretch of lines: closest first, then head order, then base order."""
    bases = defaultdict(deque)
    for line, side, seq in rows:
        if side == "base":
            bases[line].append(seq)
    heads = [(seq, line) for line, side, seq in rows if side == "head"]
    out = []
    for d in range(LINE_TOLERANCE + 1):
        rest = []
        for seq, line in heads:
            options = [x for x in {line - d, line + d} if bases.get(x)]
            if options:
                best = min(options, key=lambda x: bases[x][0])
                out.append((seq, bases[best].popleft()))
            else:
                rest.append((seq, line))
        heads = rest
    return out


def loose_matches(rows: DataFrame) -> DataFrame:
    """``(head_seq, base_seq)`` pairs within the line tolerance for equal file and title start.

    ``rows(project_id, path, t40, line, side, seq)`` are the leftovers of the exact pass.

    The exact pass has left at most one side per line. Each (file, title) is cut
    wherever no leftover lies within the tolerance, and a line keeps only as many
    rows as the other side could consume nearby, so a task sees one short stretch.
    """
    per_line = rows.groupBy(*_LOOSE, "line").agg(
        F.count_if(F.col("side") == "head").alias("h"), F.count_if(F.col("side") == "base").alias("b")
    )
    w = Window.partitionBy(*_LOOSE).orderBy("line")
    near = w.rangeBetween(-LINE_TOLERANCE, LINE_TOLERANCE)
    per_line = (
        per_line.withColumn("cut", F.coalesce((F.col("line") - F.lag("line").over(w) > LINE_TOLERANCE).cast("int"), F.lit(0)))
        .withColumn("stretch", F.sum("cut").over(w))
        .withColumn("near_h", F.sum("h").over(near))
        .withColumn("near_b", F.sum("b").over(near))
        .select(*_LOOSE, "line", "stretch", "near_h", "near_b")
        .where("near_h > 0 AND near_b > 0")
    )
    rows = rank_in_order(rows, [*_LOOSE, "line", "side"], "seq", "rn").join(per_line, [*_LOOSE, "line"])
    rows = rows.where(F.col("rn") <= F.when(F.col("side") == "head", F.col("near_b")).otherwise(F.col("near_h")))
    rows = rows.select(*_LOOSE, "stretch", "line", "side", "seq")
    return fold_groups(rows, [*_LOOSE, "stretch"], ["seq"], _closest, "head_seq long, base_seq long")


def compare_findings(
    head: DataFrame, base: DataFrame | None, changed: DataFrame, ranges: DataFrame | None = None
) -> DataFrame:
    """``bucket`` introduced / unchanged (head rows) or resolved (base rows) in changed files.

    Equal file, line and title start pair off first, in order; leftovers pair by
    nearest line. ``base=None`` means the base was never reviewed: then only the
    findings inside the added ranges (or all, without ranges) count as introduced.
    """
    paths = changed.select("project_id", "path").distinct()
    head = head.join(paths, ["project_id", "path"], "left_semi")
    if base is None:
        new = scope_to_diff(head, ranges) if ranges is not None else head
        return new.withColumn("bucket", F.lit("introduced"))
    base = base.join(paths, ["project_id", "path"], "left_semi")

    spot = [*_LOOSE, "line"]
    narrow = lambda d, s: d.select(
        "project_id", "path", F.substring("title", 1, 40).alias("t40"),
        F.coalesce("line_start", F.lit(0)).alias("line"), F.lit(s).alias("side"), "seq",
    )
    rows = narrow(head, "head").unionByName(narrow(base, "base"))
    sizes = rows.groupBy(*spot).agg(
        F.count_if(F.col("side") == "head").alias("h"), F.count_if(F.col("side") == "base").alias("b")
    )
    exact = F.col("nth") <= F.least("h", "b")
    rows = rank_in_order(rows, [*spot, "side"], "seq", "nth").join(sizes, spot).withColumn("exact", exact)
    rows = cut_lineage(rows.drop("h", "b", "nth"))
    left = rows.where("NOT exact").drop("exact")
    pairs = cut_lineage(loose_matches(left))
    paired = pairs.select(F.lit("head").alias("side"), F.col("head_seq").alias("seq")).unionByName(
        pairs.select(F.lit("base").alias("side"), F.col("base_seq").alias("seq"))
    )
    open_ = left.select("side", "seq").join(paired, ["side", "seq"], "left_anti")
    flag = lambda s: open_.where(F.col("side") == s).select("seq", F.lit(True).alias("_open"))
    heads = head.join(flag("head"), "seq", "left")
    heads = heads.withColumn("bucket", F.when(F.col("_open"), "introduced").otherwise("unchanged")).drop("_open")
    common = [c for c in head.columns if c in base.columns]
    resolved = base.join(flag("base"), "seq", "left_semi").select(*common).withColumn("bucket", F.lit("resolved"))
    return heads.unionByName(resolved, allowMissingColumns=True)


def rank_introduced(diff: DataFrame) -> DataFrame:
    """Introduced findings, most severe first, then by penalty; a distributed sort."""
    return (
        diff.where("bucket = 'introduced'")
        .withColumn("severity_rank", F.coalesce(severity_rank("severity"), F.lit(5)))
        .orderBy("project_id", "severity_rank", F.desc(F.coalesce("score_penalty", F.lit(0.0))), "seq")
    )


def diff_gate(diff: DataFrame) -> DataFrame:
    """Per project: does the diff introduce anything critical."""
    return diff.groupBy("project_id").agg(
        F.bool_or((F.col("bucket") == "introduced") & (F.col("severity") == "critical")).alias("blocked"),
        F.count_if(F.col("bucket") == "introduced").alias("introduced"),
        F.count_if(F.col("bucket") == "unchanged").alias("unchanged"),
        F.count_if(F.col("bucket") == "resolved").alias("resolved"),
    )


def parse_name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """Exported ``--name-status`` lines to path, old path and status."""
    parts = F.split(column, "\t")
    code = F.substring(F.get(parts, F.lit(0)), 1, 1)
    moved = code.isin("R", "C")
    status = F.when(code == "A", "added").when(code == "D", "deleted").otherwise("modified")
    rest = [c for c in lines.columns if c != column]
    return (
        lines.where(F.trim(column) != "")
        .select(
            *rest,
            F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
            F.when(moved, F.get(parts, F.lit(1))).alias("old_path"),
            status.alias("status"),
        )
        .where("path <> ''")
    )
