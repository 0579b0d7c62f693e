"""Review directives in comments, and the findings they suppress."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.constants import HASH_COMMENT_LANGUAGES
from corpuslens.functions.text import clean_prefix

# A quoted literal on one line; possessive loops keep long lines off the regex stack.
QUOTED = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in ("'", '"', "`"))
SLASH_COMMENT = r"(?://|/\*+|^\s*\*)"
HASH_COMMENT = "#"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _directive(line: Column, prefix: str, word: str, tail: str) -> Column:
    """Struct(type, value, file_level) of one line, NULL without a directive."""
    head = rf"(?i){prefix}\s*{re.escape(word)}\s+"
    kind = lambda t, v, w: F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit(w).alias("file_level"))
    none = F.lit(None).cast("string")
    review, focus = head + r"review\s*:\s*(.+?)" + tail, head + r"focus\s*:\s*(.+?)" + tail
    end = r"(?![A-Za-z0-9_])"
    return (
        F.when(line.rlike(review), kind("review", _trim(F.regexp_extract(line, review, 1)), False))
        .when(line.rlike(focus), kind("focus", _trim(F.regexp_extract(line, focus, 1)), False))
        .when(line.rlike(head + "ignore-file" + end), kind("ignore", none, True))
        .when(line.rlike(head + "ignore" + end), kind("ignore", none, False))
    )


def parse_annotations(files: DataFrame, directive: str = "@rv") -> DataFrame:
    """One row per directive line: ``(project_id, path, line, type, value, file_level)``.

    Files without the directive word never have their lines exploded, and only
    lines that contain it leave the row. Quoted text is removed first. Languages
    with ``#`` comments use that prefix only.
    """
    has = lambda c: F.contains(F.lower(c), F.lit(directive.lower()))
    lines = F.filter(
        F.transform(F.split("content", "\n"), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text"))),
        lambda s: has(s["text"]),
    )
    rows = files.where(has(F.col("content"))).select(
        "project_id", "path", "language", F.explode(lines).alias("l")
    )
    scan = F.regexp_replace("l.text", QUOTED, "")
    slash = _directive(scan, SLASH_COMMENT, directive, r"(?:\*/)?\s*$")
    hashed = _directive(scan, HASH_COMMENT, directive, r"$")
    mark = F.when(F.col("language").isin(HASH_COMMENT_LANGUAGES), hashed).otherwise(slash)
    return (
        rows.withColumn("m", mark)
        .where("m IS NOT NULL")
        .select("project_id", "path", F.col("l.line").cast("int").alias("line"), "m.type", "m.value", "m.file_level")
    )


def annotation_summary(annotations: DataFrame) -> DataFrame:
    """The same rows sorted into review / focus requests and ignored files / lines."""
    group = (
        F.when((F.col("type") == "ignore") & F.col("file_level"), "ignored_file")
        .when(F.col("type") == "ignore", "ignored_line")
        .when(F.coalesce("value", F.lit("")) != "", F.col("type"))
    )
    return annotations.withColumn("request", group).where("request IS NOT NULL").select(
        "project_id", "request", "path", "line", "value"
    )


def ignored_files(annotations: DataFrame) -> DataFrame:
    return annotations.where("type = 'ignore' AND file_level").select("project_id", "path").distinct()


def apply_line_ignores(findings: DataFrame, ignored_lines: DataFrame) -> DataFrame:
    """Drop findings that touch an ignored line or start on the line after it.

    ``ignored_lines(path, line)``. The lines of a file are gathered into one row
    (its own length bounds them) and tested in place: no range join.
    """
    keys = [k for k in ("project_id",) if k in findings.columns and k in ignored_lines.columns]
    marks = ignored_lines.groupBy(*keys, clean_prefix("path").alias("_p")).agg(F.collect_set("line").alias("_lines"))
    end = F.coalesce("line_end", "line_start")
    hit = F.exists("_lines", lambda x: (F.col("line_start") <= x + 1) & (end >= x))
    return (
        findings.withColumn("_p", clean_prefix("path"))
        .join(marks, [*keys, "_p"], "left")
        .where(~F.coalesce(hit, F.lit(False)))
        .drop("_p", "_lines")
    )
