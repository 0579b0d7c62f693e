"""Which files, chunks and detectors take part: ignore rules, languages, sizes, scopes, targets."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import (
    DEFAULT_IGNORES,
    DOMAINS,
    LANGUAGE_BY_EXTENSION,
    MAX_FILE_BYTES,
    MODE_OVERRIDES,
)
from corpuslens.functions.patterns import glob_regex, ignore_rule
from corpuslens.functions.text import basename, clean_prefix, fold_segments


def ancestors(path: Column) -> Column:
    """``a/b/c`` to ``[a, a/b, a/b/c]``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignored(path: Column, rules: list[str]) -> Column:
    """Gitignore semantics: on the path and on each parent the last matching rule decides."""
    parsed = [r for r in map(ignore_rule, rules) if r]
    plain = [(f, x) for ig, f, x in parsed if ig]
    if len(plain) == len(parsed):
        on_any = "|".join(x for f, x in plain if not f)
        on_folder = "|".join(x for _, x in plain)
        hit = F.exists(F.slice(ancestors(path), F.lit(1), F.size(F.split(path, "/")) - 1), lambda p: p.rlike(on_folder))
        return (path.rlike(on_any) | hit) if on_any else hit

    def decide(p: Column) -> Column:
        verdict = F.lit(False)
        for ig, folders_only, regex in parsed:
            m = p.rlike(regex)
            verdict = F.when(m & (p != path) if folders_only else m, F.lit(ig)).otherwise(verdict)
        return verdict

    return F.exists(ancestors(path), decide)


def ignore_filter(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    return files.where(~ignored(F.col("path"), [*DEFAULT_IGNORES, *(rules or [])]))


def language_of(path: Column) -> Column:
    """Language of the (case-sensitive) extension; NULL when unknown."""
    table = F.create_map(*[F.lit(x) for x in itertools.chain(*LANGUAGE_BY_EXTENSION.items())])
    ext = F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)
    return F.element_at(table, ext)


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path"))).where("language IS NOT NULL")


def size_guard(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """``skipped`` marks files above the limit; they stay listed so lost coverage is visible."""
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content")
    return files.withColumn("size_bytes", size.cast("long")).withColumn("skipped", F.col("size_bytes") > limit)


def language_profile(files: DataFrame) -> DataFrame:
    """Languages present per project; first class when TypeScript or JavaScript is among them."""
    langs = files.groupBy("project_id").agg(F.array_sort(F.collect_set("language")).alias("l"))
    langs = langs.withColumn("l", F.when(F.size("l") == 0, F.array(F.lit("typescript"))).otherwise(F.col("l")))
    first = F.array_contains("l", "typescript") | F.array_contains("l", "javascript")
    return langs.select("project_id", F.array_join("l", ",").alias("languages"), first.alias("first_class"))


def _under(path: Column, folders: list[str]) -> Column:
    hit = F.lit(False)
    for d in folders:
        hit = hit | (path == d) | path.startswith(d.rstrip("/") + "/")
    return hit


def _project(*tables: DataFrame) -> list[str]:
    return ["project_id"] if all("project_id" in t.columns for t in tables) else []


def scope_paths(
    files: DataFrame,
    dirs: list[str] | None = None,
    exact: list[str] | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Files under ``dirs``, named in ``exact`` and under a row of ``targets(path)``; absent means all.

    Targets join on the file's own parent folders, an equi-join however many there are, and
    on ``project_id`` where both sides have one.
    """
    if dirs:
        files = files.where(_under(F.col("path"), dirs))
    if exact:
        files = files.where(F.col("path").isin(exact))
    if targets is not None:
        keys = _project(files, targets)
        t = targets.select(*keys, F.col("path").alias("a")).distinct()
        up = files.select(*keys, "path", F.explode(ancestors(F.col("path"))).alias("a")).join(t, [*keys, "a"], "left_semi")
        files = files.join(up.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")
    return files


def scope_globs(files: DataFrame, globs: list[str]) -> DataFrame:
    return files.where(F.col("path").rlike("|".join(glob_regex(g) for g in globs))) if globs else files


def resolve_targets(targets: DataFrame) -> DataFrame:
    """Valid target rows with one relative posix path per entry.

    A target needs a name, a description and at least one entry; ``project_id`` stays if there is one.
    """
    keys = _project(targets)
    valid = "name <> '' AND description <> '' AND entry IS NOT NULL AND size(entry) > 0"
    entry = fold_segments(F.translate("entry_path", "\\", "/"))
    return (
        targets.where(valid)
        .select(*keys, "name", "description", F.explode("entry").alias("entry_path"))
        .select(*keys, "name", "description", entry.alias("path"))
    )


def scope_targets(files: DataFrame, targets: DataFrame, name: str | None = None) -> DataFrame:
    """Files of one target, or of all of them together."""
    t = resolve_targets(targets)
    return scope_paths(files, targets=t.where(F.col("name") == name) if name else t)


def drop_ignored_files(rows: DataFrame, ignored_files: DataFrame) -> DataFrame:
    """Remove every row of a file that carries a whole-file ignore directive."""
    keys = _project(rows, ignored_files)
    out = ignored_files.select(*keys, clean_prefix("path").alias("_p")).distinct()
    return rows.withColumn("_p", clean_prefix("path")).join(out, [*keys, "_p"], "left_anti").drop("_p")


def scope_annotated(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """Chunks that hold a line with a review or focus request.

    Request lines are gathered per file (a file's own lines bound their number),
    so the range test needs no range join.
    """
    keys = _project(chunks, annotations)
    lines = (
        annotations.where("type IN ('review', 'focus') AND value <> ''")
        .groupBy(*keys, "path")
        .agg(F.collect_set("line").alias("_lines"))
    )
    inside = F.exists("_lines", lambda x: (x >= F.col("start_line")) & (x <= F.col("end_line")))
    return chunks.join(lines, [*keys, "path"]).where(inside).drop("_lines")


def select_detectors(
    detectors: DataFrame, mode: str = "standard", overrides: list[str] | None = None, count: int | None = None
) -> DataFrame:
    """The roster of a review: ``detectors(name, builtin, priority)`` plus ``position``.

    Overrides (or those of the mode) pick by name and fail on an unknown one;
    otherwise the first ``count`` built-ins by priority. Custom detectors always join.
    """
    names = list(dict.fromkeys(overrides or MODE_OVERRIDES.get(mode, [])))
    spark = detectors.sparkSession
    if names:
        wanted = spark.createDataFrame(list(enumerate(names)), "position int, name string")
        picked = wanted.join(detectors, "name", "left").withColumn(
            "name",
            F.when(F.col("builtin").isNull(), F.raise_error(F.concat(F.lit("unknown detector: "), "name"))).otherwise(
                F.col("name")
            ),
        )
        custom = detectors.where("NOT builtin").where(~F.col("name").isin(names))
        return picked.select(*detectors.columns, "position").unionByName(
            custom.withColumn("position", F.lit(len(names)))
        )
    rank = F.row_number().over(Window.partitionBy("builtin").orderBy("priority", "name"))
    ranked = detectors.withColumn("position", rank - 1)
    limit = count if count and count > 0 else len(DOMAINS)
    return ranked.where(~F.col("builtin") | (F.col("position") < limit)).withColumn(
        "position", F.when(F.col("builtin"), F.col("position")).otherwise(F.lit(limit))
    )
