"""Queries on the corpus of files: scope, annotations, chunks, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import table_cell
from corpuslens.operators import annotations, chunks, detectors, redact, scope
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query

RULES = ["src/d3/", "*.js", "!src/d4/*.js", "/src/d5/f*5.ts", "src/**/f77.ts", "# note", ""]


def source_files(fx: Fixtures) -> DataFrame:
    return scope.with_language(fx.files)


@query
def ignore_filter(fx: Fixtures) -> DataFrame:
    return scope.ignore_filter(fx.files, RULES).select("file_seq", "path")


@query
def plain_ignore_filter(fx: Fixtures) -> DataFrame:
    return scope.ignore_filter(fx.files, ["src/d3/", "*.py", "f1?.ts"]).select("file_seq", "path")


@query
def language_by_extension(fx: Fixtures) -> DataFrame:
    return source_files(fx).select("file_seq", "path", "language")


@query
def size_guard(fx: Fixtures) -> DataFrame:
    return scope.size_guard(fx.files, 4096).select("file_seq", "size_bytes", "skipped")


@query
def language_profile(fx: Fixtures) -> DataFrame:
    return scope.language_profile(source_files(fx))


@query
def scope_paths(fx: Fixtures) -> DataFrame:
    targets = fx.code_meta.where("file_seq % 50 = 7").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return scope.scope_paths(fx.files, dirs=["src/d1", "src/d7", "src/d8"], targets=targets).select("file_seq", "path")


@query
def scope_globs(fx: Fixtures) -> DataFrame:
    return scope.scope_globs(fx.files, ["src/d2/**", "**/f1?.ts", "*.py", "d9/", "f100.ts"]).select("file_seq", "path")


@query
def scope_targets(fx: Fixtures) -> DataFrame:
    t = fx.code_meta.where("file_seq % 40 = 3").select(
        F.concat(F.lit("t"), (F.col("file_seq") % 3).cast("string")).alias("name"),
        F.when(F.col("file_seq") % 80 == 3, "some area").otherwise("").alias("description"),
        F.array(F.concat(F.lit("./"), "path"), F.lit("src\\d11")).alias("entry"),
    )
    return scope.scope_targets(fx.files, t).select("file_seq", "path")


@query
def select_detectors(fx: Fixtures) -> DataFrame:
    names = fx.findings.select(F.col("agent_name").alias("name"), F.lit(True).alias("builtin")).distinct()
    custom = fx.findings.where("symbol_name IS NOT NULL").select(
        F.col("symbol_name").alias("name"), F.lit(False).alias("builtin")
    ).distinct()
    table = names.unionByName(custom).withColumn("priority", F.length("name"))
    return scope.select_detectors(table, count=3).select("name", "builtin", "position")


@query
def mode_detectors(fx: Fixtures) -> DataFrame:
    table = fx.findings.select(
        F.col("agent_name").alias("name"), (F.col("agent_name") != "logic").alias("builtin")
    ).distinct().withColumn("priority", F.length("name"))
    return scope.select_detectors(table, mode="onboard").select("name", "builtin", "position")


@query
def parse_annotations(fx: Fixtures) -> DataFrame:
    return annotations.parse_annotations(source_files(fx))


@query
def annotation_summary(fx: Fixtures) -> DataFrame:
    return annotations.annotation_summary(annotations.parse_annotations(source_files(fx)))


@query
def apply_line_ignores(fx: Fixtures) -> DataFrame:
    marks = fx.findings.where("seq % 37 = 5 AND line_start IS NOT NULL").select("path", F.col("line_start").alias("line"))
    return annotations.apply_line_ignores(fx.findings, marks).select("seq", "path", "line_start", "line_end")


def windows(fx: Fixtures) -> DataFrame:
    return chunks.split_windows(chunks.whole_file_chunks(fx.files), 1200, 20, 5)


@query
def split_windows(fx: Fixtures) -> DataFrame:
    return windows(fx).select(
        "chunk_id", "file_seq", "part", "start_line", "end_line", "token_count", F.md5("content").alias("digest")
    )


@query
def split_windows_with_prefix(fx: Fixtures) -> DataFrame:
    c = chunks.whole_file_chunks(fx.files).withColumn(
        "context_prefix", F.when(F.col("file_seq") % 2 == 0, F.repeat(F.lit("context line\n"), 120))
    )
    c = c.withColumn("token_count", chunks.tokens(F.concat(F.coalesce("context_prefix", F.lit("")), "content")))
    return chunks.split_windows(c, 1200, 20, 5).select(
        "chunk_id", "file_seq", "part", "start_line", "end_line", "token_count", F.md5("content").alias("digest")
    )


@query
def scope_annotated(fx: Fixtures) -> DataFrame:
    marks = annotations.parse_annotations(source_files(fx))
    return scope.scope_annotated(windows(fx), marks).select("project_id", "chunk_id")


@query
def drop_ignored_files(fx: Fixtures) -> DataFrame:
    marks = annotations.ignored_files(annotations.parse_annotations(source_files(fx)))
    return scope.drop_ignored_files(windows(fx), marks).select("chunk_id", "path")


@query
def chunk_braces(fx: Fixtures) -> DataFrame:
    return chunks.chunk_braces(source_files(fx)).select(
        "chunk_id", "chunk_seq", "start_line", "end_line", "token_count"
    )


@query
def cap_chunks(fx: Fixtures) -> DataFrame:
    return chunks.cap_chunks(windows(fx), ["chunk_seq", "part"], 2).select("chunk_id", "truncated", "dropped")


@query
def split_to_limit(fx: Fixtures) -> DataFrame:
    return chunks.split_to_limit(windows(fx), 900).select(
        "chunk_id", "piece", "start_line", "end_line", "token_count", F.md5("content").alias("digest")
    )


@query
def chunk_complexity(fx: Fixtures) -> DataFrame:
    return chunks.with_complexity(chunks.whole_file_chunks(fx.files)).select("file_seq", "complexity")


@query
def chunk_symbols(fx: Fixtures) -> DataFrame:
    return chunks.with_symbol(chunks.whole_file_chunks(fx.files)).select("file_seq", "symbol_name")


@query
def resolve_symbols(fx: Fixtures) -> DataFrame:
    refs = fx.code_meta.select(
        "project_id", "path", F.concat(F.lit("sym"), (F.col("file_seq") % 40).cast("string")).alias("name")
    )
    return chunks.resolve_symbols(refs, fx.files).select(
        "chunk_id", "symbol_name", "start_line", "end_line", "token_count", F.md5("content").alias("digest")
    )


@query
def manifests_from_chunks(fx: Fixtures) -> DataFrame:
    c = chunks.split_windows(chunks.whole_file_chunks(fx.files), 1200, 20, 5).withColumn(
        "language", scope.language_of(F.col("path"))
    )
    return chunks.manifests_from_chunks(c)


@query
def budget_report(fx: Fixtures) -> DataFrame:
    return chunks.budget_report(windows(fx), 150_000)


@query
def run_detectors(fx: Fixtures) -> DataFrame:
    rules = [
        detectors.Detector("todo", "hygiene", "low", "Open TODO", pattern=r"TODO|FIXME"),
        detectors.Detector("mapGlobals", "memory", "medium", "Global map", pattern=r"new Map\(\)", penalties={"medium": 3.0}),
        detectors.Detector("longLine", "style", "info", "Long line", predicate="length(line) > 300"),
    ]
    out = detectors.run_detectors(scope.with_language(fx.files), rules)
    return out.select("path", "line_start", "agent_name", "severity", "score_penalty", F.length("text").alias("n_chars"))


@query
def redact_text(fx: Fixtures) -> DataFrame:
    d = redact.redact_text(fx.table("documents").select("doc_id", "text"), "text")
    return d.select("doc_id", "hits", F.md5("text").alias("digest"))


@query
def redact_map(fx: Fixtures) -> DataFrame:
    m = fx.table("events").select(
        "event_id",
        F.create_map(F.concat(F.lit("api_"), F.col("event_type")), F.col("props"), F.lit("AuthToken"), F.col("props")).alias("m"),
    )
    r = redact.redact_map(m, "m")
    return r.select("event_id", F.col("m")["AuthToken"].alias("token"), F.map_values("m")[0].alias("first"))


@query
def redact_nested(fx: Fixtures) -> DataFrame:
    """Every event as a log record: calls with headers in an array, attempts by name in a map."""
    note = F.when(F.col("event_id") % 3 == 0, "sessionToken").otherwise("note")
    call = lambda who: F.struct(F.col("props").alias("ApiKey"), who.alias("who"), F.create_map(note, "props").alias("headers"))
    attempt = F.array(F.struct(F.col("user_id").alias("password"), F.col("value").alias("took")))
    tried = F.create_map(F.concat(F.lit("try_"), F.when(F.col("event_id") % 5 == 0, "key").otherwise("plain")), attempt)
    record = F.struct(
        F.col("event_type").alias("kind"), F.array(call(F.col("event_type")), call(F.lit("retry"))).alias("calls"), tried.alias("tried"),
        F.col("user_id").alias("Authorization"),
    )
    d = redact.redact_nested(fx.table("events").select("event_id", record.alias("r")), "r")
    last, tries = F.col("r.calls")[1], F.map_values("r.tried")[0]
    return d.select(
        "event_id", "r.kind", F.col("r.Authorization").alias("auth"), last["ApiKey"].alias("call_key"), last["who"].alias("who"),
        F.map_values(last["headers"])[0].alias("header"), tries[0]["password"].alias("tried_password"), tries[0]["took"].alias("took"),
    )


@query
def table_cells(fx: Fixtures) -> DataFrame:
    return fx.files.select("file_seq", table_cell("content", 5).alias("cell"))


@query
def split_sections(fx: Fixtures) -> DataFrame:
    """Each document as an onboarding text whose markers partly miss."""
    n = F.col("doc_id")
    mark = lambda name, keep: F.when(keep, F.concat(F.lit(f"\n## {name}.md\n"), F.lit(name))).otherwise("")
    text = F.concat(
        F.lit("intro"), mark("ARCHITECTURE", n % 2 == 0), F.col("text"), mark("DATA_FLOWS", n % 3 == 0),
        F.col("lang"), mark("DANGER_ZONES", n % 5 != 0), F.col("text"), mark("GOTCHAS", n % 7 < 3),
    )
    d = fx.table("documents").select("doc_id", text.alias("text"))
    return redact.split_sections(d).select("doc_id", "marker", F.md5("section").alias("digest"))
