"""Import edges between files and what follows from them."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import (
    FACT_CAPS,
    REEXPORT_EXTENSIONS,
    RESOLVE_EXTENSIONS,
    VALIDATOR_LIBS,
)
from corpuslens.functions.text import dirname, join_path
from corpuslens.session import cut_lineage, shared_folder

# Fixed: import statements by language, group 1 is the specifier; re-exports, names of test and
# build files, module globals.
JS_IMPORT = (
    r"(?m)(?:^[ \t]*import\s+(?:[\w$*{}\s,]+?\s+from\s+)?|(?<![A-Za-z0-9_])require\(\s*)['\"]([^'\"\n]+)['\"]"
)
QUOTED_IMPORT = (
    r"(?:(?<![A-Za-z0-9_])import(?:[\s\S]*?from\s+)?|(?<![A-Za-z0-9_])require\()\s*['\"]([^'\"]+)['\"]"
)
IMPORT_PATTERNS = [
    (r"\.(java|kt|kts)$", r"(?<![A-Za-z0-9_])import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;?"),
    (r"\.cs$", r"(?<![A-Za-z0-9_])using\s+(?:static\s+)?([\w.]+)\s*;"),
    (r"\.rs$", r"(?<![A-Za-z0-9_])(?:use|extern\s+crate)\s+([\w:]+)"),
    (r"\.swift$", r"(?<![A-Za-z0-9_])import\s+(\w+)"),
    (r"\.(c|h|cpp|cc|hpp|cxx|hxx)$", r"#include\s*[<\"]([^>\"]+)[>\"]"),
]
GO_BLOCK = r"(?<![A-Za-z0-9_])import\s*\(([\s\S]*?)\)"
GO_SINGLE = r"(?<![A-Za-z0-9_])import\s+\"([^\"]+)\""
PYTHON_RELATIVE = r"from\s+(\.+[\w.]*)\s+import\s+([\w*, ]+)"
REEXPORT = r"export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['\"]([^'\"]+)['\"]"
TEST_FILE = r"\.(test|spec)\.[cm]?[jt]sx?$|(^|/)(__tests__|tests|test|e2e)(/|$)"
BUILD_FILE = r"(^|/)[^/]*\.config\.[cm]?[jt]s$|(^|/)\.eslintrc|^scripts/"
MODULE_GLOBAL = (
    r"(?m)^(?:export\s+)?(?:const|let|var)[^\S\n]+(\w+)[^\S\n]*(?::[^=\n]+)?=[^\S\n]*new[^\S\n]+(Map|Set)(?![A-Za-z0-9_])"
)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def specifiers(path: Column, text: Column) -> Column:
    """Distinct import specifiers in first-seen order."""
    quoted = _all(text, QUOTED_IMPORT)
    go = F.concat(
        quoted,
        F.flatten(F.transform(_all(text, GO_BLOCK), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1)))),
        _all(text, GO_SINGLE),
    )
    out = F.when(path.rlike(r"\.(tsx?|mtsx?|jsx?|mjs|cjs|mts|cts)$"), _all(text, JS_IMPORT)).when(
        path.rlike(r"\.go$"), go
    )
    for ext, pattern in IMPORT_PATTERNS:
        out = out.when(path.rlike(ext), F.concat(quoted, _all(text, pattern)))
    return F.array_distinct(out.otherwise(quoted))


def extract_imports(files: DataFrame) -> DataFrame:
    """``(project_id, path, pos, spec)``."""
    return files.select(
        "project_id", "path", F.posexplode(specifiers(F.col("path"), F.col("content"))).alias("pos", "spec")
    )


def python_imports(files: DataFrame) -> DataFrame:
    """Relative Python imports as target paths; one dot is the own folder, each further one a level up.

    ``from . import a, b`` names one module per item. A climb above the root is dropped.
    """
    lines = F.filter(F.split("content", "\n"), lambda l: l.rlike(PYTHON_RELATIVE))
    d = files.where(F.col("path").endswith(".py")).select("project_id", "path", F.explode(lines).alias("l"))
    module, names = F.regexp_extract("l", PYTHON_RELATIVE, 1), F.regexp_extract("l", PYTHON_RELATIVE, 2)
    listed = F.filter(F.transform(F.split(names, ","), lambda n: F.trim(n)), lambda n: ~n.isin("", "*"))
    many = F.transform(listed, lambda n: F.concat(module, n))
    d = d.withColumn("spec", F.explode(F.when(module.rlike(r"^\.+$"), many).otherwise(F.array(module))))
    ups = F.length(F.regexp_extract("spec", r"^(\.+)", 1)) - 1
    rest = F.translate(F.regexp_replace("spec", r"^\.+", ""), ".", "/")
    target = join_path(dirname("path"), F.concat(F.repeat(F.lit("../"), ups), rest))
    return (
        d.withColumn("target", target)
        .where(~F.col("target").startswith(".."))
        .select("project_id", "path", "spec", "target")
        .distinct()
    )


def _strip(path: Column, extensions: list[str]) -> tuple[Column, Column]:
    """``(stem, position of the extension)``; position NULL when none applies."""
    pos = F.lit(None).cast("int")
    for i, e in reversed(list(enumerate(extensions))):
        pos = F.when(path.endswith(e), F.lit(i)).otherwise(pos)
    size = F.element_at(F.array(*[F.lit(len(e)) for e in extensions]), pos + 1)
    return F.substring(path, F.lit(1), F.length(path) - size), pos


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Relative specifiers to files: exact, then each extension, then ``.js`` as ``.ts``/``.tsx``, then ``/index``.

    Files offer their few names and imports theirs; they meet in one equi-join
    and the best priority wins, instead of looking up every candidate path.
    """
    exts = extensions or RESOLVE_EXTENSIONS
    i = imports.where(F.startswith("spec", F.lit("."))).select("project_id", "path", "spec").distinct()
    i = i.withColumn("to", join_path(dirname("path"), F.col("spec")))
    stem = F.regexp_replace("to", r"\.[cm]?[jt]sx?$", "")
    names = F.array(F.struct(F.col("to").alias("k"), F.lit(False).alias("stripped")),
                    F.struct(stem.alias("k"), F.lit(True).alias("stripped")))
    i = i.withColumn("n", F.explode(F.filter(names, lambda s: ~s["stripped"] | (s["k"] != F.col("to")))))

    f = files.select("project_id", F.col("path").alias("target")).distinct()
    base, pos = _strip(F.col("target"), exts)
    f = f.withColumn("b", base).withColumn("p", pos)
    typed = F.when(F.col("target").endswith(".ts"), 20).when(F.col("target").endswith(".tsx"), 21)
    offer = lambda k, rank, stripped: F.struct(
        k.alias("k"), rank.cast("int").alias("rank"), F.lit(stripped).alias("stripped")
    )
    offers = F.array(
        offer(F.col("target"), F.lit(0), False),
        offer(F.col("b"), F.col("p") + 1, False),
        offer(F.col("b"), F.when(F.col("p").isNotNull(), typed), True),
        offer(F.regexp_extract("b", "^(.*)/index$", 1), F.when(F.col("b").rlike("/index$"), F.col("p") + 30), False),
    )
    f = f.withColumn("o", F.explode(F.filter(offers, lambda o: o["rank"].isNotNull()))).select(
        "project_id", "target", F.col("o.k").alias("k"), "o.rank", "o.stripped"
    )
    return (
        i.select("project_id", "path", "spec", "n.k", "n.stripped")
        .join(f, ["project_id", "k", "stripped"])
        .groupBy("project_id", "path", "spec")
        .agg(F.min_by("target", F.struct("rank", "target")).alias("target"))
    )


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct ``(project_id, importer, importee)``."""
    return (
        resolve_imports(extract_imports(files), files)
        .select("project_id", F.col("path").alias("importer"), F.col("target").alias("importee"))
        .distinct()
    )


def centrality(edges: DataFrame) -> DataFrame:
    """Importers and imports per file. The importers themselves are the edge table."""
    both = edges.select("project_id", F.col("importee").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        edges.select("project_id", F.col("importer").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return both.groupBy("project_id", "path").agg(F.sum("i").alias("importer_count"), F.sum("o").alias("import_count"))


def trace_dependencies(seeds: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Files reached from each seed within ``depth`` imports, at their shallowest depth.

    ``seeds(project_id, seed)``. Only newly reached files are expanded.
    """
    step = edges.select("project_id", F.col("importer").alias("path"), F.col("importee").alias("nxt"))
    frontier = seeds.select("project_id", "seed", F.col("seed").alias("path"))
    found: DataFrame | None = None
    for d in range(1, depth + 1):
        new = (
            frontier.join(step, ["project_id", "path"])
            .select("project_id", "seed", F.col("nxt").alias("path"))
            .distinct()
        )
        if found is not None:
            new = new.join(found, ["project_id", "seed", "path"], "left_anti")
        new = cut_lineage(new.withColumn("depth", F.lit(d)))
        found = new if found is None else found.unionByName(new)
        frontier = new.drop("depth")
    return found


def shown_dependencies(traced: DataFrame, cap: int = 10) -> DataFrame:
    """The nearest ``cap`` per seed, as listed to a user."""
    w = Window.partitionBy("project_id", "seed").orderBy("depth", "path")
    return traced.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)


def _cyclic_core(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot be on a cycle: no way in or no way out, until stable."""
    e = cut_lineage(edges.where("importer <> importee"))
    size = e.count()
    while True:
        has_in = e.select("project_id", F.col("importee").alias("importer")).distinct()
        has_out = e.select("project_id", F.col("importer").alias("importee")).distinct()
        e = cut_lineage(
            e.join(has_in, ["project_id", "importer"], "left_semi").join(has_out, ["project_id", "importee"], "left_semi")
        )
        new = e.count()
        if new == size:
            return e
        size = new


def _ways_back(core: DataFrame, cap: int, max_len: int | None) -> DataFrame:
    """``(project_id, start, node, d)``: fewest imports from a file back to ``start``, through files after it in name order.

    The rows with ``node = start`` close a cycle of ``d`` files. All starts of a project are searched at once,
    one step a round, until ``cap`` of them have closed. A round adds its rows to one stored table.
    """
    spark = core.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/ways-back-{uuid.uuid4().hex}"
    name = core.schema["importer"].dataType.simpleString()
    schema = f"project_id {core.schema['project_id'].dataType.simpleString()}, start {name}, node {name}, d int"
    back = core.select("project_id", F.col("importee").alias("node"), F.col("importer").alias("before"))
    new = back.where("before > node").select("project_id", F.col("node").alias("start"), F.col("before").alias("node"))
    for d in count(1):
        new.withColumn("d", F.lit(d)).write.mode("append").parquet(folder)
        seen = spark.read.schema(schema).parquet(folder)
        closed = seen.where("node = start").groupBy("project_id").agg(F.countDistinct("start").alias("n"))
        frontier = seen.where((F.col("d") == d) & (F.col("node") > F.col("start"))).drop("d")
        frontier = frontier.join(closed.where(F.col("n") >= cap), "project_id", "left_anti")
        if d == max_len or frontier.isEmpty():
            return seen
        step = frontier.join(back, ["project_id", "node"]).where("before >= start")
        step = step.select("project_id", "start", F.col("before").alias("node")).distinct()
        new = step.join(seen.select("project_id", "start", "node"), ["project_id", "start", "node"], "left_anti")


def _grown_cycles(starts: DataFrame, core: DataFrame, ways: DataFrame, cap: int) -> DataFrame:
    """``(project_id, cycle, length)`` of the ``starts (project_id, start, most, direct)`` up to ``most`` files (NULL: any).

    A path is only followed where it can still return in time. If a start is ``direct``, every walk
    that returns in time is a cycle, so of paths of one length to one file the first ``cap`` by
    name are enough. A project stops growing once it has ``cap`` cycles, as later ones are longer.
    """
    key = ["project_id", "start"]
    step = core.select("project_id", F.col("importer").alias("last"), F.col("importee").alias("nxt"))
    ends = ways.select(*key, F.col("node").alias("nxt"), F.when(F.col("node") == F.col("start"), 0).otherwise(F.col("d")).alias("rest")).distinct()
    paths = starts.select(*key, "most", "direct", F.col("start").alias("last"), F.array("start").alias("path"))
    among = Window.partitionBy(*key, "last").orderBy(F.array_join("path", ">"))
    found = None
    for length in count(1):
        grown = paths.join(step, ["project_id", "last"]).where("nxt >= start").join(ends, [*key, "nxt"])
        grown = cut_lineage(grown.where(F.col("most").isNull() | (F.col("rest") + length <= F.col("most"))))
        closed = grown.where("nxt = start").select("project_id", F.array_join("path", ">").alias("cycle"), F.lit(length).alias("length"))
        found = cut_lineage(closed if found is None else found.unionByName(closed))
        full = found.groupBy("project_id").count().where(F.col("count") >= cap).select("project_id")
        paths = (
            grown.where("nxt <> start AND NOT array_contains(path, nxt)")
            .join(full, "project_id", "left_anti")
            .select(*key, "most", "direct", F.col("nxt").alias("last"), F.concat("path", F.array("nxt")).alias("path"))
            .withColumn("n", F.row_number().over(among))
            .where((F.col("n") <= cap) | ~F.col("direct"))
            .drop("n")
        )
        if paths.isEmpty():
            return found


def dependency_cycles(edges: DataFrame, max_len: int | None = None, cap: int = FACT_CAPS["cycles"]) -> DataFrame:
    """The first ``cap`` simple cycles per project, shortest first, smallest file first in each.

    Cycles have any length unless ``max_len`` is given. Each file's shortest cycle among the files
    after it in name order is found first; the ``cap``-th shortest of them bounds what is written
    out. A walk from such a file that returns before its shortest cycle and the shortest one after it
    could both be walked is a cycle itself, so the many ways round a layered graph are cut to
    ``cap`` per file and length. Only projects that have fewer cycles than ``cap`` up to
    there, and longer ones beside, have their longer cycles written out path by path.
    """
    edges = edges.distinct()
    loops = edges.where("importer = importee").select(
        "project_id", F.col("importer").alias("cycle"), F.lit(1).alias("length")
    )
    core = _cyclic_core(edges)
    found = cut_lineage(loops)
    if not core.isEmpty():
        ways = _ways_back(core, cap, max_len)
        own = cut_lineage(ways.where("node = start").groupBy("project_id", "start").agg(F.min("d").alias("shortest")))
        # the shortest cycle among later starts, through the last start of each length
        last = own.groupBy("project_id", F.col("shortest").alias("later")).agg(F.max("start").alias("last"))
        later = own.join(last, "project_id").where("last > start").groupBy("project_id", "start").agg(F.min("later").alias("later"))
        own = own.join(later, ["project_id", "start"], "left")
        nth = F.row_number().over(Window.partitionBy("project_id").orderBy("shortest", "start"))
        most = own.withColumn("n", nth).where(F.col("n") <= cap).groupBy("project_id").agg(F.max("shortest").alias("most"))
        near = own.join(most, "project_id").where("shortest <= most")
        direct = F.col("later").isNull() | (F.col("most") < F.col("shortest") + F.col("later"))
        found = cut_lineage(found.unionByName(_grown_cycles(near.withColumn("direct", direct), core, ways, cap)))
        enough = found.groupBy("project_id").count().where(F.col("count") >= cap)
        rest = own.join(enough, "project_id", "left_anti").select("project_id", "start", F.lit(max_len).cast("int").alias("most"), F.col("later").isNull().alias("direct"))
        if not rest.isEmpty():
            found = found.unionByName(_grown_cycles(rest, core, ways, cap)).distinct()
    w = Window.partitionBy("project_id").orderBy("length", "cycle")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)


def tested_by(edges: DataFrame) -> DataFrame:
    """``(project_id, path, test_path)``: source files and the test files that import them."""
    return (
        edges.where(F.col("importer").rlike(TEST_FILE) & ~F.col("importee").rlike(TEST_FILE))
        .select("project_id", F.col("importee").alias("path"), F.col("importer").alias("test_path"))
        .distinct()
    )


def manifest_entries(packages: DataFrame) -> DataFrame:
    """``packages(project_id, manifest)`` to the paths its entry fields name, with ``dist`` also as ``src``."""
    m = packages.withColumn("m", F.from_json("manifest", "map<string,string>"))
    fields = [F.col("m")[f] for f in ("main", "module", "types", "exports", "bin")]
    quoted = r'"((?:[^"\\]|\\.)*)"\s*(:?)'

    def strings(f: Column) -> Column:
        """The field itself, or every string value (not key) inside it."""
        pairs = F.arrays_zip(_all(f, quoted, 1).alias("s"), _all(f, quoted, 2).alias("colon"))
        values = F.transform(F.filter(pairs, lambda x: x["colon"] == ""), lambda x: x["s"])
        none = F.array().cast("array<string>")
        return F.when(f.isNull(), none).when(f.rlike(r"^\s*[{\[]"), values).otherwise(F.array(f))

    nested = F.concat(*[strings(f) for f in fields])
    e = m.select("project_id", F.explode(nested).alias("raw"))
    e = e.withColumn("p", F.regexp_replace("raw", r"^\./", ""))
    src = F.regexp_replace(F.concat(F.lit("src/"), F.regexp_replace("p", "^dist/", "")), r"\.[cm]?js$", ".ts")
    both = F.when(F.startswith("p", F.lit("dist/")), F.array("p", src)).otherwise(F.array("p"))
    return e.select("project_id", F.explode(both).alias("path")).distinct()


def library_flag(packages: DataFrame) -> DataFrame:
    m = F.from_json("manifest", "map<string,string>")
    lib = (m["exports"].isNotNull() | m["main"].isNotNull()) & m["bin"].isNull()
    return packages.select("project_id", lib.alias("is_library"))


def public_api(packages: DataFrame, files: DataFrame, cap: int = FACT_CAPS["public_api"]) -> DataFrame:
    """Files reachable from the package entries over re-exports, nearest first, ``cap`` per project.

    A project stops growing when it has ``cap`` files: nearer ones rank first.
    """
    text = files.where(F.contains("content", F.lit("export"))).select(
        "project_id", "path", F.explode(F.array_distinct(_all(F.col("content"), REEXPORT))).alias("spec")
    )
    links = cut_lineage(
        resolve_imports(text, files, REEXPORT_EXTENSIONS).select("project_id", "path", F.col("target").alias("nxt"))
    )
    known = files.select("project_id", "path").distinct()
    found = cut_lineage(
        manifest_entries(packages).join(known, ["project_id", "path"], "left_semi").withColumn("depth", F.lit(0))
    )
    frontier, depth = found, 0
    while not frontier.isEmpty():
        depth += 1
        full = found.groupBy("project_id").count().where(F.col("count") >= cap).select("project_id")
        new = (
            frontier.join(full, "project_id", "left_anti")
            .join(links, ["project_id", "path"])
            .select("project_id", F.col("nxt").alias("path"))
            .distinct()
            .join(found, ["project_id", "path"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut_lineage(new)
        found = found.unionByName(frontier)
    w = Window.partitionBy("project_id").orderBy("depth", "path")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)


def _first(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    w = Window.partitionBy("project_id").orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)


def build_time_files(files: DataFrame, cap: int = FACT_CAPS["build"]) -> DataFrame:
    return _first(files.where(F.col("path").rlike(BUILD_FILE)).select("project_id", "path"), ["path"], cap)


def validator_deps(packages: DataFrame) -> DataFrame:
    """Known validation libraries among a package's dependencies, in the fixed order."""
    m = F.from_json("manifest", "map<string,string>")
    names = lambda f: F.coalesce(F.map_keys(F.from_json(m[f], "map<string,string>")), F.array().cast("array<string>"))
    have = F.concat(names("dependencies"), names("devDependencies"))
    libs = F.array(*[F.lit(v) for v in VALIDATOR_LIBS])
    return packages.select(
        "project_id", F.posexplode(F.filter(libs, lambda v: F.array_contains(have, v))).alias("n", "library")
    )


def module_globals(files: DataFrame, cap: int = FACT_CAPS["globals"]) -> DataFrame:
    """Module-level maps and sets, and whether the file ever deletes from or clears them."""
    found = F.arrays_zip(
        _all(F.col("content"), MODULE_GLOBAL, 1).alias("name"), _all(F.col("content"), MODULE_GLOBAL, 2).alias("kind")
    )
    d = files.where(~F.col("path").rlike(TEST_FILE) & F.col("content").rlike(MODULE_GLOBAL))
    d = d.select("project_id", "path", "content", F.posexplode(found).alias("pos", "g")).select(
        "project_id", "path", "pos", "g.name", "g.kind",
        (F.contains("content", F.concat("g.name", F.lit(".delete(")))
         | F.contains("content", F.concat("g.name", F.lit(".clear(")))).alias("has_cleanup"),
    )
    first = d.groupBy("project_id", "path", "name").agg(
        F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"), F.bool_or("has_cleanup").alias("has_cleanup")
    )
    return _first(first, ["path", "pos"], cap)


def _section(df: DataFrame, no: int, head: str, text: Column, order: list[str], cap: int | None, total: DataFrame | None = None) -> DataFrame:
    """Rendered section per project: the first ``cap`` lines and how many more there are."""
    d = df.select("project_id", *order, text.alias("text"))
    if total is None:
        total = d.groupBy("project_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("project_id").orderBy(*order)
    shown = d.withColumn("i", F.row_number().over(w))
    more = F.lit("")
    if cap:
        shown = shown.where(F.col("i") <= cap)
        more = F.when(
            F.col("total") > cap, F.concat(F.lit("\n  ... and "), (F.col("total") - cap).cast("string"), F.lit(" more"))
        ).otherwise("")
    lines = F.transform(F.array_sort(F.col("l")), lambda x: F.concat(F.lit("  - "), x["text"]))
    return (
        shown.groupBy("project_id")
        .agg(F.collect_list(F.struct("i", "text")).alias("l"))
        .join(total, "project_id")
        .select("project_id", F.lit(no).alias("no"), F.concat(F.lit(head + "\n"), F.array_join(lines, "\n"), more).alias("text"))
    )


def render_repo_context(
    cycles: DataFrame, tested: DataFrame, api: DataFrame, library: DataFrame, build: DataFrame, validators: DataFrame,
    globals_: DataFrame,
) -> DataFrame:
    """One text per project that has any fact; every list is capped before it is gathered."""
    start = F.regexp_extract("cycle", "^([^>]*)", 1)
    listed = _first(tested.select("project_id", "path").distinct(), ["path"], FACT_CAPS["tested"] + 1)
    tests = (
        tested.join(listed.select("project_id", "path"), ["project_id", "path"], "left_semi")
        .groupBy("project_id", "path")
        .agg(F.array_join(F.array_sort(F.collect_list("test_path")), ", ").alias("tests"))
    )
    n_tested = tested.select("project_id", "path").distinct().groupBy("project_id").agg(F.count("*").alias("total"))
    caps = FACT_CAPS
    sections = [
        _section(cycles, 1, "DEPENDENCY CYCLES (defects — report under architecture):",
                 F.concat(F.replace("cycle", F.lit(">"), F.lit(" -> ")), F.lit(" -> "), start), ["length", "cycle"], caps["cycles"]),
        _section(tests, 2, "FILES WITH TEST COVERAGE (do not report these as untested):",
                 F.concat("path", F.lit(" (tested by: "), "tests", F.lit(")")), ["path"], caps["tested"], n_tested),
        _section(api, 3, "PUBLIC API FILES (exports here are consumed by library users — do not report as dead code):",
                 F.col("path"), ["depth", "path"], caps["public_api_shown"]),
        _section(build, 5, "BUILD-TIME FILES (not runtime-reachable — deprioritize injection/XSS findings here):",
                 F.col("path"), ["path"], None),
        validators.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("n", "library"))).alias("v")).select(
            "project_id", F.lit(6).alias("no"),
            F.concat(F.lit("VALIDATION LIBRARIES PRESENT: "), F.array_join(F.transform("v", lambda x: x["library"]), ", ")).alias("text")),
        _section(globals_, 7, "MODULE-LEVEL COLLECTIONS (check for unbounded growth; entries without cleanup are leak candidates):",
                 F.concat("path", F.lit(": "), "name", F.lit(" ("), "kind",
                          F.when(F.col("has_cleanup"), ", has delete/clear)").otherwise(", no delete/clear found)")),
                 ["path", "pos"], caps["globals"]),
    ]
    facts = reduce(DataFrame.unionByName, sections)
    kind = F.when(F.col("is_library"), "library (unused-looking exports may be public API)").otherwise("application")
    typed = facts.select("project_id").distinct().join(library, "project_id", "left").select(
        "project_id", F.lit(4).alias("no"), F.concat(F.lit("PROJECT TYPE: "), kind).alias("text")
    )
    return (
        facts.unionByName(typed)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("s"))
        .select("project_id", F.concat(
            F.lit("=== REPOSITORY CONTEXT (facts derived from the whole repo — trust these over per-chunk guesses) ===\n"),
            F.array_join(F.transform("s", lambda x: x["text"]), "\n"),
            F.lit("\n=== END REPOSITORY CONTEXT ===")).alias("context"))
    )
