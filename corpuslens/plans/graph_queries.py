"""Queries on the import graph and repository facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import graph, scope
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query


def one_project(df: DataFrame) -> DataFrame:
    """All files as one project: the derived imports cross the project numbers."""
    return df.withColumn("project_id", F.lit(0))


def all_edges(fx: Fixtures) -> DataFrame:
    return one_project(fx.edges)


def test_edges(fx: Fixtures) -> DataFrame:
    rename = lambda c: F.regexp_replace(c, "^src/d(1?7)/", "tests/d$1/").alias(c)
    return all_edges(fx).select("project_id", rename("importer"), rename("importee"))


@query
def extract_imports(fx: Fixtures) -> DataFrame:
    return graph.extract_imports(scope.with_language(fx.files)).select("path", "pos", "spec")


@query
def extract_other_imports(fx: Fixtures) -> DataFrame:
    """Every text again as a C++, Go and Rust file with includes and uses in front."""
    f = fx.files.select(
        "project_id",
        F.regexp_replace("path", r"\.\w+$", F.element_at(F.array(F.lit(".cpp"), F.lit(".go"), F.lit(".rs")), (F.col("file_seq") % 3 + 1).cast("int"))).alias("path"),
        F.concat(F.lit('#include <a/b.h>\nimport (\n "fmt"\n "os"\n)\nimport "net"\nuse crate::x;\n'), F.col("content")).alias("content"),
    )
    return graph.extract_imports(f).select("path", "pos", "spec")


@query
def python_imports(fx: Fixtures) -> DataFrame:
    head = F.concat(F.lit("from ..d1.f"), F.col("file_seq").cast("string"), F.lit(" import x\nfrom . import a, b\n"))
    f = fx.files.select("project_id", "path", F.concat(head, "content").alias("content"))
    return graph.python_imports(f).select("path", "spec", "target")


@query
def resolve_imports(fx: Fixtures) -> DataFrame:
    f = one_project(scope.with_language(fx.files))
    return graph.resolve_imports(graph.extract_imports(f), f).select("path", "spec", "target")


@query
def centrality(fx: Fixtures) -> DataFrame:
    return graph.centrality(all_edges(fx)).drop("project_id")


@query
def trace_dependencies(fx: Fixtures) -> DataFrame:
    seeds = one_project(fx.code_meta).select("project_id", F.col("path").alias("seed"))
    return graph.trace_dependencies(seeds, all_edges(fx), 4).drop("project_id")


@query
def shown_dependencies(fx: Fixtures) -> DataFrame:
    seeds = one_project(fx.code_meta).select("project_id", F.col("path").alias("seed"))
    return graph.shown_dependencies(graph.trace_dependencies(seeds, all_edges(fx), 3), 2).drop("project_id")


@query
def dependency_cycles(fx: Fixtures) -> DataFrame:
    """The 40 shortest cycles among all files, of whatever length."""
    return graph.dependency_cycles(all_edges(fx), cap=40).drop("project_id")


@query
def tested_by(fx: Fixtures) -> DataFrame:
    return graph.tested_by(test_edges(fx)).drop("project_id")


def packages(fx: Fixtures) -> DataFrame:
    """One manifest whose entries are the first and last file of the corpus."""
    return fx.sql(
        """SELECT CAST(min(project_id) * 0 AS INT) AS project_id, '{"name":"x","main":"./' || min(path) || '","exports":{".":{"import":"./'
        || max(path) || '","types":"./dist/d1/f1.js"}},"dependencies":{"zod":"1","left":"2"},"devDependencies":{"ajv":"8"}}'
        AS manifest FROM code_meta WHERE path LIKE '%.ts'"""
    )


def barrels(fx: Fixtures) -> DataFrame:
    """Every derived import as a re-export."""
    return one_project(fx.files).withColumn(
        "content", F.regexp_replace("content", r"import (\{ a \} from )?'", "export * from '")
    )


@query
def public_api(fx: Fixtures) -> DataFrame:
    return graph.public_api(packages(fx), barrels(fx)).select("path", "depth", "n")


@query
def package_entries(fx: Fixtures) -> DataFrame:
    e = graph.manifest_entries(packages(fx)).join(graph.library_flag(packages(fx)), "project_id")
    return e.select("path", "is_library")


@query
def build_time_files(fx: Fixtures) -> DataFrame:
    n = F.col("file_seq")
    p = F.when(n % 9 == 0, F.concat(F.lit("scripts/"), "path")).when(
        n % 10 == 0, F.regexp_replace("path", r"\.\w+$", ".config.ts")
    ).otherwise(F.col("path"))
    return graph.build_time_files(fx.files.withColumn("path", p), 20)


@query
def validator_deps(fx: Fixtures) -> DataFrame:
    return graph.validator_deps(packages(fx)).drop("project_id")


@query
def module_globals(fx: Fixtures) -> DataFrame:
    return graph.module_globals(fx.files).select("project_id", "path", "name", "kind", "has_cleanup", "n")


@query
def repo_context(fx: Fixtures) -> DataFrame:
    f, e, p = one_project(fx.files), test_edges(fx), packages(fx)
    r = graph.render_repo_context(
        graph.dependency_cycles(e), graph.tested_by(e), graph.public_api(p, barrels(fx)), graph.library_flag(p),
        graph.build_time_files(f), graph.validator_deps(p), graph.module_globals(f),
    )
    return r.select(F.length("context").alias("n_chars"), F.md5("context").alias("digest"))
