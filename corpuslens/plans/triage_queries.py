"""Queries on budgets: batches, risk, rankings, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import chunks, packing, triage
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query

BUDGET = 40_000


def pieces(fx: Fixtures) -> DataFrame:
    c = chunks.split_windows(chunks.whole_file_chunks(fx.files), 1200, 20, 5)
    return c.withColumnRenamed("part", "piece")


def measured(fx: Fixtures) -> DataFrame:
    return fx.files.withColumn("lines_of_code", F.size(F.split("content", "\n")))


def project_edges(fx: Fixtures) -> DataFrame:
    home = fx.code_meta.select("project_id", F.col("path").alias("importer"))
    return fx.edges.join(home, "importer").select("project_id", "importer", "importee")


@query
def pack_batches(fx: Fixtures) -> DataFrame:
    """Small blocks, so that batches run across many of them."""
    b = packing.pack_batches(pieces(fx), files_per_block=16, blocks_per_group=4)
    return b.select("chunk_id", "piece", "token_count", "batch_no")


@query
def batch_counts(fx: Fixtures) -> DataFrame:
    soft, _ = packing.combined_limits(True, 16_000, None)
    return packing.batch_counts(pieces(fx), soft)


@query
def risk_scores(fx: Fixtures) -> DataFrame:
    """Risk of every file under a name derived from its number."""
    words = ["auth", "api", "store", "guardType", "vm", "billing", "util", "config", "mock", "dto", "plain"]
    name = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("file_seq") % 11 + 1).cast("int"))
    f = measured(fx).withColumn("path", F.concat(F.lit("src/"), name, F.lit("/"), F.regexp_replace("path", "^src/", "")))
    return triage.risk_score(f).select("file_seq", "risk")


@query
def select_by_risk(fx: Fixtures) -> DataFrame:
    s = triage.select_by_risk(measured(fx), pieces(fx), BUDGET)
    return s.select("project_id", "path", "chunk_seq", "piece", "size", "spent")


def ranking(fx: Fixtures) -> DataFrame:
    n = F.col("file_seq")
    name = (
        F.when(n % 4 == 0, F.concat(F.lit("./"), "path"))
        .when(n % 4 == 1, F.regexp_replace("path", "^src/d[0-9]+/", ""))
        .when(n % 4 == 2, F.upper("path"))
        .otherwise("nowhere.ts")
    )
    return fx.code_meta.select(
        "project_id", ((n * 7919) % 10007).cast("double").alias("rank"), name.alias("name")
    )


@query
def resolve_ranking(fx: Fixtures) -> DataFrame:
    return triage.resolve_ranking(ranking(fx), fx.files)


@query
def select_by_ranking(fx: Fixtures) -> DataFrame:
    s = triage.select_by_ranking(ranking(fx), fx.files, pieces(fx), project_edges(fx), BUDGET)
    return s.select("project_id", "path", "chunk_seq", "piece", "size", "spent", "phase")


@query
def estimate_cost(fx: Fixtures) -> DataFrame:
    p = F.col("project_id")
    names = ["groq", "cerebras", "openrouter", "ollama", "other"]
    config = fx.files.select("project_id").distinct().select(
        "project_id",
        F.lit(8).alias("agents"),
        (p % 2).alias("custom_agents"),
        (p == 3).alias("combined"),
        F.element_at(F.array(*[F.lit(x) for x in names]), (p + 1).cast("int")).alias("primary_provider"),
        F.when(p == 1, "gpt-oss-120b").when(p == 2, "deepseek/deepseek-r1").alias("primary_model"),
        F.when(p == 0, "groq").otherwise("openrouter").alias("synthesis_provider"),
        F.lit(None).cast("string").alias("synthesis_model"),
    )
    return triage.estimate_cost(pieces(fx), config, triage.price_table(fx.spark))
