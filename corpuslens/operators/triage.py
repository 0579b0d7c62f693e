"""Choosing what fits a token budget, by risk or by an external ranking, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import (
    DEFAULT_MODELS,
    OUTPUT_TOKENS_PER_CALL,
    PRICES,
    REVIEW_TOKEN_BUDGET,
    RISK_BOUNDARY_SUBJECT,
    RISK_PATTERNS,
    RISK_TYPE_PATTERN,
    SYNTHESIS_TOKENS,
)
from corpuslens.functions.grouped import fold_groups
from corpuslens.functions.text import clean_prefix, tokens
from corpuslens.operators.packing import batch_counts
from corpuslens.session import cut_lineage


def risk_score(files: DataFrame) -> DataFrame:
    """Points for what the path suggests, plus up to five for length. Needs ``lines_of_code``."""
    p = F.lower("path")
    score = F.least(F.col("lines_of_code") / 50, F.lit(5.0))
    for pattern, points in RISK_PATTERNS:
        score = score + F.when(p.rlike(pattern), points).otherwise(0.0)
    subject, shape = RISK_BOUNDARY_SUBJECT, RISK_TYPE_PATTERN
    boundary = p.rlike(f"({subject}).*({shape})|({shape}).*({subject})")
    score = score + F.when(p.rlike(shape) & ~boundary, -2.0).otherwise(0.0)
    return files.withColumn("risk", F.round(score, 6))


def _candidates(items: DataFrame, budget: int, salts: int = 64) -> DataFrame:
    """Drop chunks the budget can never reach.

    Of equal-sized chunks the earlier always wins, so at most ``budget / size`` of
    each size matter: per project some ``budget * ln(budget)`` rows at most,
    whatever its size. Ranked within salted parts first, so a hot size is spread.
    """
    sized = items.where("size > 0 AND size <= %d" % budget)
    room = F.floor(F.lit(budget) / F.col("size"))
    part = F.pmod(F.xxhash64("path", "chunk_seq", "piece"), F.lit(salts))
    order = ["rank", "path", "chunk_seq", "piece"]
    w1 = Window.partitionBy("project_id", "size", "salt").orderBy(*order)
    w2 = Window.partitionBy("project_id", "size").orderBy(*order)
    return (
        sized.withColumn("salt", part)
        .withColumn("n", F.row_number().over(w1))
        .where(F.col("n") <= room)
        .withColumn("n", F.row_number().over(w2))
        .where(F.col("n") <= room)
        .drop("salt", "n")
    )


def _greedy(items: DataFrame, budget: int, used: DataFrame | None = None) -> DataFrame:
    """Take chunks in ``rank`` order while they fit, skipping those that do not.

    ``items(project_id, path, chunk_seq, piece, size, rank)``. Empty chunks are
    taken as long as the budget was not yet spent when their file came up.
    """
    c = _candidates(items, budget).select("project_id", "rank", "path", "chunk_seq", "piece", "size")
    c = c.join(used, "project_id", "left") if used is not None else c.withColumn("used", F.lit(0).cast("long"))

    def take(key: tuple, rows: list[tuple]) -> list[tuple]:
        spent = int(rows[0][-1] or 0)
        out = []
        for rank, path, chunk_seq, piece, size, _ in rows:
            if spent + size <= budget:
                spent += size
                out.append((key[0], path, chunk_seq, piece, rank, size, spent))
        return out

    schema = "project_id long, path string, chunk_seq int, piece int, rank double, size long, spent long"
    taken = cut_lineage(fold_groups(c, ["project_id"], ["rank", "path", "chunk_seq", "piece"], take, schema))
    full = taken.where(F.col("spent") >= budget).groupBy("project_id").agg(
        F.min(F.struct("rank", "path")).alias("cut")
    )
    empty = (
        items.where("size = 0")
        .join(full, "project_id", "left")
        .where(F.col("cut").isNull() | (F.struct("rank", "path") <= F.col("cut")))
        .select("project_id", "path", "chunk_seq", "piece", "rank", "size", F.lit(None).cast("long").alias("spent"))
    )
    return taken.unionByName(empty)


def _items(chunks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Identifiers and sizes only, written once: the text behind them is not read again."""
    return cut_lineage(
        chunks.select("project_id", "path", "chunk_seq", "piece", F.col("token_count").cast("long").alias("size")).join(
            ranks, ["project_id", "path"]
        )
    )


def select_by_risk(files: DataFrame, chunks: DataFrame, budget: int = REVIEW_TOKEN_BUDGET) -> DataFrame:
    """Chunks reviewed under the budget, riskiest files first (ties by path)."""
    ranks = risk_score(files).select("project_id", "path", (-F.col("risk")).alias("rank"))
    return _greedy(_items(chunks, ranks), budget)


def resolve_ranking(ranking: DataFrame, files: DataFrame) -> DataFrame:
    """``ranking(project_id, rank, name)`` to file paths; what stays ambiguous is dropped.

    Exact path, else a path ending in ``/name`` if it is the only one, else the
    only path equal up to case. All three are equi-joins.
    """
    r = ranking.withColumn("k", F.regexp_replace(clean_prefix(F.trim("name")), "/+$", ""))
    f = files.select("project_id", "path", clean_prefix("path").alias("clean")).distinct()
    keys = ["project_id", "k"]
    parts = F.split("clean", "/")
    tails = F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")
    )
    tails = F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<string>"))
    wanted = r.select(*keys).distinct()
    exact = f.select("project_id", F.col("clean").alias("k"), "path", F.lit(1).alias("tier"))
    suffix = f.select("project_id", F.explode(tails).alias("k"), "path", F.lit(2).alias("tier"))
    folded = (
        f.withColumn("lc", F.lower("clean"))
        .join(wanted.withColumn("lc", F.lower("k")), ["project_id", "lc"])
        .select("project_id", "k", "path", F.lit(3).alias("tier"))
    )
    hits = exact.unionByName(suffix).join(wanted, keys, "left_semi").unionByName(folded)
    single = (
        hits.groupBy(*keys, "tier")
        .agg(F.min("path").alias("path"), (F.min("path") == F.max("path")).alias("one"))
        .where("one OR tier = 1")
        .groupBy(*keys)
        .agg(F.min_by(F.struct("path", "tier"), "tier").alias("m"))
    )
    return r.join(single, keys).select("project_id", "rank", "name", "m.path", "m.tier")


def select_by_ranking(
    ranking: DataFrame, files: DataFrame, chunks: DataFrame, edges: DataFrame, budget: int = REVIEW_TOKEN_BUDGET
) -> DataFrame:
    """Ranked files first, then files that a selected file imports, while the budget lasts.

    ``edges(project_id, importer, importee)``.
    """
    ranks = resolve_ranking(ranking, files).groupBy("project_id", "path").agg(F.min("rank").cast("double").alias("rank"))
    first = _greedy(_items(chunks, ranks), budget).withColumn("phase", F.lit(1))
    chosen = first.select("project_id", "path").distinct()
    reached = (
        edges.join(chosen.withColumnRenamed("path", "importer"), ["project_id", "importer"], "left_semi")
        .select("project_id", F.col("importee").alias("path"))
        .distinct()
        .join(chosen, ["project_id", "path"], "left_anti")
        .withColumn("rank", F.lit(0.0))
    )
    used = first.groupBy("project_id").agg(F.max("spent").alias("used"))
    second = _greedy(_items(chunks, reached), budget, used).withColumn("phase", F.lit(2))
    return first.unionByName(second)


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "model_key string, price_in double, price_out double")


def model_key(provider: Column, model: Column) -> Column:
    default = F.lit("unknown")
    for p, m in DEFAULT_MODELS.items():
        default = F.when(provider == p, F.lit(m)).otherwise(default)
    name = F.when(provider == "ollama", F.lit("")).otherwise(F.coalesce(F.nullif(model, F.lit("")), default))
    return F.concat(provider, F.lit(":"), name)


def estimate_cost(chunks: DataFrame, config: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and USD of a run per (project, provider).

    ``config(project_id, agents, custom_agents, combined, primary_provider, primary_model,
    synthesis_provider, synthesis_model)``; an unknown price is NULL, a model named
    ``...free`` costs nothing, and equal providers are added up.
    """
    size = chunks.groupBy("project_id").agg(
        F.count("*").alias("total_chunks"), F.sum(tokens("content")).alias("input_tokens")
    )
    agents = (F.when(F.col("combined"), 1).otherwise(F.col("agents")) + F.col("custom_agents")).cast("long")
    d = (
        config.join(size, "project_id")
        .join(batch_counts(chunks), "project_id")
        .withColumn("agent_count", agents)
        .withColumn("calls", F.col("batches") * F.col("agent_count"))
        .withColumn("output_tokens", F.col("calls") * OUTPUT_TOKENS_PER_CALL)
        .withColumn("sent_tokens", F.col("input_tokens") * F.col("agent_count"))
        .withColumn("total_tokens", F.col("sent_tokens") + F.col("output_tokens"))
        .withColumn(
            "level", F.when(F.col("total_tokens") > 200_000, "high").when(F.col("total_tokens") > 50_000, "medium").otherwise("low")
        )
    )
    syn_in, syn_out = SYNTHESIS_TOKENS
    role = lambda name, i, o: F.struct(
        F.col(f"{name}_provider").alias("provider"),
        model_key(F.col(f"{name}_provider"), F.col(f"{name}_model")).alias("model_key"),
        i.cast("double").alias("tin"),
        o.cast("double").alias("tout"),
    )
    roles = F.array(
        role("primary", F.col("sent_tokens"), F.col("output_tokens")),
        role("synthesis", F.lit(syn_in), F.lit(syn_out)),
    )
    d = d.withColumn("role", F.explode(roles)).select("*", "role.*").drop("role")
    free = F.when(F.col("model_key").rlike("[-:/]free$"), F.lit(0.0))
    cost = F.col("tin") / 1e6 * F.coalesce("price_in", free) + F.col("tout") / 1e6 * F.coalesce("price_out", free)
    return (
        d.join(prices, "model_key", "left")
        .withColumn("cost", cost)
        .groupBy("project_id", "provider", "total_chunks", "input_tokens", "agent_count", "calls", "output_tokens",
                 "total_tokens", "level")
        .agg(F.round(F.sum("cost"), 9).alias("cost_usd"))
    )
