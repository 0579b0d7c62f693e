"""Reading recorded JSON: score history, claims, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CATEGORY = "struct<category:string,score:double,findingCount:double,criticalCount:double,highCount:double>"
HISTORY_SCHEMA = (
    "timestamp string, runId string, score double, delta double, kind string, breakdown "
    f"struct<total:double,categories:array<{_CATEGORY}>,findingCount:double,crossAgentCount:double>"
)
CLAIM_COLUMNS = "file: string, lineStart: int, lineEnd: int, severity: string, claim: string"
TARGET_SCHEMA = "name string, description string, entry array<string>, focus array<string>"


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def parse_history(lines: DataFrame, column: str = "value") -> DataFrame:
    """One history entry per JSON text, checked field by field.

    ``valid`` is false for text that is no entry or has no finite score (kept for
    inspection); a bad breakdown becomes an empty one, a bad category row goes.
    """
    rest = [c for c in lines.columns if c != column]
    d = lines.withColumn("e", F.from_json(column, HISTORY_SCHEMA)).select(*rest, "e.*")
    b = F.col("breakdown")
    whole = b["categories"].isNotNull() & b["findingCount"].isNotNull() & b["crossAgentCount"].isNotNull() & _finite(b["total"])
    good = F.filter(
        b["categories"],
        lambda c: c["category"].isNotNull() & _finite(c["score"]) & _finite(c["findingCount"])
        & _finite(c["criticalCount"]) & _finite(c["highCount"]),
    )
    none = F.array().cast(f"array<{_CATEGORY}>")
    return d.select(
        *rest,
        F.try_to_timestamp("timestamp").alias("ts"),
        F.coalesce("runId", F.lit("")).alias("run_id"),
        "score",
        F.when(_finite(F.col("delta")), F.col("delta")).otherwise(0.0).alias("delta"),
        F.when(F.col("kind").isin("diff", "full"), F.col("kind")).alias("kind"),
        F.when(whole, b["total"]).otherwise(F.col("score")).alias("total"),
        F.when(whole, good).otherwise(none).alias("categories"),
        F.when(whole, b["findingCount"]).otherwise(0.0).alias("finding_count"),
        F.when(whole, b["crossAgentCount"]).otherwise(0.0).alias("cross_agent_count"),
        (F.col("timestamp").isNotNull() & _finite(F.col("score"))).alias("valid"),
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines history files; see ``parse_history``."""
    return parse_history(spark.read.text(path))


def read_claims(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON array of claims per file; the file name is the agent, ``seq`` the place in its array."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "")
    texts = spark.read.option("wholetext", "true").text(folder).select(name.alias("agent_name"), "value")
    claims = F.from_json("value", f"array<struct<{CLAIM_COLUMNS}>>")
    d = texts.select("agent_name", F.posexplode(claims).alias("seq", "c"))
    return d.select(F.col("seq").cast("long").alias("seq"), "agent_name", "c.file", F.col("c.lineStart").alias("line_start"), "c.claim")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Target definitions as JSON lines; ``scope.resolve_targets`` drops invalid ones."""
    return spark.read.schema(TARGET_SCHEMA).json(path)


def append_history(entries: DataFrame, path: str) -> None:
    """Add entries to the table, one folder per project; ``trim_history`` bounds what is read back."""
    entries.write.partitionBy("project_id").mode("append").parquet(path)


def read_appended_history(spark: SparkSession, path: str) -> DataFrame:
    """All entries that ``append_history`` has written."""
    return spark.read.parquet(path).withColumn("project_id", F.col("project_id").cast("long"))
