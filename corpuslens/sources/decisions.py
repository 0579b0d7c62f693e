"""Decision documents: parsing, identifiers, retention, age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import basename

RETENTION = 100
STALE_DAYS = 30


def parse_decisions(docs: DataFrame) -> DataFrame:
    """``docs(slug, doc)`` to date, file range and decision line; documents without a file range go."""
    pick = lambda p, i=1: F.nullif(F.regexp_extract("doc", p, i), F.lit(""))
    place = r"\*\*File:\*\*\s+(.+):(\d+)-(\d+)"
    rest = [c for c in docs.columns if c != "doc"]
    return docs.select(
        *rest,
        F.trim(pick(r"(?m)^\*\*Date:\*\*(.*)$")).cast("date").alias("decided_on"),
        pick(place).alias("path"),
        pick(place, 2).cast("int").alias("line_start"),
        pick(place, 3).cast("int").alias("line_end"),
        F.coalesce(F.trim(pick(r"(?m)^## Decision.*\n(.*)$")), F.lit("Unknown")).alias("decision"),
    ).where("path IS NOT NULL")


def with_slug(decisions: DataFrame) -> DataFrame:
    """Identifier: file name without extension and six hex digits over path, line and decision."""
    stem = F.nullif(F.regexp_replace(basename("path"), r"\.[^/.]+$", ""), F.lit(""))
    digest = F.md5(F.concat("path", F.col("line_start").cast("string"), "decision").cast("binary"))
    return decisions.withColumn(
        "slug", F.concat(F.coalesce(stem, F.lit("decision")), F.lit("-"), F.substring(digest, 1, 6))
    )


def retain(decisions: DataFrame, limit: int = RETENTION) -> DataFrame:
    """The newest ``limit`` decisions per project; one per slug, the last written."""
    last = decisions.groupBy("project_id", "slug").agg(F.max("modified_at").alias("modified_at"))
    w = Window.partitionBy("project_id").orderBy(F.desc("modified_at"), "slug")
    return last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def append_decisions(existing: DataFrame, new: DataFrame, path: str, limit: int = RETENTION) -> None:
    """Write the retained decisions of both tables to ``path``, partitioned by project."""
    both = existing.unionByName(with_slug(new), allowMissingColumns=True)
    kept = retain(both, limit)
    both.join(kept, ["project_id", "slug", "modified_at"], "left_semi").write.partitionBy("project_id").mode(
        "overwrite"
    ).parquet(path)


def stale_decisions(decisions: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Decisions older than ``days``, with whole days of age."""
    age = (F.unix_micros(now) - F.unix_micros("modified_at")) / F.lit(86_400_000_000)
    return decisions.withColumn("age_days", F.floor(age).cast("int")).where(age > days)
