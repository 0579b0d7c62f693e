"""Reading source trees and exported git text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions.ordered import numbered


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file system that holds it names it, with its scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def read_corpus(spark: SparkSession, root: str, project_id: int = 0, pattern: str = "*") -> DataFrame:
    """One row per file below ``root``: relative path, text, size, time of change, lines.

    ``root`` may be a plain path or in any store that Spark reads. ``file_seq`` numbers the files densely in
    path order, so it names one file alone. Spark lists the files; the numbers come from the
    list, without their contents. Empty files are not listed. ``scope.size_guard`` marks those too large for a review.
    """
    base = _qualified(spark, root).rstrip("/") + "/"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    rel = F.substring("path", F.lit(len(base) + 1), F.length("path"))
    places = numbered(raw.select(rel.alias("path")), ["path"], "file_seq")
    return (
        raw.withColumn("path", rel)
        .join(places, "path")
        .select(
            F.lit(project_id).cast("long").alias("project_id"),
            "file_seq",
            "path",
            F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("last_modified"),
        )
        .withColumn("lines_of_code", F.size(F.split("content", "\n")))
    )


def read_corpus_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A corpus already stored as a table with ``project_id, file_seq, path, content``."""
    d = spark.read.parquet(path)
    return d.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn(
        "lines_of_code", F.size(F.split("content", "\n"))
    )


def churn(log_lines: DataFrame, column: str = "value") -> DataFrame:
    """Touches per path from exported ``--name-only`` log lines."""
    keys = [c for c in log_lines.columns if c != column]
    path = F.regexp_replace(column, r"^\s+|\s+$", "")
    return (
        log_lines.select(*keys, path.alias("path"))
        .where("path <> ''")
        .groupBy(*keys, "path")
        .agg(F.count("*").alias("churn_count"))
    )


def with_churn(files: DataFrame, touches: DataFrame) -> DataFrame:
    """``churn_count`` per file, 0 for files the log never names."""
    keys = [k for k in ("project_id", "path") if k in touches.columns]
    return files.join(touches, keys, "left").withColumn("churn_count", F.coalesce("churn_count", F.lit(0)))
