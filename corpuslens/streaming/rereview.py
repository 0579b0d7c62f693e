"""Re-review of changed files: detect, merge, and keep the findings of every file up to date in a stored table.

The table is ``folder/bucket=B/version=N``. A micro-batch writes a new version of the buckets its files
fall into and leaves all others alone; readers take the newest version of each bucket. As batch ``N`` is
computed from versions below ``N`` only, running it again writes the same rows, and one that was cut off
has damaged nothing that came before. A folder belongs to one stream checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpuslens.constants import WATCHED_FILES
from corpuslens.functions.ordered import numbered
from corpuslens.operators.detectors import Detector, run_detectors
from corpuslens.operators.findings import merge_findings
from corpuslens.operators.scope import with_language
from corpuslens.session import discard, stored
from corpuslens.streaming.watch import bound_files, review_stream

BUCKETS = 64
FINDINGS = (
    "project_id long, path string, seq long, line_start int, line_end int, severity string, title string, "
    "description string, agent_name string, score_penalty double"
)
STORED = FINDINGS + ", entered long, bucket int, version long"
FILE = ["project_id", "path"]


def review_files(files: DataFrame, rules: list[Detector]) -> DataFrame:
    """Merged findings of ``files(project_id, path, content)``; duplicates only merge inside a file.

    A file without findings has no row. ``seq`` follows project, path and line within one call.
    """
    found = run_detectors(with_language(files), rules).withColumn("line_end", F.col("line_start"))
    found = numbered(found.withColumnRenamed("text", "description"), [*FILE, "line_start", "agent_name", "title"], "seq")
    columns = [c.split()[0] for c in FINDINGS.split(", ")]
    return merge_findings(found.select(*columns)).select(*columns)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*FILE), F.lit(buckets)).cast("int"))


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame:
    """Rows of the newest version of each bucket, its marker row (without a path) included."""
    path, store = _files(spark, folder)
    if not store.exists(path):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(folder)
    if below is not None:
        rows = rows.where(F.col("version") < below)
    # a row per bucket: every version has one marker
    last = rows.where("path IS NULL").groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(last, ["bucket", "version"])


def merge_batch(findings: DataFrame, reviewed: DataFrame, folder: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Replace the stored findings of the ``reviewed(project_id, path)`` files by those in ``findings``.

    A reviewed file without findings leaves the table; files that are not in ``reviewed`` keep what they have.
    ``entered`` is the batch in which a file last came to have findings. Rows of ``findings`` for files not
    reviewed are left out. Running a batch again changes nothing.
    """
    spark = findings.sparkSession
    files = stored(_bucketed(reviewed.select(*FILE).where("path IS NOT NULL").distinct(), buckets), "reviewed")
    touched = files.select("bucket").distinct()
    old = _newest(spark, folder, batch_id).join(touched, "bucket", "left_semi").where("path IS NOT NULL").drop("version")
    kept = old.join(files, FILE, "left_anti")
    since = old.groupBy(*FILE).agg(F.min("entered").alias("entered"))
    new = (
        findings.join(files, FILE)
        .join(since, FILE, "left")
        .withColumn("entered", F.coalesce("entered", F.lit(batch_id).cast("long")))
    )
    rows = kept.unionByName(new.select(*kept.columns)).unionByName(touched, allowMissingColumns=True)
    (
        rows.withColumn("version", F.lit(batch_id).cast("long"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", *FILE, "seq")
        .write.partitionBy("bucket", "version")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(folder)
    )
    _forget(spark, folder, batch_id)
    discard(files)


def _forget(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Delete versions that neither a reader nor a repetition of the batch needs: two a bucket stay."""
    _, store = _files(spark, folder)
    held: dict[str, list[tuple[int, object]]] = {}
    for status in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder + "/bucket=*/version=*")) or []:
        at = status.getPath()
        held.setdefault(at.getParent().getName(), []).append((int(at.getName().split("=")[1]), at))
    for versions in held.values():
        before = sorted((v for v in versions if v[0] < batch_id), key=lambda v: v[0])
        for _, at in before[:-1]:
            store.delete(at, True)


def stored_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every file as of the last batch."""
    return _newest(spark, folder).where("path IS NOT NULL").drop("bucket", "version")


def watched_findings(spark: SparkSession, folder: str, limit: int = WATCHED_FILES) -> DataFrame:
    """``stored_findings`` of the ``limit`` files per project that entered last."""
    rows = stored_findings(spark, folder)
    files = rows.select(*FILE, F.col("entered").alias("first_seen"), F.col("path").alias("first_seq")).distinct()
    return rows.join(bound_files(files, limit).select(*FILE), FILE, "left_semi")


def rereview_stream(
    fires: DataFrame, read: Callable[[DataFrame], DataFrame], rules: list[Detector], folder: str, checkpoint: str,
    once: bool = False, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Review the files of every micro-batch of ``fires(path)`` and merge the outcome into ``folder``.

    ``read`` turns changed paths into ``project_id, path, content``. A file it does not return, or returns
    with a NULL content, could not be read and keeps its findings; so a failed read never shows as clean.
    """

    def review(paths: DataFrame, batch_id: int) -> None:
        files = stored(read(paths).where("content IS NOT NULL"), "changed")
        merge_batch(review_files(files, rules), files, folder, batch_id, buckets)
        discard(files)

    return review_stream(fires, review, checkpoint, once)
