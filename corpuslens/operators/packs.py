"""Review packs: the text handed to a reviewer per batch, and its capped request lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_text() -> Column:
    """Context prefix, file header, and every line with its number."""
    lines = F.transform(
        F.split("content", "\n"), lambda l, i: F.concat((F.col("start_line") + i).cast("string"), F.lit(" | "), l)
    )
    head = F.concat(
        F.lit("=== FILE: "), "path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("–"),
        F.col("end_line").cast("string"), F.lit(") ===\n"),
    )
    return F.concat(F.coalesce("context_prefix", F.lit("")), head, F.array_join(lines, "\n"))


def output_budget(n_chunks: Column, domains: int = 0) -> Column:
    """Output tokens allowed for a reply."""
    return F.greatest(F.lit(4096), n_chunks * 1000 + F.lit(domains * 300))


def render_batches(batched: DataFrame, domains: int = 0) -> DataFrame:
    """One prompt per batch; the batch token limit bounds what is gathered."""
    order = ["file_seq", "chunk_seq", "piece"]
    return (
        batched.withColumn("text", numbered_text())
        .groupBy("project_id", "batch_no")
        .agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("l"))
        .select(
            "project_id", "batch_no", F.size("l").alias("n_chunks"),
            output_budget(F.size("l"), domains).alias("max_tokens"),
            F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("prompt"),
        )
    )


def capped_list(rows: DataFrame, keys: list[str], text: Column, order: list[str], cap: int = 10, sep: str = "\n") -> DataFrame:
    """The first ``cap`` texts per key, and how many more there are."""
    d = rows.select(*keys, *order, text.alias("text"))
    total = d.groupBy(*keys).agg(F.count("*").alias("total"))
    shown = d.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("i") <= cap)
    note = F.when(
        F.col("total") > cap, F.concat(F.lit("\n  ...and "), (F.col("total") - cap).cast("string"), F.lit(" more (truncated)"))
    ).otherwise("")
    return (
        shown.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("l"))
        .join(total, keys)
        .select(*keys, "total", F.concat(F.array_join(F.transform("l", lambda x: x["text"]), sep), note).alias("listing"))
    )


def request_lists(requests: DataFrame) -> DataFrame:
    """Review and focus requests of a project as two capped lists."""
    place = F.concat(F.lit("  - "), "path", F.lit(":"), F.col("line").cast("string"))
    text = F.when(F.col("request") == "review", F.concat(place, F.lit(' — "'), "value", F.lit('"'))).otherwise(
        F.concat(place, F.lit(" → focus: "), "value")
    )
    wanted = requests.where("request IN ('review', 'focus')")
    return capped_list(wanted, ["project_id", "request"], text, ["path", "line"])


def changed_file_list(changed: DataFrame) -> DataFrame:
    return capped_list(changed, ["project_id"], F.col("path"), ["path"], sep=", ")
