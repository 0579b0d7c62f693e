"""Corpus preparation in stages, each reading what the one before has kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.llm import (
    benchmark_decontamination,
    best_fit_packing,
    line_dedup,
    minhash_near_dedup,
    quality_classifier,
)
from corpuslens.session import discard, stored


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` in which no column but ``own`` has a name of its own, and what names them as before.

    So no working column of an operator can meet one of the table.
    """
    working = [c if c in own else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*working), [F.col(w).alias(c) for w, c in zip(working, docs.columns, strict=True)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    NULL and empty texts get the score of a text without words, repeated rows one decision each. Without labelled
    rows nothing is rejected; an empty table stays empty.
    """
    slim, back = aside(docs, "doc_id", "text")
    scored = quality_classifier.classify(slim, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of several lines that stand earlier.

    A passage of several lines and over 50 words goes if it stands whole at one earlier place. A text of which
    only blank lines are left goes; ``n_chars`` follows the text where it was cut. NULL and empty texts stay as
    they are, repeated rows are one document and stay each, an empty table stays empty.
    """
    slim, back = aside(docs, "doc_id", "text", "n_chars")
    left = line_dedup.deduplicated(slim, passages=True)
    cut = F.col("removed_lines") > 0
    kept = left.where(~cut | F.col("text").cast("string").rlike(r"[^ \n]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return kept.select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that shares 80 in 100 of its five-word shingles.

    Of rows with equal ids one stays. Rows without an id cannot be named in a group: of those
    with equal texts one stays.
    """
    slim, back = aside(docs, "doc_id", "text")
    kept = minhash_near_dedup.near_duplicates(slim).where("kept")
    ids = kept.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    one = Window.partitionBy("_id").orderBy(F.xxhash64("text"))
    named = slim.withColumn("_id", F.col("doc_id").cast("long")).join(ids, "_id", "left_semi")
    named = named.withColumn("_copy", F.row_number().over(one)).where("_copy = 1").drop("_id", "_copy")
    unnamed = slim.where(F.col("doc_id").cast("long").isNull()).dropDuplicates(["text"])
    return named.unionByName(unnamed).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item recurs.

    NULL and empty texts hold no item and stay, as all rows do without items; repeated rows share one decision.
    """
    slim, back = aside(docs, "doc_id", "text")
    left = benchmark_decontamination.decontaminate(slim, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return left.select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens.

    A NULL or empty text is its end mark alone, repeated rows are packed each, an empty table gives no piece.
    """
    return best_fit_packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier and the tokenizer cannot be expressed in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(docs, "stored_path"):
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
