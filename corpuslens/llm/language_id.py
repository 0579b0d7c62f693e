"""Language of web pages by fusing evidence in one posterior.

Text speaks through hashed word and character n-gram likelihoods, the markup through how often
it declares a language when the text is in another, the address through the languages seen on
its host, smoothed towards those of its suffix and these towards those of all pages. The counts
behind declaration, suffix and host come from grouped sums over all pages; a page never counts
as evidence for itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.host_reputation import host_of, suffix_of
from corpuslens.llm.quality_classifier import BUCKETS, features, subwords
from corpuslens.session import stored

#: Bound, per language, of the sample of labelled texts that the likelihoods are fitted on.
SAMPLE = 2000
#: N-grams overlap, so a text counts as this many independent ones at most.
GRAMS = 40
#: Weight, in pages, of the level above in host and suffix priors, and of the flat prior of declarations.
SMOOTH = 5.0
WORDS_KEPT = 200_000

_HIDDEN = re.compile(r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"


def visible(markup: str) -> str:
    """Text of a page without markup, scripts, styles, comments, navigation and foot."""
    return html.unescape(_HIDDEN.sub(" ", markup))


def likelihoods(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log likelihoods per bucket and language, from at most ``sample`` texts of each language labelled."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    # so many ids of small hash hold the sample of each language, however frequent it is
    many = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("many"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    few = rows.select("lang", "doc_id").join(F.broadcast(many), "lang").where(share * F.col("many") <= 2 * sample).select("lang", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = few.withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")
    # the sample is bounded by the parameter and the languages, so sending its ids to every task is too
    picked = rows.select("doc_id", "lang", F.col("text").cast("string")).join(F.broadcast(ids), ["lang", "doc_id"])
    picked = picked.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                ["lang", "ids", "share"],
            )

    shares = picked.select("lang", "text").mapInArrow(counted, "lang string, ids array<long>, share array<float>")
    sums = (
        shares.select("lang", F.explode(F.arrays_zip("ids", "share")).alias("x"))
        .groupBy("lang", F.col("x.ids").alias("id"))
        .agg(F.sum("x.share").alias("n"))
    )
    languages = sorted(r["lang"] for r in many.collect())
    table = np.zeros((BUCKETS, max(1, len(languages))))
    found = sums.toArrow() if languages else None  # languages times buckets at most
    if found is not None and len(found):
        at = {lang: i for i, lang in enumerate(languages)}
        column = np.array([at[x] for x in found["lang"].to_pylist()])
        table[found["id"].to_numpy(), column] = found["n"].to_numpy()
    share = table / np.maximum(table.sum(0), 1e-9)
    return languages, np.log(share + 1e-6).astype(np.float32)


def _read(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """``page_id, host, suffix, declared, text``: ``text`` has a log likelihood per language."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        sums, counts = np.zeros((0, len(languages))), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for low in range(0, batch.num_rows, 256):
                texts = [visible(t.as_py() or "").encode("utf-8", "replace").split() for t in batch.column("html")[low : low + 256]]
                if len(index) > WORDS_KEPT:
                    index, sums, counts = {}, sums[:0], counts[:0]
                if new := list(set().union(*texts).difference(index)):
                    _, ids, start = subwords(new)
                    index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
                    sums = np.concatenate([sums, np.add.reduceat(table[ids].astype(np.float64), start, axis=0)])
                    counts = np.concatenate([counts, np.diff(np.append(start, len(ids)))])
                for words in texts:
                    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    n = counts[at].sum()
                    out.append(sums[at].sum(0) / n * min(n, GRAMS) if n else np.zeros(len(languages)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "suffix", "declared")), pa.array(out, pa.list_(pa.float64()))],
                ["page_id", "host", "suffix", "declared", "text"],
            )

    host = host_of(F.col("url").cast("string"))
    declared = F.lower(F.regexp_extract("html", _DECLARED, 1))
    return pages.select(
        F.col("page_id").cast("long"), host.alias("host"), suffix_of(host).alias("suffix"),
        F.coalesce(declared, F.lit("")).alias("declared"), F.col("html").cast("string"),
    ).mapInArrow(scored, "page_id long, host string, suffix string, declared string, text array<double>")


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``page_id, lang, confidence, text_lang, declared, host`` per page row.

    ``text_lang`` is what the text alone says, NULL without words. NULL or empty markup leaves
    the decision to address and declaration; a NULL url has the empty host. Without labelled
    texts ``lang`` is NULL and ``confidence`` 0. Repeated rows are pages of their own and weigh
    like them. Other columns are ignored.
    """
    languages, table = likelihoods(docs.select("doc_id", "lang", "text"), sample)
    if not languages:
        none = F.lit(None).cast("string")
        return _read(pages, [""], table).select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "host")
    read = stored(_read(pages, languages, table), "pages")
    names = F.array(*map(F.lit, languages))
    spoken = F.exists("text", lambda x: x != 0)
    top = F.array_position(F.col("text"), F.array_max("text")).cast("int")
    first = read.withColumn("first", F.when(spoken, top))

    def counts(key: str) -> DataFrame:
        each = [F.count(F.when(F.col("first") == i + 1, 1)).cast("double") for i in range(len(languages))]
        return first.groupBy(key).agg(F.array(*each).alias(f"{key}_n"))

    total = first.agg(*[F.count(F.when(F.col("first") == i + 1, 1)).alias(f"n{i}") for i in range(len(languages))]).first()
    all_n = np.array([total[f"n{i}"] for i in range(len(languages))], float)
    overall = ((all_n + 1) / (all_n + 1).sum()).tolist()
    declarations = max(1, first.select("declared").distinct().count())
    joined = first.join(counts("host"), "host").join(counts("suffix"), "suffix").join(counts("declared"), "declared")

    def score(i: Column) -> Column:
        own = F.coalesce((F.col("first") == i + 1).cast("double"), F.lit(0.0))
        one = F.when(F.col("first").isNull(), 0.0).otherwise(1.0)

        def level(key: str, above: Column) -> Column:
            n = F.col(f"{key}_n")
            return (F.get(n, i) - own + SMOOTH * above) / (F.aggregate(n, F.lit(0.0), lambda a, x: a + x) - one + SMOOTH)

        prior = level("host", level("suffix", F.get(F.array(*map(F.lit, overall)), i)))
        of_lang = F.get(F.array(*map(F.lit, all_n.tolist())), i) - own
        said = (F.get(F.col("declared_n"), i) - own + SMOOTH / declarations) / (of_lang + SMOOTH)
        return F.get(F.col("text"), i) + F.log(prior) + F.log(said)

    scores = joined.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), score))
    best = F.array_max("scores")
    share = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    return scores.select(
        "page_id", F.get(names, (F.array_position("scores", best) - 1).cast("int")).alias("lang"), (1 / share).alias("confidence"),
        F.get(names, F.col("first") - 1).alias("text_lang"), "declared", "host",
    )
