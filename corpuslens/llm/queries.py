"""Queries over the synthetic tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import (
    benchmark_decontamination,
    best_fit_packing,
    hard_negatives,
    host_reputation,
    inverted_multi_index,
    language_id,
    line_dedup,
    minhash_near_dedup,
    personal_data,
    quality_classifier,
    ranked_search,
    suffix_array_dedup,
    vector_approximation,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which half the words or more recur in the document."""
    found = benchmark_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@query
def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return inverted_multi_index.nearest(vectors, F.col("vec_id") % 100 == 0)


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the rules' spans, and all spans."""
    found = personal_data.find(table(spark, sf_dir, "documents"))
    counts = [
        (F.size("base") - F.size(F.array_remove(F.transform("base", lambda x: x["k"]), k))).cast("long").alias(f"n_{kind}")
        for k, kind in enumerate(personal_data.KINDS)
    ]
    written = personal_data.written
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. A page's outcome is the label of the document whose number its path carries."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(host_reputation.path_of(F.col("url")), "^/[^/]+/([0-9]{1,18})", 1).try_cast("long")
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    outcomes = pages.select("page_id", number.alias("doc_id")).join(bad, "doc_id").select("page_id", "bad")
    judged = host_reputation.judged(pages, outcomes, URL_RULES)
    return judged.withColumn("bound", F.round("bound", 6))


ORACLE["op4_host_reputation"] = r"""
WITH located AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), outcomes AS (
    SELECT page_id, max(bad) AS bad
    FROM located JOIN (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id) l
        ON l.doc_id = TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]{1,18})', 1) AS BIGINT)
    GROUP BY page_id
), hosts AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
        regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS plain
    FROM located LEFT JOIN outcomes USING (page_id) GROUP BY host
), named AS (
    SELECT host, n, bad,
        CASE WHEN regexp_full_match(plain, '[0-9.]*') THEN plain ELSE regexp_extract(plain,
            '((?:[^.]*\.)?(?:(?:(?:ac|co|com|edu|gov|ne|net|or|org)\.[a-z]{2})|[^.]*))$', 1) END AS domain,
        CASE WHEN regexp_full_match(plain, '[0-9.]*') THEN plain ELSE regexp_extract(plain,
            '(?:^|\.)((?:(?:ac|co|com|edu|gov|ne|net|or|org)\.[a-z]{2})|[^.]*)$', 1) END AS suffix
    FROM hosts
), domains AS (
    SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY suffix, domain
), suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix
), levels AS (
    SELECT 1 AS level, n, bad FROM suffixes UNION ALL SELECT 2, n, bad FROM domains UNION ALL SELECT 3, n, bad FROM named
), sums AS (
    SELECT level, count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS n2,
        sum(bad * bad / n::DOUBLE) AS b2, sum(bad) / sum(n)::DOUBLE AS p
    FROM levels WHERE n > 0 GROUP BY level
), rhos AS (
    SELECT level, CASE WHEN k < 2 OR bad = 0 OR bad = n OR (n - n2 / n - (k - 1)) * p * (1 - p) <= 0 THEN 0
        ELSE (b2 - bad * p - (k - 1) * p * (1 - p)) / ((n - n2 / n - (k - 1)) * p * (1 - p)) END AS rho
    FROM sums
), weights AS (
    SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 10000) ELSE 10000 END AS w, level FROM rhos
), s AS (
    SELECT suffix, (bad + w * (SELECT (sum(bad) + 1) / (sum(n) + 2)::DOUBLE FROM suffixes)) / (n + w) AS above
    FROM suffixes, weights WHERE level = 1
), d AS (
    SELECT suffix, domain, (bad + w * above) / (n + w) AS above FROM domains JOIN s USING (suffix), weights WHERE level = 2
), h AS (
    SELECT host, n, (bad + w * above) / (n + w) AS share, w FROM named JOIN d USING (suffix, domain), weights WHERE level = 3
), judged AS (
    SELECT page_id, host, path, n AS labelled, share - 1.645 * sqrt(share * (1 - share) / (n + w + 1)) AS bound,
        CASE
            WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
        END AS rule
    FROM located JOIN h USING (host)
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
    WHEN rule IS NULL AND bound > 0.4 THEN 'block' ELSE 'allow' END AS verdict, labelled, round(bound, 6) AS bound
FROM judged
"""


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; text likelihoods are learned from labelled documents."""
    found = language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.withColumn("confidence", F.round("confidence", 6))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunk removal leaves of every document: its counters and the digest of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.deduplicated(docs)
    return left.select(
        "doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5")
    )


ORACLE["op6_line_dedup"] = r"""
WITH lined AS (
    SELECT doc_id, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS lines FROM documents
), each AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n_lines FROM lined
), hashed AS (
    SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM each
), rolled AS (
    SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 3 = 0 AS marked FROM hashed
), ended AS (
    SELECT *, i = n_lines OR (i > 1 AND i < n_lines - 1 AND marked AND NOT lag(marked) OVER (PARTITION BY doc_id ORDER BY i)) AS ends
    FROM rolled
), placed AS (
    SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
    FROM ended
), chunks AS (
    SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n,
        count(*) FILTER (WHERE length(trim(line, ' ')) > 0) AS filled
    FROM placed GROUP BY doc_id, c
), marked AS (
    SELECT *, filled >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, c) > 1 AS gone FROM chunks
), left_over AS (
    SELECT doc_id, sum(n) AS n_lines, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks,
        coalesce(sum(n) FILTER (WHERE gone), 0) AS removed_lines,
        coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (WHERE NOT gone), '') AS kept
    FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_chunks, 0)::INT AS n_chunks,
    coalesce(removed_chunks, 0)::INT AS removed_chunks, coalesce(removed_lines, 0)::INT AS removed_lines, md5(coalesce(kept, '')) AS kept_md5
FROM documents LEFT JOIN left_over USING (doc_id)
"""


@query
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes under 200-byte strings that occur anywhere else."""
    found = suffix_array_dedup.deduplicated(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return best_fit_packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: shared 3-word shingles, similarity of 0.85."""
    return minhash_near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, need=85)


#: Exact components: any pair at the bar shares one of the rarest shingles of each side.
ORACLE["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
    FROM words
), items AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), ranked AS (
    SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM items)
), pairs AS (
    SELECT DISTINCT p.doc_id AS a, q.doc_id AS b
    FROM ranked p JOIN ranked q ON p.x = q.x AND p.doc_id <> q.doc_id
    WHERE p.r <= p.n - ceil(0.85 * p.n) + 1 AND q.r <= q.n - ceil(0.85 * q.n) + 1
), links AS (
    SELECT a, b FROM pairs JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b
    WHERE 100 * len(list_intersect(s.s, t.s)) >= 85 * (len(s.s) + len(t.s) - len(list_intersect(s.s, t.s)))
), reach(doc_id, root) AS (
    SELECT a, b FROM links
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.root
), lowest AS (
    SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(root, s.doc_id)) AS component_id,
    s.doc_id <= coalesce(root, s.doc_id) AS kept
FROM sets s LEFT JOIN lowest l ON l.doc_id = s.doc_id
"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_ranked_search"] = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), sizes AS (
    SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM words WHERE len(w) > 0
), asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)
    GROUP BY item_id, term
), counts AS (
    SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
    FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM words) GROUP BY r, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM counts, sizes GROUP BY term
), scored AS (
    SELECT item_id, r, any_value(doc_id) AS doc_id,
        sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN counts USING (term) JOIN weights USING (term), sizes GROUP BY item_id, r
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query
def op12_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every vector whose id is divisible by 50."""
    return vector_approximation.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Vectors of whole numbers that take part in queries 12 and 13.
WHOLE_VECTORS = """
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
"""

ORACLE["op12_vector_approximation"] = f"""
WITH v AS ({WHOLE_VECTORS})
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id)::INT AS rank,
    c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor whose id is divisible by 100, ten for each of its five positives."""
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", own), F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = f"""
WITH v AS (
    SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({WHOLE_VECTORS}) WHERE label IS NOT NULL
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
