"""Quality classifier on learned subword embeddings.

A document is the average of learned vectors: one per word, one per character 3- and 4-gram of
its words, one per pair of neighbouring words (a repeated word is a pair of its own kind), all
hashed into one table. A softmax over the two labels sits on the average. Vectors and softmax
are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled
rows; whole texts of all documents are then scored. As the softmax is linear in the average,
scoring needs one number per table row, and words are looked up once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIMENSIONS = 8
#: Bound of the sample of labelled rows that the model is fitted on.
SAMPLE = 3000
#: Passes over the sample; a small one is gone over more often, until so many steps are made.
EPOCHS = 6
STEPS = 9000
RATE = 0.5
SEED = 7
WORDS_KEPT = 300_000

_REPEAT = np.int64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit keys; bucket 0 is empty, bucket 1 stands for a repeated word."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, buckets of its features, and where each word's features start."""
    keys = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    marked = [b"<" + w + b">" for w in words]
    size = np.array([len(w) for w in marked])
    text = np.frombuffer(b"".join(marked) + b"\0" * 4, np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    room = (start + size)[owner] - np.arange(len(owner))
    ids, whose = [_mixed(keys)], [np.arange(len(words))]
    gram = text[: len(owner)] + (text[1 : len(owner) + 1] << np.uint64(8))
    for n in (3, 4):
        gram = gram + (text[n - 1 : len(owner) + n - 1] << np.uint64(8 * (n - 1)))
        at = np.flatnonzero(room >= n)
        ids.append(_mixed(gram[at] + (np.uint64(n) << np.uint64(40))))
        whose.append(owner[at])
    ids, whose = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return keys, ids[order], np.searchsorted(whose[order], np.arange(len(words)))


def _pairs(keys: np.ndarray) -> np.ndarray:
    a, b = keys[:-1], keys[1:]
    return np.where(a == b, _REPEAT, _mixed(a * np.uint64(3) + b))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares; both empty for no words."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    index: dict[bytes, int] = {}
    at = np.array([index.setdefault(w, len(index)) for w in words])
    keys, ids, start = subwords(list(index))
    count = np.bincount(at, minlength=len(index))
    each = np.repeat(count, np.diff(np.append(start, len(ids))))
    pairs = _pairs(keys[at])
    total = np.bincount(np.concatenate([ids, pairs]), np.concatenate([each, np.ones(len(pairs))]), BUCKETS)
    used = np.flatnonzero(total)
    return used, (total[used] / total.sum()).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Number per bucket and intercept of the log odds of label 1."""
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share, label = rows[i]
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = soft @ p
            soft -= rate * np.outer(mean, p)
            bias -= rate * p
            if len(ids):
                # the average makes a bucket's step tiny, so it is taken per share of the largest
                vectors[ids] -= (rate * share / share.max())[:, None] * back[None, :]
    log_odds = soft[:, 1] - soft[:, 0]
    return (vectors @ log_odds).astype(np.float32), float(bias[1] - bias[0])


def fitted(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[np.ndarray, float]:
    """Number per bucket and intercept, from at most ``sample`` labelled documents, those of smallest id hash.

    One task trains, on rows bounded by ``sample``; the driver gets the numbers alone. Of rows with
    equal ids one teaches.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                    pa.array([g[1] for g in got], pa.list_(pa.float32())),
                ],
                ["doc_id", "label", "ids", "share"],
            )

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            order = np.argsort(t["doc_id"].to_numpy(), kind="stable").tolist()
            ids, share, label_of = t["ids"], t["share"], t["label"].to_pylist()
            weight, intercept = train([(ids[i].values.to_numpy(), share[i].values.to_numpy(), label_of[i]) for i in order])
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([intercept])], ["weight", "intercept"])

    # the sample is bounded by the parameter, so sending it to every task is too
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("s")).select("doc_id", "s.text", "s.label")
    rows = one.mapInArrow(featured, "doc_id long, label int, ids array<int>, share array<float>")
    got = rows.repartition(1).mapInArrow(trained, "weight binary, intercept double").first()
    return (np.frombuffer(got["weight"], np.float32), got["intercept"]) if got else (np.zeros(BUCKETS, np.float32), 0.0)


class _Words(dict):
    """Place of each word in the sums of its features; filled for a batch at a time."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.keys_, self.sum_, self.n_ = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        keys, ids, start = subwords(new)
        for w in new:
            self[w] = len(self)
        self.keys_ = np.concatenate([self.keys_, keys])
        self.sum_ = np.concatenate([self.sum_, np.add.reduceat(self.weight[ids].astype(np.float64), start)])
        self.n_ = np.concatenate([self.n_, np.diff(np.append(start, len(ids)))])


def score(docs: DataFrame, weight: np.ndarray, intercept: float) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; no words: what the intercept says.

    ``docs`` has the columns ``doc_id, text`` first; others pass through unchanged.
    """
    schema = docs.drop("score").schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(weight)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            column = batch.column(batch.schema.get_field_index("text"))
            for low in range(0, batch.num_rows, 256):
                texts = [(t.as_py() or "").encode("utf-8", "replace").split() for t in column[low : low + 256]]
                if len(known) > WORDS_KEPT:
                    known.forget()
                if new := set().union(*texts).difference(known):
                    known.learn(list(new))
                for i, words in enumerate(texts):
                    total, n = 0.0, 0
                    if words:
                        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                        pairs = _pairs(known.keys_[at])
                        total = known.sum_[at].sum() + float(weight[pairs].sum(dtype=np.float64))
                        n = known.n_[at].sum() + len(pairs)
                    z = intercept + (total / n if n else 0.0)
                    out[low + i] = 1 / (1 + np.exp(-min(max(z, -500), 500)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns)), pa.array(out)], [*batch.schema.names, "score"]
            )

    return docs.drop("score").mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of those names are replaced.

    Fitted on labelled rows whose id is not held out (crc32 of the id's text modulo 3 is 1).
    NULL labels or ids teach nothing, of conflicting labels the lower counts. NULL text is
    empty. With no labelled row at all every score is 0.5. Repeated rows score alike.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    weight, intercept = fitted(docs, labels.where(~held), label, sample)
    plain = docs.drop("held_out", "score", "predicted")
    return (
        score(plain, weight, intercept)
        .withColumn("held_out", held)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
