"""Ranked search, exact top-k search and hard negatives against brute force, with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import hard_negatives, integer_vectors, ranked_search, vector_approximation

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    """The score as it is stated, over every pair; of items with equal ids the least text counts."""
    counted = [(d, Counter(words(t))) for d, t in docs if d is not None and words(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    one = {}
    for i, t in items:
        if i is not None:
            one[i] = min(x for x in (t, one.get(i)) if x is not None) if t is not None or one.get(i) is not None else None
    out = []
    for item, text in one.items():
        scored = []
        for d, c in counted:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in c}
            scored.append((-sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c), d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def texts(n, rng, vocabulary=60):
    pool = [f"w{i}" for i in range(vocabulary)] + ["Ñandú", "naïve x", "日本語", "A1b2", "\U0001f600"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    return [" ".join(rng.choices(pool, weights, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("leaf, tree", [(32, 16_384), (2, 40)])
def test_ranked_search_against_every_pair(spark, monkeypatch, leaf, tree):
    monkeypatch.setattr(ranked_search, "TREE", tree)
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    rng = random.Random(leaf)
    docs = list(enumerate(texts(150, rng)))
    docs += [(1000 + i, docs[3][1]) for i in range(70)] + [(2000, None), (2001, ""), (2002, " .,;\n\t"), (None, docs[0][1]), (5, docs[7][1])]
    docs += [(3000, "w1 w2, " * 300_000 + "rare"), (3001, "W59;w59/RARE")]
    items = list(enumerate(texts(12, rng))) + [(100, None), (101, ""), (102, "unseen words"), (None, "w1"), (3, "w4 w4 w5"), (103, "rare rare w59")]
    schema = "doc_id long, text string, item_id string, score string, rank string, term string, row string, n string"
    d = spark.createDataFrame([(i, t, *"abcdef") for i, t in docs], schema)
    i = spark.createDataFrame([(i, t, *"abc") for i, t in items], "item_id long, text string, doc_id string, score string, term string")
    expected = ranked(docs, items)
    assert found(ranked_search.search(d, i)) == expected
    assert found(ranked_search.search(d, i, block_terms=20)) == expected  # several passes


def test_ranked_search_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0))):
        got = ranked_search.search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_subtree_bounds_hold():
    rng = np.random.default_rng(4)
    lists = sorted(sorted(rng.choice(30, rng.integers(1, 9), replace=False).tolist()) for _ in range(400))
    start = np.cumsum([0, *map(len, lists)])
    term, tf = np.concatenate(lists), rng.integers(1, 9, start[-1])
    norm, ids = rng.integers(25, 400, len(lists)), rng.permutation(len(lists))
    tree = ranked_search.Tree(ids, norm, start, term, tf, 3)
    weight = rng.integers(0, 9000, 30)
    gains = ranked_search.gain(tf, np.repeat(norm, np.diff(start)))
    score = np.add.reduceat(weight[term] * gains, start[:-1])
    assert {i for lo, hi in (tree.spans[n] for n in range(len(tree.spans)) if n not in tree.children) for i in range(lo, hi)} == set(range(400))
    for node, (lo, hi) in enumerate(tree.spans[1:], 1):
        a, b = tree.bound_at[node], tree.bound_at[node + 1]
        assert (weight[tree.bound_term[a:b]] * tree.bound_gain[a:b]).sum() >= score[lo:hi].max()


SCHEMA = "vec_id long, embedding array<double>, label int, x string, copy string, q string, block string, stripe string, score string, rank string"


def vectors(rng, n=260, dim=7):
    """Clustered and repeated vectors, every kind of row that takes no part, ids with a stride."""
    centres = rng.normal(0, 1, (6, dim))
    rows = [(4 * i, (centres[i % 6] + rng.normal(0, 0.3, dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    same = rows[10][1]
    rows += [(10_000 + i, same, int(i % 3)) for i in range(40)] + [(20_000, [0.0] * dim, 1), (rows[3][0], rows[3][1], rows[3][2])]
    odd = [(30_000, None, 1), (30_100, [None, *[1.0] * (dim - 1)], 1), (30_200, [float("nan")] * dim, 1), (30_300, [float("inf")] * dim, 2), (30_400, [1.0], 1)]
    odd += [(30_500, [], 1), (None, same, 1), (30_600, [1e300] * dim, 1)]
    return rows, odd


def scores(rows):
    one = {i: (v, lab) for i, v, lab in rows}
    ids = np.array(sorted(one))
    x = np.floor(256 * np.array([one[i][0] for i in ids])).astype(np.int64)
    return ids, x @ x.T, [one[i][1] for i in ids]


def order(ids, s, i):
    return [j for j in np.lexsort((ids, -s[i])) if j != i]


def whole(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA)


@pytest.mark.parametrize("cells, stripe, block", [(256, 65_536, 1024), (3, 50, 7)])
def test_top_inner_products_against_every_pair(spark, monkeypatch, cells, stripe, block):
    for name, value in (("STRIPE", stripe), ("LEAST_STRIPE", stripe), ("BLOCK", block)):
        monkeypatch.setattr(integer_vectors, name, value)
    rows, odd = vectors(np.random.default_rng(cells))
    ids, s, _ = scores(rows)
    expected = [(int(ids[i]), r, int(ids[j]), int(s[i, j])) for i in range(len(ids)) if ids[i] % 20 == 0 for r, j in enumerate(order(ids, s, i)[:5], 1)]
    got = vector_approximation.top_inner_products(whole(spark, rows + odd), F.col("vec_id") % 20 == 0, cells=cells, sample=30)
    assert found(got) == sorted(expected)


@pytest.mark.parametrize("stripe, block", [(65_536, 1024), (50, 7)])
def test_hard_negatives_against_every_pair(spark, monkeypatch, stripe, block):
    for name, value in (("STRIPE", stripe), ("LEAST_STRIPE", stripe), ("BLOCK", block)):
        monkeypatch.setattr(integer_vectors, name, value)
    rows, odd = vectors(np.random.default_rng(block))
    ids, s, label = scores(rows)
    expected = []
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            near = order(ids, s, i)
            for p in [j for j in near if label[j] == label[i]][:5]:
                wanted = [j for j in near if label[j] != label[i] and 30 * s[i, p] <= 100 * s[i, j] <= 90 * s[i, p]]
                expected += [(int(ids[i]), int(ids[p]), r, int(ids[j]), int(s[i, p]), int(s[i, j])) for r, j in enumerate(wanted[:10], 1)]
    assert len(expected) > 500
    got = hard_negatives.hard_negatives(whole(spark, [*rows, *odd, (40_000, rows[0][1], None)]), F.col("vec_id") % 20 == 0)
    assert found(got) == sorted(expected)


def test_few_or_no_vectors(spark):
    none = whole(spark, [])
    one = whole(spark, [(20, [1.0, 2.0], 1)])
    two = whole(spark, [(20, [1.0, 2.0], 1), (21, [1.0, -2.0], 1)])
    for table in (none, one):
        assert vector_approximation.top_inner_products(table, F.col("vec_id") % 20 == 0).count() == 0
        assert hard_negatives.hard_negatives(table, F.col("vec_id") % 20 == 0).count() == 0
    assert found(vector_approximation.top_inner_products(two, F.col("vec_id") % 20 == 0)) == [(20, 1, 21, 256 * 256 * (1 - 4))]
    assert hard_negatives.hard_negatives(two, F.col("vec_id") % 20 == 0).count() == 0  # the only positive is below 0


def test_large_numbers_stay_exact(spark):
    big = 2.0**21
    rows = [(20, [big, 1 / 256, 1.0], 1), (21, [big, 3 / 256, 1.0], 1), (22, [big, 2 / 256, 1.0], 2), (23, [big, 2 / 256, 1.0], 2), (24, [big / 2, 0.0, 0.0], 2)]
    ids, s, _ = scores(rows)
    expected = [(20, r, int(ids[j]), int(s[0, j])) for r, j in enumerate(order(ids, s, 0)[:3], 1)]
    assert found(vector_approximation.top_inner_products(whole(spark, rows), F.col("vec_id") == 20, k=3, cells=2)) == expected
    assert [r[3] for r in found(hard_negatives.hard_negatives(whole(spark, rows), F.col("vec_id") == 20))] == [24]


def test_bounds_enclose_the_products():
    rng = np.random.default_rng(2)
    x = rng.integers(-400, 400, (300, 9))
    marks = vector_approximation.borders(x[:20], x.min(0), x.max(0), 5)
    code = vector_approximation.coded(x, marks)
    for d, mark in enumerate(marks):
        assert (mark[:-1][code[:, d]] <= x[:, d]).all() and (x[:, d] < mark[1:][code[:, d]]).all()
    low, high = vector_approximation.bounds(code, x[:40], marks)
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
