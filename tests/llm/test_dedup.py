"""Near-duplicates, repeated windows and line chunks against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import line_dedup, minhash_near_dedup, suffix_array_dedup
from corpuslens.llm.components import components as contracted

SCHEMA = "doc_id long, text string, row_key string, digest int, _line_dedup int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA)


def prose(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(5000)}" for _ in range(n)]


def edited(words, k, seed):
    r = random.Random(seed)
    out = list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return out


def components(rows, width, need):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i], parent[i] = s, i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= need * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.fixture(scope="module")
def copies():
    base, other = prose(300, 1), prose(120, 2)
    rows = [(1000 + k, " ".join(edited(base, k % 12, k))) for k in range(60)]
    rows += [(2000 + k, " ".join(edited(other, k % 9, 99 + k))) for k in range(40)]
    rows += [(3000 + k, " ".join(prose(80, 500 + k) + base[:40])) for k in range(30)]
    rows += [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "two one")]
    rows += [(9, "same " * 3000), (10, "same " * 2000), (11, " ".join(base).upper()), (12, "é É")]
    return rows


def test_components_as_by_all_pairs(spark, copies):
    got = minhash_near_dedup.near_duplicates(make(spark, copies), 3, 85).collect()
    want = components(copies, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({r.component_id for r in got}) < len(got) - 50


def test_crowded_regions_lose_no_link(spark, copies, monkeypatch):
    for name, value in (("CROWD", (4, 8)), ("BLOCK", 5), ("LOAD", 2000), ("FAN", 3)):
        monkeypatch.setattr(minhash_near_dedup, name, value)
    got = minhash_near_dedup.near_duplicates(make(spark, copies), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(copies, 3, 85)


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(prose(50, 3))
    got = minhash_near_dedup.near_duplicates(make(spark, [(None, text), (7, text), (7, text), (None, "x y z q"), (None, None)])).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (None, 46, 7, False), (7, 46, 7, True), (None, 1, None, True), (None, 0, None, True)
    }
    assert minhash_near_dedup.near_duplicates(make(spark, [])).count() == 0


def windows_by_brute_force(rows, width=200):
    seen = collections.Counter(t[i : i + width] for _, t in rows for i in range(len(t) - width + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeated(spark, rows):
    got = suffix_array_dedup.deduplicated(make(spark, rows)).select("doc_id", "n_bytes", "spans", F.sha2("kept", 256).alias("h")).collect()
    return sorted(((r.doc_id, r.n_bytes, [(x.s, x.e) for x in r.spans], r.h) for r in got), key=str)


def test_windows_as_by_brute_force(spark):
    r = random.Random(5)
    shared = ["".join(r.choice("abc é\n") for _ in range(n)) for n in (150, 199, 200, 201, 350, 1000)]
    rows = []
    for i in range(60):
        own = "".join(chr(97 + r.randrange(26)) for _ in range(r.randrange(600)))
        cut = r.choice(shared)
        rows.append((i, own + cut[r.randrange(30) :] + own[::-1] + r.choice(shared)))
    rows += [(100, "x" * 1500), (101, "ab" * 400), (102, None), (103, ""), (104, "x" * 199), (None, shared[5]), (105, shared[5]), (105, shared[5])]
    rows += [(106, shared[2]), (107, "q" + shared[2]), (108, shared[4] + shared[4])]
    assert repeated(spark, rows) == windows_by_brute_force([(i, (t or "").encode()) for i, t in rows])


def test_windows_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(suffix_array_dedup, "STRETCH", 700)
    r = random.Random(6)
    body = "".join(chr(97 + r.randrange(26)) for _ in range(2500))
    rows = [(1, body), (2, "zz" + body[300:2300]), (3, body[:1200] + "!" + body[1200:])]
    assert repeated(spark, rows) == windows_by_brute_force([(i, t.encode()) for i, t in rows])
    assert repeated(spark, []) == []


def chunks_by_brute_force(rows):
    """Chunks cut by the sum of neighbouring line hashes; the first of equal ones stays."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = t.split("\n") if t else []
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        kept, chunk, gone, n, gone_lines = [], [], 0, 0, 0
        for k, line in enumerate(lines):
            chunk.append(line)
            marked = [(h[m] + 31 * (h[m - 1] if m else 0)) % 3 == 0 for m in range(max(0, k - 1), k + 1)]
            if k == len(lines) - 1 or (0 < k < len(lines) - 2 and marked[1] and not marked[0]):
                n += 1
                if sum(bool(x.strip(" ")) for x in chunk) >= 2 and tuple(chunk) in seen:
                    gone, gone_lines = gone + 1, gone_lines + len(chunk)
                else:
                    kept += chunk
                seen.add(tuple(chunk))
                chunk = []
        out[i] = ("\n".join(kept) if gone else t, len(lines), n, gone, gone_lines)
    return out


def test_line_chunks_as_by_brute_force(spark):
    r = random.Random(8)
    passages = [[f"line {r.randrange(10**6)}" for _ in range(n)] for n in (3, 6, 12, 40)]
    rows = []
    for i in range(80):
        own = [f"own {i} {k}" for k in range(r.randrange(8))]
        rows.append((i, "\n".join(own + r.choice(passages) + own[:2] + r.choice(passages))))
    rows += [(200, None), (201, ""), (202, "\n\n\n\n\n"), (203, "\n\n\n\n\n"), (204, "a"), (205, "a"), (None, "\n".join(passages[3]))]
    rows += [(206, "\n".join(f"tail {k % 7}" for k in range(3000)))]
    got = line_dedup.deduplicated(make(spark, rows))
    assert got.columns == ["doc_id", "text", "row_key", "digest", "_line_dedup", "n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    have = {r.doc_id: (r.text, r.n_lines, r.n_chunks, r.removed_chunks, r.removed_lines) for r in got.collect()}
    assert have == chunks_by_brute_force(rows)
    assert sum(v[3] for v in have.values()) > 50
    assert line_dedup.deduplicated(make(spark, [])).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = "\n".join(f"row {k}" for k in range(30))
    got = line_dedup.deduplicated(make(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (1, text), (2, "")]


def test_chance_of_missing_a_link():
    for bar, chances in ((0.8, (2e-9, 6e-7, 3e-5)), (0.85, (8e-12, 6e-9, 4e-7))):
        for depth, chance in zip((2, 3, 4), chances, strict=True):
            assert (1 - bar**depth) ** minhash_near_dedup.TREES < chance
        deviation = (bar * (1 - bar) / (minhash_near_dedup.TREES * minhash_near_dedup.VALUES)) ** 0.5
        assert minhash_near_dedup.SLACK > 4 * deviation
    assert minhash_near_dedup.SLACK > 4 * math.sqrt(0.85 * 0.15 / 96)


def test_components_of_odd_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)]  # a chain
    edges += [(1000, 1001 + i) for i in range(200)]  # a star
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(220)] + [(5000, 5000), (None, 3), (3, None), (7, 6), (6, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(x)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {}
    rows = contracted(frame).collect()
    for r in rows:
        got.setdefault(r.component, set()).add(r.node)
    assert len(rows) == len(root) and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c in nodes for c, nodes in got.items())
    assert contracted(frame.limit(0)).collect() == []
