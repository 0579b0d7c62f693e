"""Dependency cycles against a walk over every simple cycle, on graphs that have very many of them."""

import random

from corpuslens.operators import graph

SCHEMA = "project_id string, importer string, importee string"


def simple_cycles(edges, longest=99):
    out, to = set(), {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def walk(path):
        for nxt in to.get(path[-1], ()):
            if nxt == path[0]:
                out.add((len(path), ">".join(path)))
            elif nxt > path[0] and nxt not in path and len(path) < longest:
                walk([*path, nxt])

    for start in to:
        walk([start])
    return sorted(out)


def found(spark, projects, **options):
    rows = [(p, a, b) for p, edges in projects.items() for a, b in edges]
    got = {p: [] for p in projects}
    for r in graph.dependency_cycles(spark.createDataFrame(rows, SCHEMA), **options).collect():
        got[r.project_id].append((r.n, r.length, r.cycle))
    return {p: [x[1:] for x in sorted(v)] for p, v in got.items()}


def layers(n, width, tail="x"):
    return [(f"{tail}{i}_{a}", f"{tail}{(i + 1) % n}_{b}") for i in range(n) for a in range(width) for b in range(width)]


def test_cycles_of_random_graphs(spark):
    r = random.Random(2)
    projects = {}
    for k in range(14):
        names = [f"f{i}.ts" if i % 3 else f"f{i}" for i in range(r.randrange(3, 9))]
        projects[f"p{k}"] = {(r.choice(names), r.choice(names)) for _ in range(r.choice([4, 12, 20, 30]))}
    every = {p: simple_cycles(e) for p, e in projects.items()}
    assert sum(len(c) > 5 for c in every.values()) > 3 and sum(len(c) < 2 for c in every.values()) > 1
    for cap in (2, 5, 1000):
        assert found(spark, projects, cap=cap) == {p: c[:cap] for p, c in every.items()}
    assert found(spark, projects, cap=5, max_len=3) == {p: [x for x in c if x[0] <= 3][:5] for p, c in every.items()}


def test_cycles_of_rings_and_layers(spark):
    ring = [(f"r{i:03}", f"r{(i + 1) % 16:03}") for i in range(16)]
    short = [("a0", "a1"), ("a1", "a0"), ("a1", "x0_0"), ("x3_1", "a1")]
    projects = {
        "ring": ring,
        "nine": [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("in", "r3"), ("r4", "out"), ("out", "far")],
        "layers": layers(9, 4),  # 262144 cycles of length 9
        "mixed": layers(4, 3) + short,
        "none": [("a", "b"), ("b", "c"), ("a", "c")],
    }
    got = found(spark, projects, cap=10)
    assert got["ring"] == [(16, ">".join(f"r{i:03}" for i in range(16)))]
    assert got["nine"] == [(9, ">".join(f"r{i}" for i in range(9)))] and got["none"] == []
    by_hand = [">".join([*(f"x{i}_0" for i in range(7)), f"x7_{a}", f"x8_{b}"]) for a in range(4) for b in range(4)][:10]
    assert got["layers"] == [(9, c) for c in by_hand]
    assert got["mixed"] == simple_cycles(projects["mixed"], 8)[:10]


def test_layers_write_few_paths(spark, monkeypatch):
    """Paths per round are bounded by starts x files x cap, where there are hundreds of thousands."""
    most, cut = [0], graph.cut_lineage

    def counted(df):
        out = cut(df)
        if "path" in out.columns:
            most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(graph, "cut_lineage", counted)
    assert len(found(spark, {"p": layers(9, 4)}, cap=10)["p"]) == 10
    assert most[0] <= 4 * 4 * 4 * 10


def test_no_edges(spark):
    assert graph.dependency_cycles(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(spark, {"p": [("a", "a"), ("a", "a")]}) == {"p": [(1, "a")]}
