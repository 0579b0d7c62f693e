"""Connected components by contraction of hashed minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to a stored table ``(node, component)``; ``component`` is one of the component's nodes.

    Every round sends each node to the least of its neighbours and itself, in an order that is hashed
    anew, and there once more; edges between what is left are the next round's. In a random order
    neither chains nor stars keep more than a fraction of their nodes, so tables shrink fast and rounds are
    few. A round reads its edges from a table of its own, so no plan spans two rounds. Nodes
    without an edge to another node are not listed; NULL ends and an empty table give no rows.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    rounds: list[DataFrame] = []
    kind = edges.schema["a"].dataType
    while not left.isEmpty():

        def place(x: str | Column, seed: int = len(rounds)) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), x).alias("h"), F.col(x).alias("x"))

        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min(place("v")).alias("least")).select("u", F.least("least", place("u"))["x"].alias("m"))
        low = stored(low, "contraction")
        twice = low.select("u", "m").join(low.select(F.col("u").alias("m"), F.col("m").alias("far")), "m").select("u", F.col("far").alias("m"))
        to = stored(twice, "contraction")
        ends = left.join(to.select(F.col("u").alias("a"), F.col("m").alias("x")), "a").join(to.select(F.col("u").alias("b"), F.col("m").alias("y")), "b")
        smaller = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left, low)
        rounds.append(to)
        left = smaller
    discard(left)
    if not rounds:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    out = rounds.pop()
    for before in reversed(rounds):
        after = out.select(F.col("u").alias("m"), F.col("m").alias("last"))
        joined = stored(before.join(after, "m", "left").select("u", F.coalesce("last", "m").alias("m")), "contraction")
        discard(before, out)
        out = joined
    table = out.select(F.col("u").alias("node"), F.col("m").alias("component"))
    table.stored_path = out.stored_path
    return table
