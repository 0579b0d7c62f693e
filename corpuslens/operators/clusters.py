"""Near-duplicate clustering of findings without comparing all pairs.

Findings are first collapsed to what the similarity rules look at: the word set
of the title, the file and the line. Equal word sets within reach of each other
form runs on the line axis, so a file full of copies shrinks to a few runs.
Different word sets are paired by prefix filtering (two sets above a Jaccard bar
must share one of their first few words), and for every similar pair the nearest
predecessor on the line axis is enough to keep the clusters connected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.constants import CROSS_AGENT_BAR, NEAR_LINES, SAME_AGENT_BAR
from corpuslens.functions.text import set_jaccard, word_set
from corpuslens.session import cut_lineage, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges to ``(node, component)``, component = smallest node id.

    Alternating star contraction: every round is two min-aggregations and two
    joins against unique keys, so one very connected node never lands in a
    single task. Nodes without an edge are not listed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    state = _fingerprint(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = cut_lineage(nxt)
        new = _fingerprint(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _rarest(sets: DataFrame, keys: list[str], text: str, bar: float) -> DataFrame:
    """``(keys..., t, n, w)``: of each set the words of which any set above ``bar`` must share one.

    They are the rarest under the same keys, so a word that stands in most sets is in the
    prefix only of sets that have hardly another, and forms no crowd of pairs.
    """
    words = F.split(F.col(text), " ")
    each = sets.select(*keys, F.col(text).alias("t"), F.size(words).alias("n"), F.explode(words).alias("w"))
    often = each.groupBy(*keys, "w").agg(F.count("*").alias("df"))
    ranked = each.join(often, [*keys, "w"]).groupBy(*keys, "t", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("l"))
    first = F.slice("l", F.lit(1), (F.col("n") - F.floor(F.col("n") * F.lit(bar))).cast("int"))
    return ranked.select(*keys, "t", "n", F.explode(first).alias("x")).select(*keys, "t", "n", F.col("x.w").alias("w"))


def similar_sets(sets: DataFrame, keys: list[str], text: str, bar: float) -> DataFrame:
    """Pairs ``(keys..., a, b, sim)``, a < b, of distinct word sets above ``bar`` under equal keys.

    ``sets`` holds one row per (keys, word set); the set is a space-joined string.
    A pair that meets under several keys of a wider table is the caller's to dedupe.
    """
    tagged = stored(_rarest(sets, keys, text, bar), "prefixes", joined=True)
    left = tagged.select(*keys, "w", F.col("t").alias("a"), F.col("n").alias("na"))
    right = tagged.select(*keys, "w", F.col("t").alias("b"), F.col("n").alias("nb"))
    return (
        left.join(right, [*keys, "w"])
        .where((F.col("a") < F.col("b")) & (F.col("na") > F.col("nb") * bar) & (F.col("nb") > F.col("na") * bar))
        .select(*keys, "a", "b")
        .distinct()
        .withColumn("sim", set_jaccard(F.split("a", " "), F.split("b", " ")))
        .where(F.col("sim") > bar)
    )


def _ws(c: str):
    return F.array_join(word_set(c), " ")


def _line_edges(pts: DataFrame, lines: DataFrame, same_line_rule: bool, window: int, same: float, cross: float):
    """Edges between runs of different word sets in one file."""
    place = ["project_id", "place"]
    block = F.floor(F.col("line") / (window + 1))
    blocks = lines.select(*place, "ws", block.alias("blk")).distinct()
    reach = blocks.select(*place, "ws", F.explode(F.array("blk", F.col("blk") + 1)).alias("blk")).distinct()
    pairs = similar_sets(reach, [*place, "blk"], "ws", same).select(
        *place, F.col("a"), F.col("b"), (F.col("sim") > cross).alias("strong")
    ).distinct()
    pairs = stored(pairs, "similar", joined=True)

    side = pairs.select(
        *place,
        "a",
        "b",
        "strong",
        F.explode(F.array(F.struct(F.col("a").alias("ws"), F.lit(0).alias("side")),
                          F.struct(F.col("b").alias("ws"), F.lit(1).alias("side")))).alias("s"),
    ).select(*place, "a", "b", "strong", "s.ws", "s.side")
    lanes = lines.select(*place, "ws", "line", "node", F.lit("").alias("lane")).unionByName(
        pts.select(*place, "ws", "line", "node", F.concat(F.lit("@"), "agent_name").alias("lane")).distinct()
    )
    reached = side.join(lanes, [*place, "ws"]).where(F.col("strong") == (F.col("lane") == ""))
    w = (
        Window.partitionBy(*place, "a", "b", "lane")
        .orderBy("line", "side")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.struct("line", "node")
    prev = lambda s: F.last(F.when(F.col("side") == s, seen), ignorenulls=True).over(w)
    near = (
        reached.withColumn("p", F.when(F.col("side") == 1, prev(0)).otherwise(prev(1)))
        .where(F.col("line") - F.col("p.line") <= window)
        .select(F.col("node").alias("a"), F.col("p.node").alias("b"))
    )
    if not same_line_rule:
        return near
    spots = pts.select(*place, "ws", "line", "severity", "node").distinct()
    left = pairs.where("NOT strong").join(spots.withColumnRenamed("ws", "a"), [*place, "a"])
    right = spots.select(*place, F.col("ws").alias("b"), "line", "severity", F.col("node").alias("other"))
    same_spot = left.join(right, [*place, "b", "line", "severity"]).select(
        F.col("node").alias("a"), F.col("other").alias("b")
    )
    return near.unionByName(same_spot)


def _text_edges(pts: DataFrame, text: str, node: str, same: float, cross: float) -> DataFrame:
    """Edges between file-level findings through one text column."""
    place = ["project_id", "place"]
    known = pts.where(F.col(text) != "")
    lanes = known.select(
        *place, F.col(text).alias("t"), F.col(node).alias("n"),
        F.explode(F.array(F.lit(""), F.concat(F.lit("@"), "agent_name"))).alias("lane"),
    ).distinct()
    sets = known.select(*place, text).distinct()
    pairs = similar_sets(sets, place, text, same)
    side = lambda k, n: lanes.select(*place, "lane", F.col("t").alias(k), F.col("n").alias(n))
    return (
        pairs.join(side("a", "na"), [*place, "a"])
        .where((F.col("sim") > cross) == (F.col("lane") == ""))
        .join(side("b", "nb"), [*place, "lane", "b"])
        .select(F.col("na").alias("a"), F.col("nb").alias("b"))
        .distinct()
    )


def cluster_findings(
    findings: DataFrame,
    same_line_rule: bool = True,
    window: int = NEAR_LINES,
    same: float = SAME_AGENT_BAR,
    cross: float = CROSS_AGENT_BAR,
) -> DataFrame:
    """``findings`` plus ``component``: the smallest ``seq`` of the cluster.

    Two findings of one file are linked when their lines are within ``window``
    and their titles are similar enough (``same`` for one agent, ``cross`` for
    two); two findings without a line when title or description is. With
    ``same_line_rule`` equal line and severity accept the lower bar across
    agents. Equal fingerprints are linked when the column exists. Findings
    without a path form one place per project.
    """
    base = findings.withColumn("place", F.coalesce("path", F.lit(""))).withColumn("ws", _ws("title"))
    place = ["project_id", "place"]

    lined = base.where(F.col("line_start").isNotNull() & (F.col("ws") != ""))
    pts = lined.groupBy(*place, "ws", F.col("line_start").alias("line"), "agent_name", "severity").agg(
        F.min("seq").alias("seq")
    )
    w = Window.partitionBy(*place, "ws").orderBy("line")
    runs = (
        pts.groupBy(*place, "ws", "line")
        .agg(F.min("seq").alias("seq"))
        .withColumn("cut", (F.col("line") - F.lag("line").over(w) > window).cast("int"))
        .withColumn("run", F.sum(F.coalesce("cut", F.lit(0))).over(w))
        .withColumn("node", F.min("seq").over(Window.partitionBy(*place, "ws", "run")))
        .select(*place, "ws", "line", "node")
    )
    lines = stored(runs, "runs", joined=True)
    pts = pts.drop("seq").join(lines, [*place, "ws", "line"])
    edges = [_line_edges(pts, lines, same_line_rule, window, same, cross)]

    loose = base.where(F.col("line_start").isNull()).withColumn("wd", _ws("description"))
    lp = loose.groupBy(*place, "agent_name", "ws", "wd").agg(F.min("seq").alias("seq"))
    for text, node in (("ws", "nt"), ("wd", "nd")):
        low = lp.where(F.col(text) != "").groupBy(*place, text).agg(F.min("seq").alias(node))
        lp = lp.join(low, [*place, text], "left")
    lp = stored(lp, "file-level", joined=True)
    edges.append(lp.where("nt IS NOT NULL AND nd IS NOT NULL").select(F.col("nt").alias("a"), F.col("nd").alias("b")))
    edges.append(_text_edges(lp, "ws", "nt", same, cross))
    edges.append(_text_edges(lp, "wd", "nd", same, cross))

    with_line = base.join(
        lines.withColumnRenamed("line", "line_start"), [*place, "ws", "line_start"], "left"
    ).where(F.col("line_start").isNotNull()).withColumn("node", F.coalesce("node", "seq"))
    without = (
        loose.join(
            lp.select(*place, "agent_name", "ws", "wd", F.coalesce("nt", "nd").alias("node")),
            [*place, "agent_name", "ws", "wd"],
            "left",
        )
        .drop("wd")
        .withColumn("node", F.coalesce("node", "seq"))
    )
    noded = with_line.unionByName(without)
    if "fingerprint" in findings.columns:
        hits = noded.where("fingerprint IS NOT NULL").select("project_id", "fingerprint", "node").distinct()
        low = hits.groupBy("project_id", "fingerprint").agg(F.min("node").alias("b"))
        edges.append(hits.join(low, ["project_id", "fingerprint"]).select(F.col("node").alias("a"), "b"))

    labels = connected_components(reduce(DataFrame.unionByName, edges))
    return (
        noded.join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select(*findings.columns, "component")
    )
