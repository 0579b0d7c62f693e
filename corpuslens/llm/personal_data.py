"""Personal data in whole texts: exact formats, and a boosted model for what they miss.

Format rules find e-mail addresses, network addresses, payment cards and telephone numbers.
Looser generators propose further spans, which overlap freely; boosted trees look at format and
context of each, never at the rules' verdicts. The rules' findings are the positive examples,
so the trees learn how such data looks and where it stands. On examples kept apart, each kind
gets the lowest score at which the chosen precision still holds; spans above it that no rule
has found are added, the best one where they overlap. Everything runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stored

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES = 12
DEPTH = 3
CONTEXT = 40

#: Exact formats. Possessive runs that start where a run starts: no text costs more than linear time.
_RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators with high recall: other separators, spelled out signs, missing prefixes.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,3}(?:[.,][0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00|\()?[0-9](?:[ ().-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z])",
}
#: What a text must hold for a kind to be looked for at all.
_HINT = {"email": r"@|[\[( ]at[\]) ]", "ip": r"[0-9][.,:]|[A-Fa-f]:", "card": r"[0-9]", "phone": r"[0-9]"}
_CUE = {
    "cue_mail": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "cue_phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax)\b",
    "cue_card": r"(?i)\b(card|visa|credit|payment|account)\b",
    "cue_net": r"(?i)\b(ip|host|server|address|from)\b",
    "cue_other": r"(?i)\b(order|invoice|total|page|version|isbn|date|token|key|id)\b|=",
}


def _places(text: Column, pattern: str, hint: str) -> Column:
    """Array of ``(s, e, t)`` of the leftmost non-overlapping matches, in code points."""
    whole = rf"\G((?s:.*?))({pattern})"
    has = text.rlike(hint) & text.rlike(pattern)
    none = F.array().cast("array<string>")
    gaps = F.when(has, F.regexp_extract_all(text, F.lit(whole), 1)).otherwise(none)
    hits = F.when(has, F.regexp_extract_all(text, F.lit(whole), 2)).otherwise(none)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("t")))).alias("out"))

    both = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(total: Column, i: Column) -> Column:
        x = d.substr(F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return t.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(t))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["t"])


def _with(f: Callable[[Column, Column], Column], y: Column) -> Callable[[Column], Column]:
    return lambda x: f(x, y)


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, base, loose``: spans of the rules and of the generators; one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    base, loose = [], []
    for k, kind in enumerate(KINDS):
        place = F.lit(k).alias("k")

        def of_rule(x: Column, place: Column) -> Column:
            return F.struct(x["s"].alias("s"), place, x["e"].alias("e"))

        def in_context(x: Column, place: Column) -> Column:
            before = text.substr(F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
            after = text.substr(x["e"] + 1, F.lit(CONTEXT))
            return F.struct(x["s"].alias("s"), place, x["e"].alias("e"), x["t"].alias("t"), before.alias("before"), after.alias("after"))

        found = F.filter(_places(text, _RULES[kind], _HINT[kind]), _test(kind))
        base.append(F.transform(found, _with(of_rule, place)))
        loose.append(F.transform(_places(text, _LOOSE[kind], _HINT[kind]), _with(in_context, place)))
    return out.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.array_sort(F.concat(*base)).alias("base"),
        F.concat(*loose).alias("loose"),
    )


def proposed(scan: DataFrame) -> DataFrame:
    """One row per span that a generator proposes, with its features; ``label``: a rule has found it."""
    x = F.col("x")
    rows = (
        scan.where(F.size("loose") > 0)
        .select("doc_id", "row_key", "base", F.explode("loose").alias("x"))
        .select("doc_id", "row_key", "x.*", F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])).alias("known"))
        .distinct()
    )
    t = F.col("t")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{pattern}]", ""))

    last, first = F.substring("before", -1, 1), F.substring("after", 1, 1)
    named = {
        "chars": F.length(t),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "spaces": count(" "),
        "dots": count("."),
        "dashes": count("-"),
        "slashes": count("/_"),
        "colons": count(":"),
        "commas": count(","),
        "brackets": count(r"\[\]()"),
        "at_signs": count("@"),
        "spelled": t.rlike("at[\\]) ]|dot[\\]) ]").cast("int"),
        "plus": t.startswith("+").cast("int"),
        "zero": t.startswith("0").cast("int"),
        "longest_run": F.array_max(F.transform(F.split(t, "[^0-9]+"), lambda p: F.length(p))),
        "lead": F.length(F.regexp_extract(t, "^[0-9]*", 0)),
        "tail": F.length(F.regexp_extract(t, "[A-Za-z0-9]*$", 0)),
        "check_digit": F.when(count("0-9").between(2, 19), luhn(_digits(t))).otherwise(F.lit(False)).cast("int"),
        "high_part": t.rlike("(?:^|[.,])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})(?:[.,]|$)").cast("int"),
        "left_space": last.rlike(r"^\s?$").cast("int"),
        "left_word": last.rlike(r"^\w$").cast("int"),
        "right_space": first.rlike(r"^\s?$").cast("int"),
        "right_word": first.rlike(r"^\w$").cast("int"),
        "digits_near": F.length(F.regexp_replace(F.concat("before", "after"), "[^0-9]", "")),
        **{name: F.col("before").rlike(pattern).cast("int") for name, pattern in _CUE.items()},
        **{f"is_{kind}": (F.col("k") == k).cast("int") for k, kind in enumerate(KINDS)},
    }
    return rows.select(
        "doc_id", "row_key", "s", "k", "e", F.col("known").cast("double").alias("label"),
        F.array(*(v.cast("double") for v in named.values())).alias("features_of"),
    )


def _assembled(rows: DataFrame, width: int) -> DataFrame:
    wide = rows.select("*", *(F.col("features_of")[i].alias(f"_f{i}") for i in range(width)))
    names = [f"_f{i}" for i in range(width)]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def _chosen(spans: DataFrame, precision: float) -> DataFrame | None:
    """``row_key, s, k, e, score`` of the spans to add, before overlaps are settled; None without examples of both labels.

    Every proposed span is an example, a quarter of them kept apart; equal ones travel as one weighted row.
    """
    apart = (F.pmod(F.xxhash64("row_key", "s", "k", "e"), F.lit(4)) == 0).alias("apart")
    rows = stored(
        spans.groupBy(apart, "k", "features_of", "label").agg(F.count("*").cast("double").alias("weight")), "examples"
    )
    fit = rows.where("NOT apart")
    n = fit.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("yes")).first()
    if not 0 < n["yes"] < n["n"]:
        return None
    width = len(rows.select("features_of").first()[0])
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, weightCol="weight").fit(_assembled(fit, width))

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(_assembled(df, width)).withColumn("score", vector_to_array("probability")[1])

    bins = (
        scored(rows.where("apart"))
        .groupBy("k", F.floor(F.col("score") * 50).alias("bin"))
        .agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("yes"))
        .collect()
    )  # 50 bins for each of the kinds at most
    bar = F.lit(2.0)
    for k in range(len(KINDS)):
        n = yes = 0
        lowest = None
        for row in sorted((r for r in bins if r["k"] == k), key=lambda r: -r["bin"]):
            n, yes = n + row["n"], yes + row["yes"]
            if yes >= precision * n:
                lowest = row["bin"] / 50
        if lowest is not None:
            bar = F.when(F.col("k") == k, F.lit(lowest)).otherwise(bar)
    return scored(spans.where("label = 0")).where(F.col("score") >= bar).select("row_key", "s", "k", "e", "score")


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``doc_id, base, spans`` per document row: arrays of ``(s, k, e)``, sorted, ``k`` being the place in ``KINDS``.

    ``base`` are the rules' findings, ``spans`` these and the added ones, which overlap neither
    them nor each other. NULL and empty texts have none. Repeated rows get equal results; a NULL
    id is kept. Other columns are ignored. Without examples of both labels nothing is added.
    """
    scan = stored(scanned(docs), "scan")
    added = _chosen(stored(proposed(scan), "proposed"), precision)
    if added is None:
        return scan.select("doc_id", "base", F.col("base").alias("spans"))
    by_start = Window.partitionBy("row_key").orderBy("s", "e", "k")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = added.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("s")).cast("int")).withColumn(
        "island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    )
    best = islands.groupBy("row_key", "island").agg(
        F.max_by(F.struct("s", "k", "e"), F.struct("score", -F.col("s"), "e", -F.col("k"))).alias("span")
    )
    extra = best.groupBy("row_key").agg(F.collect_list("span").alias("extra"))
    return scan.join(extra, "row_key", "left").select(
        "doc_id",
        "base",
        F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"]))
    return F.array_join(one, ",")
