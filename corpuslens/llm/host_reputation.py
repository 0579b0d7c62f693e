"""URL filter: explicit rules first, else the reputation of the host.

Reputation is a share of bad pages, shrunk level by level: a suffix towards all pages, a
registered domain towards its suffix, a host towards its domain. Every level's prior is a beta
distribution whose weight is fitted to that level's own spread (moments of the beta-binomial).
A host is blocked where even the lower bound of its posterior exceeds the limit.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.session import stored

#: A page is bad this often, with this certainty, before its host is blocked.
LIMIT = 0.4
Z = 1.645
#: Range of a prior's weight in pages; the upper end stands for levels without spread of their own.
WEIGHT = (1.0, 10_000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names under which country suffixes register domains (fixed values).
_SECOND = "ac|co|com|edu|gov|ne|net|or|org"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    plain = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    return F.when(plain.rlike(r"^[0-9.]*$"), plain).otherwise(
        F.regexp_extract(plain, rf"(?:^|\.)((?:(?:{_SECOND})\.[a-z]{{2}})|[^.]*)$", 1)
    )


def domain_of(host: Column) -> Column:
    plain = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    return F.when(plain.rlike(r"^[0-9.]*$"), plain).otherwise(
        F.regexp_extract(plain, rf"((?:[^.]*\.)?(?:(?:(?:{_SECOND})\.[a-z]{{2}})|[^.]*))$", 1)
    )


def ruling(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule ``(verdict, host, path)`` that fits; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _weight(level: DataFrame) -> float:
    """Weight of the beta prior that fits the spread of ``bad`` of ``n`` over the level's groups."""
    r = level.where("n > 0").agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2"),
    ).first()
    if not r["n"] or r["k"] < 2 or not 0 < r["bad"] < r["n"]:
        return WEIGHT[1]
    p = r["bad"] / r["n"]
    spread = r["b2"] - r["bad"] * p
    room = (r["n"] - r["n2"] / r["n"] - (r["k"] - 1)) * p * (1 - p)
    rho = (spread - (r["k"] - 1) * p * (1 - p)) / room if room > 0 else 0
    return min(max(1 / rho - 1, WEIGHT[0]), WEIGHT[1]) if rho > 0 else WEIGHT[1]


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, share, bound`` per host of ``outcomes (host, n, bad)``, already summed per host.

    ``share`` is the posterior mean, ``bound`` its lower bound. Hosts with n = 0 get what their
    domain or suffix says.
    """
    hosts = outcomes.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    all_ = suffixes.agg(*sums).first()
    mean = (all_["bad"] + 1) / (all_["n"] + 2) if all_["n"] is not None else 0.5
    weights = [_weight(x) for x in (suffixes, domains, hosts)]

    def shrunk(prior: Column, w: float) -> Column:
        return (F.col("bad") + F.lit(w) * prior) / (F.col("n") + F.lit(w))

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), weights[0]).alias("above"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(F.col("above"), weights[1]).alias("above"))
    share = F.col("share")
    return (
        hosts.join(domains, ["suffix", "domain"])
        .withColumn("share", shrunk(F.col("above"), weights[2]))
        .select("host", "n", "bad", "share", (share - Z * F.sqrt(share * (1 - share) / (F.col("n") + weights[2] + 1))).alias("bound"))
    )


def judged(pages: DataFrame, outcomes: DataFrame, rules: Iterable[tuple[str, str, str]], limit: float = LIMIT) -> DataFrame:
    """``pages`` (``page_id, url``) with ``host, path, rule, verdict, labelled, bound``.

    ``outcomes (page_id, bad)``: at most one row counts per page, the worse one; NULL ids and
    outcomes count for nothing. NULL urls and urls without ``://`` have an empty host, which is
    judged like any other. Repeated pages are judged each, and each is an outcome of its host.
    """
    url = F.col("url").cast("string")
    at = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    per_host = at.join(known, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    per_host = stored(per_host, "hosts")
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return (
        at.join(reputation(per_host).select("host", F.col("n").alias("labelled"), "bound"), "host")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "labelled", "bound")
    )
