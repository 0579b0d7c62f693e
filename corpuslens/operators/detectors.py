"""User-defined detectors: line rules applied to a whole corpus in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.constants import DOMAINS, RESERVED_DETECTOR_NAMES, SEVERITIES


@dataclass
class Detector:
    """``pattern`` is a line regex, or ``predicate`` a SQL condition on ``line``, ``path``, ``language``."""

    name: str
    domain: str
    severity: str
    title: str
    pattern: str | None = None
    predicate: str | None = None
    penalties: dict[str, float] = field(default_factory=dict)

    def check(self) -> None:
        taken = {d.lower() for d in DOMAINS} | set(RESERVED_DETECTOR_NAMES)
        if not self.name or self.name.lower() in taken:
            raise ValueError(f"detector name is empty or reserved: {self.name!r}")
        if not self.domain or not (self.pattern or self.predicate):
            raise ValueError(f"detector {self.name} needs a domain and a rule")
        if self.severity not in SEVERITIES or any(v < 0 for v in self.penalties.values()):
            raise ValueError(f"detector {self.name} has a bad severity or penalty")


def run_detectors(files: DataFrame, detectors: list[Detector]) -> DataFrame:
    """Findings of every rule on every line.

    Rules that are plain patterns share one projection, over the lines in which any of them
    occurs; only rules with a predicate see every line. Penalties come from the rule's table.
    """
    for d in detectors:
        d.check()
    plain, other = [d for d in detectors if d.pattern], [d for d in detectors if not d.pattern]
    split = F.split("content", "\n")
    found = []
    if plain:
        anywhere = "|".join(f"(?:{d.pattern})" for d in plain)
        some = F.filter(
            F.transform(split, lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"].rlike(anywhere)
        )
        lines = files.where(F.col("content").rlike("(?m)" + anywhere)).select("project_id", "path", "language", F.inline(some))
        found.append(_hits(lines, plain))
    if other:
        lines = files.select("project_id", "path", "language", F.posexplode(split).alias("pos", "line"))
        found.append(_hits(lines, other))
    return reduce(DataFrame.unionByName, found)


def _hits(lines: DataFrame, detectors: list[Detector]) -> DataFrame:

    def hit(d: Detector):
        test = F.col("line").rlike(d.pattern) if d.pattern else F.expr(d.predicate)
        penalty = d.penalties.get(d.severity)
        row = F.struct(
            F.lit(d.name).alias("agent_name"),
            F.lit(d.domain).alias("domain"),
            F.lit(d.severity).alias("severity"),
            F.lit(d.title).alias("title"),
            F.lit(penalty).cast("double").alias("score_penalty"),
        )
        return F.when(test, row)

    hits = F.filter(F.array(*[hit(d) for d in detectors]), lambda h: h.isNotNull())
    return (
        lines.withColumn("h", F.explode(hits))
        .select("project_id", "path", (F.col("pos") + 1).cast("int").alias("line_start"), F.col("line").alias("text"), "h.*")
    )


def apply_custom_penalty(findings: DataFrame, detectors: DataFrame) -> DataFrame:
    """Explicit penalty from ``detectors(agent_name, severity_penalty map)`` where one is configured."""
    d = detectors.select("agent_name", "severity_penalty")
    override = F.try_element_at("severity_penalty", F.col("severity"))
    return (
        findings.join(d, "agent_name", "left")
        .withColumn("score_penalty", F.coalesce(override, F.col("score_penalty")))
        .drop("severity_penalty")
    )


def score_packs(
    packs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: list[str] | None = None
) -> DataFrame:
    """Hand review packs to a caller's function, Arrow batch by Arrow batch.

    ``fn`` gets rows of ``(batch_id, agent_name, prompt, max_tokens)`` and returns
    ``(batch_id, agent_name, attempt, provider, model, content)``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield fn(f)

    return packs.select(*(columns or packs.columns)).mapInPandas(
        run, "batch_id long, agent_name string, attempt int, provider string, model string, content string"
    )
