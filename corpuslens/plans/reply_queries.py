"""Queries on recorded replies and review packs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators import annotations, detectors, packing, packs, responses, scope
from corpuslens.plans.fixtures import Fixtures
from corpuslens.plans.registry import query
from corpuslens.plans.triage_queries import pieces


def replies(fx: Fixtures) -> DataFrame:
    return fx.responses.withColumn("model", F.lit("m"))


def parsed(fx: Fixtures) -> DataFrame:
    return responses.parse_findings(replies(fx))


@query
def extract_json_array(fx: Fixtures) -> DataFrame:
    r = responses.extract_json_array(replies(fx))
    return r.select("batch_id", "agent_name", "status", F.md5(F.coalesce("body", F.lit(""))).alias("digest"))


@query
def parse_findings(fx: Fixtures) -> DataFrame:
    return parsed(fx).select("batch_id", "agent_name", "status", F.greatest(F.size("items"), F.lit(0)).alias("n_items"))


@query
def validate_fields(fx: Fixtures) -> DataFrame:
    v = responses.validate_fields(parsed(fx))
    return v.select("batch_id", "agent_name", "pos", "title", "severity", "path", "line_start", "reject")


@query
def incomplete_rows(fx: Fixtures) -> DataFrame:
    return responses.incomplete_rows(parsed(fx)).drop("score_penalty")


@query
def choose_attempt(fx: Fixtures) -> DataFrame:
    """Every reply again as a second attempt, taken from the neighbouring batch."""
    again = replies(fx).withColumn("batch_id", F.col("batch_id") + 1).withColumn("attempt", F.lit(2))
    both = responses.parse_findings(replies(fx).unionByName(again))
    return responses.choose_attempt(both).select("batch_id", "agent_name", "attempt", "status")


@query
def attribute_findings(fx: Fixtures) -> DataFrame:
    n = F.col("seq") % 6
    name = (
        F.when(n == 0, F.upper("agent_name")).when(n == 1, "Test-Intelligence").when(n == 2, "dead code")
        .when(n == 3, "Architect").when(n == 4, "nobody").otherwise(F.col("agent_name"))
    )
    f = fx.findings.withColumn("batch_id", F.floor(F.col("seq") / 40)).withColumn("claimed_agent", name)
    return responses.attribute_findings(f)


@query
def custom_penalties(fx: Fixtures) -> DataFrame:
    f = fx.findings
    table = f.select("agent_name").distinct().where("agent_name <> 'logic'").select(
        "agent_name",
        F.create_map(F.lit("critical"), F.length("agent_name").cast("double"), F.lit("low"), F.lit(1.5)).alias("severity_penalty"),
    )
    p = detectors.apply_custom_penalty(f, table)
    return p.select("seq", F.when(F.isnan("score_penalty"), -1.0).otherwise(F.col("score_penalty")).alias("score_penalty"))


@query
def apply_verification(fx: Fixtures) -> DataFrame:
    n = F.col("seq") % 5
    reply = (
        F.when(n == 0, "YES").when(n == 1, "yes at first... NO, it is sanitized").when(n == 2, "<thinking>NO</thinking> Yes.")
        .otherwise("yesterday I could not tell")
    )
    r = fx.findings.where("seq % 3 <> 0").select("seq", reply.alias("reply"))
    known = fx.modules.where("m % 4 <> 0").select("path")
    return responses.apply_verification(fx.findings, r, known).select("seq")


@query
def salvage_ranking(fx: Fixtures) -> DataFrame:
    """Rankings written as clean, fenced, cut-off and prose replies."""
    n = F.col("file_seq") % 4
    array = F.concat(F.lit('["'), "path", F.lit('", "x/y.ts", "z'), F.col("file_seq").cast("string"), F.lit('.ts"]'))
    text = (
        F.when(n == 0, array).when(n == 1, F.concat(F.lit("Sure:\n```json\n"), array, F.lit("\n```")))
        .when(n == 2, F.substring(array, F.lit(1), F.length(array) - 4)).otherwise("no list")
    )
    return responses.salvage_ranking(fx.code_meta.select("file_seq", text.alias("content")))


@query
def parse_verdicts(fx: Fixtures) -> DataFrame:
    n = F.col("seq") % 4
    body = F.concat(
        F.lit('{"is_conflict": '), F.when(n == 3, '"maybe"').otherwise((F.col("seq") % 2 == 0).cast("string")),
        F.lit(', "decision": "'), "title", F.lit('", "tradeoff_accepted": "t", "confidence": '),
        F.when(n == 1, F.lit('"85"')).otherwise((F.col("seq") % 100).cast("string")), F.lit(', "losing_side": "N/A"}'),
    )
    text = F.when(n == 2, F.concat(F.lit("Verdict: "), body, F.lit(" Done."))).otherwise(body)
    return responses.parse_verdicts(fx.findings.select("seq", text.alias("content")))


@query
def parse_synthesis(fx: Fixtures) -> DataFrame:
    n = F.col("seq") % 3
    body = F.concat(
        F.lit('{"executiveSummary": '), F.when(n == 2, "null").otherwise(F.concat(F.lit('"S '), F.col("seq").cast("string"), F.lit('"'))),
        F.lit(', "priorityFixes": [{"rank": "2nd", "title": "'), "title",
        F.lit('", "rationale": "r", "estimatedHours": "1.5h", "affectedFiles": ["a.ts", 3]}, {"rank": 1}],'
              ' "crossCuttingObservations": ["o", 1], "debtEstimate": {"highestROIFix": "fix"}}'),
    )
    text = F.when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    s = responses.parse_synthesis(fx.findings.select("seq", text.alias("content")))
    one = F.col("fixes")[0]
    return s.select(
        "seq", "summary", F.size("fixes").alias("n_fixes"), one["rank"].alias("rank"), one["title"].alias("title"),
        one["estimated_hours"].alias("hours"), F.array_join(one["affected_files"], ",").alias("files"),
        F.array_join("observations", ",").alias("observations"), "best_fix",
    )


def batches(fx: Fixtures) -> DataFrame:
    return packing.pack_batches(pieces(fx))


@query
def render_batches(fx: Fixtures) -> DataFrame:
    r = packs.render_batches(batches(fx), 8)
    return r.select("project_id", "batch_no", "n_chunks", "max_tokens", F.md5("prompt").alias("digest"))


@query
def request_lists(fx: Fixtures) -> DataFrame:
    a = annotations.annotation_summary(annotations.parse_annotations(scope.with_language(fx.files)))
    return packs.request_lists(a)


@query
def changed_file_list(fx: Fixtures) -> DataFrame:
    return packs.changed_file_list(fx.changed_files.select("project_id", "path").distinct())


@query
def score_packs(fx: Fixtures) -> DataFrame:
    """The pluggable reviewer, here a stub that counts the lines of each pack."""

    def stub(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "batch_id": f["batch_id"], "agent_name": f["agent_name"], "attempt": 1, "provider": "stub", "model": "lines",
            "content": f["prompt"].str.count("\n").astype(str),
        })

    p = packs.render_batches(batches(fx)).select(
        (F.col("project_id") * 1000 + F.col("batch_no")).alias("batch_id"), F.lit("logic").alias("agent_name"), "prompt", "max_tokens"
    )
    return detectors.score_packs(p, stub)
