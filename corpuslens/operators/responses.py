"""Recorded model replies to findings, rankings, verdicts and summaries."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.constants import DOMAIN_ALIASES, DOMAINS, SEVERITIES
from corpuslens.functions.text import let

# A flat JSON object or array; braces inside strings do not count.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
FLAT_OBJECT = r"\{(?:[^{}\"]++|" + _STRING + r")*+\}"
FLAT_ARRAY = r"\[(?:[^\[\]\"]++|" + _STRING + r")*+\]"
FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"

# Fixed: why a reply gave no findings, as told to the reader.
REASONS = {
    "empty": "was empty",
    "no_array": "contained no JSON findings array",
    "unparsable": "could not be parsed as JSON",
    "not_array": "was not a JSON array",
}


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_reasoning(text: Column) -> Column:
    return _trim(F.regexp_replace(text, r"(?i)<(thinking|reasoning)>[\s\S]*?</\1>", ""))


def _fenced(text: Column, opener: str) -> Column:
    """The fenced block that starts with ``opener``, else the last one, else the text."""

    def pick(t: Column) -> Column:
        blocks = F.transform(F.regexp_extract_all(t, F.lit(FENCE), F.lit(1)), _trim)
        fits = lambda b: F.get(F.filter(b, lambda x: F.startswith(x, F.lit(opener))), F.lit(0))
        return let(blocks, lambda b: F.coalesce(fits(b), F.try_element_at(b, F.lit(-1)), t))

    return let(text, pick)


def _outer(text: Column, opener: str, closer: str) -> Column:
    """From the first ``opener`` to the last ``closer``; the text itself when they do not enclose anything."""

    def cut(t: Column) -> Column:
        start, end = F.instr(t, opener), F.length(t) - F.instr(F.reverse(t), closer) + 1
        found = (start > 0) & F.contains(t, F.lit(closer)) & (end > start)
        return F.when(found, F.substring(t, start, end - start + 1)).otherwise(t)

    return let(text, cut)


def _body(raw: Column) -> Column:
    """Struct(body, status) of a raw reply."""
    body = _outer(_fenced(without_reasoning(raw), "["), "[", "]")
    state = lambda b: F.when(F.contains(b, F.lit("[")), "text").otherwise("no_array")
    full = let(body, lambda b: F.struct(b.alias("body"), state(b).alias("status")))
    none = F.struct(F.lit(None).cast("string").alias("body"), F.lit("empty").alias("status"))
    return F.when(raw.rlike(r"\S"), full).otherwise(none)


def extract_json_array(responses: DataFrame) -> DataFrame:
    """``body`` to parse and ``status``: text, empty or no_array."""
    rest = responses.columns
    return responses.withColumn("b", _body(F.coalesce("content", F.lit("")))).select(*rest, "b.*")


def _items(b: Column) -> Column:
    """Struct(items, status) of a body: as it is, repaired, or salvaged."""
    json = F.coalesce(
        F.try_parse_json(b["body"]), F.try_parse_json(F.regexp_replace(b["body"], r",\s*([\]}])", "$1"))
    )
    empty = F.array().cast("array<variant>")

    def salvage(text: Column) -> Column:
        tail = F.substring(text, F.instr(text, "["), F.length(text))
        objects = F.transform(F.regexp_extract_all(tail, F.lit(FLAT_OBJECT), F.lit(0)), F.try_parse_json)
        return let(
            F.filter(objects, lambda o: o.isNotNull()),
            lambda o: F.struct(o.alias("items"), F.when(F.size(o) > 0, "ok").otherwise("unparsable").alias("status")),
        )

    listed = lambda v: F.struct(v.cast("array<variant>").alias("items"), F.lit("ok").alias("status"))
    nothing = lambda status: F.struct(empty.alias("items"), status.alias("status"))
    read = let(
        json,
        lambda v: F.when(v.isNull(), salvage(b["body"]))
        .when(F.schema_of_variant(v).startswith("ARRAY"), listed(v))
        .otherwise(nothing(F.lit("not_array"))),
    )
    return F.when(b["status"] == "text", read).otherwise(nothing(b["status"]))


def parse_findings(responses: DataFrame) -> DataFrame:
    """One array of JSON objects per reply in ``items`` and the final ``status``.

    The body as it is, else without trailing commas, else every complete object
    of a cut-off array.
    """
    rest = responses.columns
    parsed = let(_body(F.coalesce("content", F.lit(""))), _items)
    return responses.withColumn("p", parsed).select(*rest, "p.*")


def _as(x: Column, kind: str) -> Column:
    """A JSON value when it has the wanted type: string, boolean, number or strings."""
    if kind == "strings":
        texts = F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda i: F.schema_of_variant(i) == "STRING")
        return F.coalesce(F.transform(texts, lambda i: F.try_variant_get(i, "$", "string")), F.array().cast("array<string>"))
    shape = F.schema_of_variant(x)
    if kind == "number":
        return F.when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(x, "$", "double"))
    return F.when(shape == kind.upper(), F.try_variant_get(x, "$", kind))


def _typed(v: Column, path: str, kind: str) -> Column:
    """Field of a JSON object when it has the wanted type; the object is searched once."""
    return let(F.try_variant_get(v, f"$.{path}", "variant"), lambda x: _as(x, kind))


def validate_fields(parsed: DataFrame) -> DataFrame:
    """One row per reported object; ``reject`` names what is wrong with it, NULL when usable."""
    rows = parsed.where("status = 'ok'").select(
        "batch_id", "agent_name", "provider", "model", F.posexplode("items").alias("pos", "o")
    )
    o = F.col("o")
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"\S")
    title, severity, text = _typed(o, "title", "string"), _typed(o, "severity", "string"), _typed(o, "description", "string")
    path = _typed(o, "filePath", "string")
    d = rows.select(
        "batch_id", "pos", "provider", "model", "agent_name",
        _typed(o, "agentName", "string").alias("claimed_agent"),
        title.alias("title"), F.lower(_trim(severity)).alias("severity"), text.alias("description"),
        F.when(~blank(path), path).alias("path"),
        _typed(o, "lineStart", "number").alias("line_start"),
        _typed(o, "lineEnd", "number").alias("line_end"),
        _typed(o, "symbolName", "string").alias("symbol_name"),
        _typed(o, "tags", "strings").alias("tags"),
        _typed(o, "estimatedHours", "number").alias("estimated_hours"),
        _typed(o, "hoursWasted", "number").alias("hours_wasted"),
    )
    reject = (
        F.when(F.col("title").isNull() | F.col("severity").isNull(), "missing_field")
        .when(~F.col("severity").isin(SEVERITIES), "bad_severity")
        .when(blank(F.col("title")), "blank_title")
        .when(blank(F.col("description")), "blank_description")
    )
    return d.withColumn("reject", reject)


def incomplete_rows(parsed: DataFrame) -> DataFrame:
    """An informational, penalty-free finding for every reply that gave none to read."""
    reason = F.col("status")
    for k, v in REASONS.items():
        reason = F.when(F.col("status") == k, F.lit(v)).otherwise(reason)
    return parsed.where("status <> 'ok'").select(
        "batch_id", "agent_name", F.lit("info").alias("severity"),
        F.concat(F.lit("[REVIEW INCOMPLETE] "), "agent_name", F.lit(" response could not be parsed")).alias("title"),
        F.concat(
            F.lit("The "), "agent_name", F.lit(" agent's response for this batch "), reason,
            F.lit(". Findings for this batch may be missing — this is not a signal that the reviewed code is clean."),
        ).alias("description"),
        F.lit("review-incomplete,parse-failure").alias("tags"), F.lit(0.0).alias("score_penalty"),
    )


def choose_attempt(parsed: DataFrame) -> DataFrame:
    """Per batch and agent the first attempt that parsed, else the first."""
    cols = [c for c in parsed.columns if c not in ("batch_id", "agent_name")]
    best = F.min_by(F.struct(*cols), F.struct(F.col("status") != "ok", "attempt")).alias("best")
    return parsed.groupBy("batch_id", "agent_name").agg(best).select("batch_id", "agent_name", "best.*")


def canonical_agent(name: Column, domains: list[str] | None = None) -> Column:
    """Known domain for a reported name, ignoring case, spaces, hyphens and underscores."""
    domains = domains or DOMAINS
    squeeze = lambda s: "".join(ch for ch in s.lower() if ch not in " _-")
    table = {squeeze(d): d for d in domains}
    table |= {k: v for k, v in DOMAIN_ALIASES.items() if v in domains and k not in table}
    known = F.create_map(*[F.lit(x) for x in itertools.chain(*table.items())])
    key = F.regexp_replace(F.lower(_trim(name)), r"[\s_-]+", "")
    return F.when(name.isin(domains), name).otherwise(F.try_element_at(known, key))


def attribute_findings(findings: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Findings of a combined call under their domain; unknown ones leave one counting row per batch."""
    f = findings.withColumn("domain", canonical_agent(F.coalesce("claimed_agent", "agent_name"), domains))
    kept = f.where("domain IS NOT NULL").select("batch_id", F.col("domain").alias("agent_name"), "severity", "title", "description")
    lost = f.where("domain IS NULL").groupBy("batch_id").agg(F.count("*").alias("n")).select(
        "batch_id", F.lit("combined").alias("agent_name"), F.lit("info").alias("severity"),
        F.lit("[REVIEW INCOMPLETE] combined response could not be parsed").alias("title"),
        F.concat(
            F.lit("The combined agent's response for this batch dropped "), F.col("n").cast("string"),
            F.lit(" finding(s) with an agentName that didn't match any active domain. Findings for this batch may be"
                  " missing — this is not a signal that the reviewed code is clean."),
        ).alias("description"),
    )
    return kept.unionByName(lost)


def apply_verification(findings: DataFrame, replies: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drop critical and high findings answered NO, or citing a file nobody knows.

    ``replies(seq, reply)``: the last standalone YES or NO counts, anything else
    keeps the finding. A finding without reply is checked against ``files(path)`` if given, within
    its own project where ``files`` has ``project_id``.
    """
    token = r"(?i)(?<![A-Za-z0-9_])(YES|NO)(?![A-Za-z0-9_])"
    answer = F.upper(F.try_element_at(F.regexp_extract_all(without_reasoning(F.col("reply")), F.lit(token), F.lit(1)), F.lit(-1)))
    d = findings.join(replies.select("seq", "reply"), "seq", "left").withColumn("_a", answer)
    unknown = F.lit(False)
    if files is not None:
        keys = ["project_id", "path"] if "project_id" in files.columns else ["path"]
        known = files.select(*keys, F.lit(True).alias("_known")).distinct()
        d = d.join(known, keys, "left")
        unknown = F.col("reply").isNull() & F.col("path").isNotNull() & F.col("_known").isNull()
    checked = F.col("severity").isin("critical", "high")
    drop = checked & (F.coalesce(F.col("_a") == "NO", F.lit(False)) | unknown)
    return d.where(~drop).select(*findings.columns)


def salvage_ranking(responses: DataFrame) -> DataFrame:
    """Ranked names of a reply: its first string array, else every complete string after the first bracket."""
    text = let(
        _fenced(_trim(F.coalesce("content", F.lit(""))), "["),
        lambda t: F.coalesce(F.nullif(F.regexp_extract(t, FLAT_ARRAY, 0), F.lit("")), t),
    )

    def read(body: Column) -> Column:
        listed = lambda v: F.transform(
            F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
            lambda x: F.try_variant_get(x, "$", "string"),
        )
        tail = F.substring(body, F.instr(body, "["), F.length(body))
        loose = F.when(
            F.contains(body, F.lit("[")), F.regexp_extract_all(tail, F.lit(r'"((?:[^"\\]++|\\.)*+)"'), F.lit(1))
        )
        decoded = lambda s: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0)), s)
        return let(F.try_parse_json(body), lambda v: F.when(v.isNull(), F.transform(loose, decoded)).otherwise(listed(v)))

    names = let(text, read)
    rest = [c for c in responses.columns if c != "content"]
    return responses.select(*rest, F.posexplode(names).alias("rank", "name"))


def _object(text: Column) -> Column:
    """JSON object of a reply: the whole text, else its outermost braces."""
    return let(
        _fenced(without_reasoning(text), "{"),
        lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(_outer(t, "{", "}"))),
    )


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Typed arbitration replies; a reply with a missing or mistyped field is left out."""
    rest = [c for c in replies.columns if c != "content"]
    d = replies.withColumn("v", _object(F.col("content")))
    v = F.col("v")
    confidence = F.coalesce(_typed(v, "confidence", "number"), _typed(v, "confidence", "string").try_cast("double"))
    return d.select(
        *rest,
        _typed(v, "is_conflict", "boolean").alias("is_conflict"),
        _typed(v, "decision", "string").alias("decision"),
        _typed(v, "tradeoff_accepted", "string").alias("tradeoff"),
        confidence.alias("confidence"),
        _typed(v, "losing_side", "string").alias("losing_side"),
    ).dropna(subset=["is_conflict", "decision", "tradeoff", "confidence", "losing_side"])


def parse_synthesis(replies: DataFrame) -> DataFrame:
    """Summary, fixes and observations of a synthesis reply; without a summary it is left out.

    A reply is parsed once, and so is each of its fields: the result leaves a generator, past which no use repeats it.
    """
    rest = [c for c in replies.columns if c != "content"]

    def number(x: Column, path: str, pattern: str) -> Column:
        lead = lambda y: F.nullif(F.regexp_extract(F.coalesce(_as(y, "string"), F.lit("")), pattern, 1), F.lit(""))
        field = F.try_variant_get(x, f"$.{path}", "variant")
        return let(field, lambda y: F.coalesce(_as(y, "number"), lead(y).cast("double"), F.lit(0.0)))

    def fix(x: Column) -> Column:
        return F.struct(
            number(x, "rank", r"^\s*(-?\d+)").alias("rank"), _typed(x, "title", "string").alias("title"),
            _typed(x, "rationale", "string").alias("rationale"),
            number(x, "estimatedHours", r"^\s*(-?\d+(?:\.\d+)?)").alias("estimated_hours"),
            _typed(x, "affectedFiles", "strings").alias("affected_files"),
        )

    def read(v: Column) -> Column:
        listed = F.coalesce(F.try_variant_get(v, "$.priorityFixes", "array<variant>"), F.array().cast("array<variant>"))
        fixes = F.filter(F.transform(listed, fix), lambda f: f["title"].isNotNull() & f["rationale"].isNotNull())
        return F.struct(
            _typed(v, "executiveSummary", "string").alias("summary"),
            fixes.alias("fixes"),
            _typed(v, "crossCuttingObservations", "strings").alias("observations"),
            F.coalesce(_typed(v, "debtEstimate.highestROIFix", "string"), F.lit("")).alias("best_fix"),
        )

    both = F.transform(F.array(_object(F.col("content"))), read)
    return replies.select(*rest, F.inline(F.filter(both, lambda r: r["summary"].isNotNull())))
