"""Findings reports per run, as JSON and as Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import half_up, severity_rank, table_cell, table_row
from corpuslens.session import cut_lineage

# Fixed: mark in front of a severity.
SEVERITY_MARK = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
COLUMNS = ["Severity", "File", "Category", "Title", "Description"]
# Fixed: sections of the report after the score, with the columns of their tables, and names of categories.
SECTIONS = {
    "Category Scores": ["Category", "Score", "Bar", "Findings"],
    "Debt Estimate": ["Critical", "High", "Medium", "Low", "Info", "Total"],
    "Cross-Agent Findings": ["Severity", "Title", "Agents", "Files", "Blast Radius"],
    "Findings Summary": ["Agent", "Total", "Critical", "High"],
    "Detailed Findings": COLUMNS,
    "Agent Timings": ["Agent", "Duration (ms)"],
}
CATEGORY_LABELS = {
    "security": "Security",
    "architecture": "Architecture",
    "performance": "Performance",
    "maintainability": "Maintainability",
    "deadCode": "Dead Code",
    "testIntelligence": "Test Intelligence",
    "logic": "Logic",
    "pragmatism": "Pragmatism",
}


def json_rows(findings: DataFrame, cross: DataFrame) -> DataFrame:
    """Every entry of the report as one JSON text: ``kind`` bug or issue, in ``seq`` order.

    The scalable form: a project with any number of findings is any number of rows.
    """
    bug = F.to_json(F.struct(
        F.col("seq").cast("string").alias("id"), F.col("path").alias("file"), F.col("line_start").alias("lineStart"),
        F.col("line_end").alias("lineEnd"), "severity", "title", "description",
    ))
    issue = F.to_json(F.struct("title", "description", F.split(F.coalesce("path", F.lit("")), ",").alias("affectedFiles"), "severity"))
    return findings.select("project_id", F.lit("bug").alias("kind"), "seq", bug.alias("entry")).unionByName(
        cross.select("project_id", F.lit("issue").alias("kind"), F.col("first_seq").alias("seq"), issue.alias("entry"))
    )


def write_json_report(findings: DataFrame, cross: DataFrame, path: str) -> None:
    """JSON lines per project and kind, sorted inside each file."""
    rows = json_rows(findings, cross)
    (
        rows.repartitionByRange("project_id", "kind", "seq")
        .sortWithinPartitions("project_id", "kind", "seq")
        .select("project_id", "kind", F.col("entry").alias("value"))
        .write.partitionBy("project_id", "kind")
        .mode("overwrite")
        .text(path)
    )


def json_documents(findings: DataFrame, cross: DataFrame) -> DataFrame:
    """One nested document per project, of any size; ``json_rows`` is the form to write out at scale."""
    rows = json_rows(findings, cross)
    part = lambda k: F.concat(F.lit("["), F.array_join(F.transform(F.filter("l", lambda x: x["kind"] == k), lambda x: x["entry"]), ","), F.lit("]"))
    return (
        rows.groupBy("project_id")
        .agg(F.array_sort(F.collect_list(F.struct("kind", "seq", "entry"))).alias("l"))
        .select("project_id", F.concat(F.lit('{"bugs":'), part("bug"), F.lit(',"architecturalIssues":'), part("issue"), F.lit("}")).alias("document"))
    )


def markdown_rows(findings: DataFrame, width: int = 120) -> DataFrame:
    """The findings table row by row, with the keys that order it; cells are cut for a table of ``width``."""
    mark = F.lit("")
    for s, m in SEVERITY_MARK.items():
        mark = F.when(F.col("severity") == s, F.lit(m)).otherwise(mark)
    span = F.when(
        F.col("line_end").isNotNull() & (F.col("line_end") != F.col("line_start")), F.concat(F.lit("-"), F.col("line_end").cast("string"))
    ).otherwise("")
    at = F.when(F.col("line_start").isNotNull(), F.concat(F.lit(":"), F.col("line_start").cast("string"), span)).otherwise("")
    place = F.when(F.coalesce("path", F.lit("")) != "", F.concat("path", at)).otherwise("N/A")
    cells = [F.concat(mark, F.lit(" "), "severity"), place, F.col("agent_name"), F.col("title"), F.col("description")]
    row = table_row([table_cell(c, len(COLUMNS), width) for c in cells])
    return findings.select(
        "project_id", severity_rank("severity").alias("rank"), F.coalesce("path", F.lit("")).alias("path"), "seq", row.alias("row")
    )


HEAD_ROWS = ["| " + " | ".join(COLUMNS) + " |", "| " + " | ".join("---" for _ in COLUMNS) + " |"]


def markdown_lines(findings: DataFrame) -> DataFrame:
    """``markdown_rows`` after the two head rows of each project, which rank before all severities."""
    rows = markdown_rows(findings)
    head = F.posexplode(F.array(*map(F.lit, HEAD_ROWS))).alias("seq", "row")
    heads = rows.select("project_id").distinct().select("project_id", head)
    heads = heads.select("project_id", F.lit(-1).alias("rank"), F.lit("").alias("path"), F.col("seq").cast("long").alias("seq"), "row")
    return heads.unionByName(rows.select(*heads.columns))


def score_bar(score: Column, width: int) -> Column:
    full = half_up(F.least(F.greatest(score, F.lit(0)), F.lit(100)) / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full))


def _section(rows: DataFrame, number: int, cells: list[Column], order: Column, ties: Column, width: int = 120) -> DataFrame:
    row = table_row([table_cell(c.cast("string"), len(cells), width) for c in cells])
    return rows.select("project_id", F.lit(number).alias("section"), order.cast("double").alias("rank"), ties.alias("path"),
                       F.coalesce(F.col("seq"), F.lit(0)).cast("long").alias("seq"), row.alias("row"))


def report_lines(findings: DataFrame, cross: DataFrame, scores: DataFrame, categories: DataFrame, timings: DataFrame) -> DataFrame:
    """Every line of the Markdown report: ``row`` in the order of ``section, rank, path, seq`` of a project.

    ``scores`` has a row per project with ``score, grade, finding_count, cross_agent_count`` and, if known,
    ``delta``; it decides which projects have a report. ``cross`` names its files in ``path``, joined by
    commas; with an ``n_files`` column ``path`` is only the first. ``timings`` has ``project_id, agent_name,
    duration_ms``. Headings and notes come from ``scores``, so no section is gathered and any table may be long.
    """
    scores = cut_lineage(scores)  # a row per project, read four times
    mark = lambda: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_MARK.items() for x in kv]), F.col("severity")), F.lit(""))
    delta = F.coalesce("delta", F.lit(0)) if "delta" in scores.columns else F.lit(0)
    change = F.when(delta == 0, F.lit("→ No change")).when(delta > 0, F.concat(F.lit("↑ +"), delta.cast("string"))).otherwise(
        F.concat(F.lit("↓ "), delta.cast("string"))
    )
    title = F.concat(F.lit("## Score: "), F.col("score").cast("string"), F.lit("/100 ("), "grade", F.lit(") "), change)
    blank = F.lit("")
    fixed = [[title, blank, F.lit("```"), score_bar(F.col("score"), 20), F.lit("```"), blank]]
    empty = {
        "Cross-Agent Findings": ("cross_agent_count", "*No cross-agent findings.*"),
        "Detailed Findings": ("finding_count", "*No individual findings.*"),
    }
    for heading, columns in SECTIONS.items():
        names, rule = F.lit("| " + " | ".join(columns) + " |"), F.lit("| " + " | ".join("---" for _ in columns) + " |")
        if heading in empty:
            count, note = empty[heading]
            names, rule = F.when(F.col(count) > 0, names).otherwise(note), F.when(F.col(count) > 0, rule)
        fixed.append([F.lit(f"## {heading}"), blank, names, rule])
    heads = F.array(*[
        F.struct(F.lit(n).alias("section"), F.lit(-1.0).alias("rank"), F.lit("").alias("path"), F.lit(i).cast("long").alias("seq"), row.alias("row"))
        for n, rows in enumerate(fixed) for i, row in enumerate(rows)
    ])
    ends = F.array(*[
        F.struct(F.lit(n).alias("section"), F.lit(1e15).alias("rank"), F.lit("").alias("path"), F.lit(0).cast("long").alias("seq"), blank.alias("row"))
        for n in range(1, len(fixed))
    ])
    lines = scores.select("project_id", F.inline(F.concat(heads, ends))).where("row IS NOT NULL")

    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv]), F.col("category")),
                       F.concat(F.upper(F.substring("category", 1, 1)), F.expr("substring(category, 2)")))
    no_seq = lambda df: df.withColumn("seq", F.lit(0))
    files = F.split("path", ",")
    n_files = F.col("n_files") if "n_files" in cross.columns else F.size(files)
    more = F.concat(files[0], F.lit(" (+"), (n_files - 1).cast("string"), F.lit(")"))
    place = F.when(F.coalesce("path", blank) == "", "N/A").when(n_files > 1, more).otherwise(files[0])
    per_agent = findings.groupBy("project_id", "agent_name").agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"), F.min("seq").alias("seq"),
    )
    debt = findings.groupBy("project_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_MARK], F.count("*").alias("total"))
    debt = scores.select("project_id").join(debt, "project_id", "left").na.fill(0)
    detail = markdown_rows(findings, 200).select(
        "project_id", F.lit(5).alias("section"), F.col("rank").cast("double").alias("rank"), "path", F.col("seq").cast("long").alias("seq"), "row"
    )
    parts = [
        _section(no_seq(categories), 1, [label, F.col("score"), score_bar(F.col("score"), 8), F.col("finding_count")], F.lit(0), F.col("category")),
        _section(no_seq(debt), 2, [F.col(c) for c in (*SEVERITY_MARK, "total")], F.lit(0), blank),
        _section(cross.withColumn("seq", F.col("first_seq")), 3,
                 [F.concat(mark(), F.lit(" "), "severity"), F.col("title"), F.replace("agents", F.lit(","), F.lit(", ")),
                  place, F.col("blast_radius")], F.lit(0), blank),
        _section(per_agent, 4, [F.col(c) for c in ("agent_name", "total", "critical", "high")], F.col("seq"), blank),
        detail,
        _section(no_seq(timings), 6, [F.col("agent_name"), F.col("duration_ms")], -F.col("duration_ms"), F.col("agent_name")),
    ]
    body = reduce(DataFrame.unionByName, parts).join(scores.select("project_id"), "project_id", "left_semi")
    return lines.unionByName(body)


def write_report(lines: DataFrame, path: str) -> None:
    """``report_lines`` as text, a folder per project; lines are in order within a file and from file to file."""
    order = ["project_id", "section", "rank", "path", "seq"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("project_id", F.col("row").alias("value"))
    rows.write.partitionBy("project_id").mode("overwrite").text(path)


def write_markdown_report(findings: DataFrame, path: str) -> None:
    """A table per project in severity, then path order, below its head; the sort is distributed."""
    (
        markdown_lines(findings)
        .repartitionByRange("project_id", "rank", "path", "seq")
        .sortWithinPartitions("project_id", "rank", "path", "seq")
        .select("project_id", F.col("row").alias("value"))
        .write.partitionBy("project_id")
        .mode("overwrite")
        .text(path)
    )


def table_text(findings: DataFrame) -> DataFrame:
    """The whole table of each project as one text; ``markdown_lines`` is the form to write out at scale."""
    lines = markdown_lines(findings).groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "path", "seq", "row"))).alias("l")
    )
    return lines.select("project_id", F.array_join(F.transform("l", lambda x: x["row"]), "\n").alias("table"))
