"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pathlib import Path

from corpuslens.plans import (  # noqa: F401
    corpus_queries,
    diff_queries,
    findings_queries,
    graph_queries,
    io_queries,
    reply_queries,
    retrieval_queries,
    triage_queries,
)
from corpuslens.plans.fixtures import prelude
from corpuslens.plans.registry import QUERIES

ORACLE_DIR = Path(__file__).resolve().parents[2] / "oracle"


def oracle_sql() -> dict[str, str]:
    """Each file of ``oracle/`` behind the fixture views it mentions.

    A file is either a SELECT or a list of CTEs followed by one (starting WITH).
    """
    out = {}
    for f in sorted(ORACLE_DIR.glob("*.sql")):
        body = f.read_text().strip().rstrip(";")
        ctes = prelude(body, "duckdb")
        if body.upper().startswith("WITH "):
            body = body[5:]
            lead = "WITH RECURSIVE " + ",\n".join([*ctes, ""])
        else:
            lead = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n") if ctes else ""
        out[f.stem] = lead + body
    return {k: v for k, v in out.items() if k in QUERIES}
