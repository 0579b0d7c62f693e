"""Derived views over the given tables: one named CTE each, the same text in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

VIEWS: dict[str, str] = {
    "findings_raw": """
SELECT event_id AS seq, user_id % 5 AS project_id,
  CASE event_type WHEN 'signup' THEN 'security' WHEN 'error' THEN 'logic' WHEN 'click' THEN 'performance'
       WHEN 'view' THEN 'architecture' ELSE 'maintainability' END AS agent_name,
  CASE WHEN event_id % 10 = 0 THEN 'critical' WHEN event_id % 10 < 3 THEN 'high' WHEN event_id % 10 < 6 THEN 'medium'
       WHEN event_id % 10 < 9 THEN 'low' ELSE 'info' END AS severity,
  CASE (event_id * 7) % 12 WHEN 0 THEN 'SQL injection in login' WHEN 1 THEN 'SQL injection in login handler'
       WHEN 2 THEN 'SQL injection' WHEN 3 THEN 'Hardcoded secret in config' WHEN 4 THEN 'Hardcoded secret in source'
       WHEN 5 THEN 'Unbounded cache growth' WHEN 6 THEN 'Unbounded cache growth without eviction' WHEN 7 THEN 'God object'
       WHEN 8 THEN 'Circular dependency between modules' WHEN 9 THEN '!!!' WHEN 10 THEN 'Missing test for error path'
       ELSE 'Unused export' END AS title,
  CASE event_id % 6 WHEN 0 THEN 'validate and sanitize the input' WHEN 1 THEN 'cache the result and skip the check'
       WHEN 2 THEN 'remove the lock to speed this up' WHEN 3 THEN 'add a timeout and limit retries'
       WHEN 4 THEN 'no action words here' ELSE 'simplify and inline the helper' END AS description,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'SRC/M' || CAST(user_id AS STRING) || '.ts'
       WHEN event_id % 13 = 0 THEN './src/../src/m' || CAST(user_id AS STRING) || '.ts'
       ELSE 'src/m' || CAST(user_id AS STRING) || '.ts' END AS path_raw,
  CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE 1 + (event_id * 37) % 400 + CASE WHEN event_id % 17 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END AS line_start_raw,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE 1 + (event_id * 37) % 400 + event_id % 9 END AS line_end_raw,
  CASE WHEN event_id % 5 = 0 THEN 'sym' || CAST(user_id % 40 AS STRING) END AS symbol_name,
  CASE WHEN event_id % 29 = 0 THEN CAST(7.5 AS DOUBLE) WHEN event_id % 31 = 0 THEN CAST('NaN' AS DOUBLE) END AS score_penalty,
  CAST(event_id % 25 AS INT) AS complexity,
  CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 8 + 1 AS DOUBLE) END AS estimated_hours,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS DOUBLE) END AS hours_wasted
FROM events
""",
    "findings": """
SELECT seq, project_id, agent_name, severity, title, description, symbol_name, score_penalty, complexity, estimated_hours, hours_wasted,
  CASE WHEN path_raw IS NULL THEN NULL ELSE lower(replace(path_raw, './src/../', '')) END AS path,
  CAST(floor(line_start_raw + CAST(0.5 AS DOUBLE)) AS INT) AS line_start, CAST(line_end_raw AS INT) AS line_end
FROM findings_raw
""",
    "modules": """
SELECT DISTINCT user_id AS m, 'src/m' || CAST(user_id AS STRING) || '.ts' AS path FROM events
""",
    "finding_chunks": """
SELECT path, k AS chunk_seq, CAST(1 + 120 * k AS INT) AS start_line, CAST(CASE WHEN k = 3 THEN 400 ELSE 150 + 120 * k END AS INT) AS end_line
FROM modules CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) w
WHERE m % 9 <> 0 AND NOT (m % 4 = 0 AND k = 3)
""",
    "base_findings": """
SELECT * FROM findings WHERE seq % 4 <> 3
""",
    "head_findings": """
SELECT seq, project_id, agent_name, severity, title, description, path, CAST(line_start + seq % 13 AS INT) AS line_start,
  CAST(line_end + seq % 13 AS INT) AS line_end, score_penalty FROM findings WHERE seq % 4 <> 0
""",
    "code_meta": """
SELECT doc_id AS file_seq, doc_id % 5 AS project_id, text,
  'src/d' || CAST(doc_id % 20 AS STRING) || '/f' || CAST(doc_id AS STRING) ||
  CASE WHEN doc_id % 7 < 4 THEN '.ts' WHEN doc_id % 7 = 4 THEN '.js' WHEN doc_id % 7 = 5 THEN '.py' ELSE '.txt' END AS path,
  (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS t1,
  CASE WHEN doc_id % 5 = 0 AND doc_id > 0 THEN doc_id - 1 WHEN doc_id % 10 = 9 THEN doc_id + 1 END AS t2
FROM documents
""",
    "files": """
SELECT file_seq, project_id, path,
  CASE WHEN file_seq % 3 = 0 THEN '' ELSE 'import { a } from ''../d' || CAST(t1 % 20 AS STRING) || '/f' || CAST(t1 AS STRING)
     || CASE WHEN file_seq % 4 = 0 THEN '.js' ELSE '' END || '''' || chr(10) END ||
  CASE WHEN t2 IS NULL THEN '' ELSE 'import ''../d' || CAST(t2 % 20 AS STRING) || '/f' || CAST(t2 AS STRING) || '''' || chr(10) END ||
  CASE WHEN file_seq % 31 = 0 THEN '// @rv ignore-file' || chr(10) WHEN file_seq % 11 = 0 THEN '// @rv ignore' || chr(10)
       WHEN file_seq % 9 = 0 THEN '// @rv review: check ' || CAST(file_seq AS STRING) || chr(10)
       WHEN file_seq % 8 = 0 THEN '/* @rv focus: security */' || chr(10) WHEN file_seq % 13 = 0 THEN 'x = "// @rv ignore"' || chr(10) ELSE '' END ||
  'export function sym' || CAST(file_seq % 40 AS STRING) || '() {' || chr(10) || text || chr(10) || '}' ||
  CASE WHEN file_seq % 8 = 0 THEN chr(10) || 'const cache' || CAST(file_seq AS STRING) || ' = new Map()' ELSE '' END ||
  CASE WHEN file_seq % 16 = 0 THEN chr(10) || 'cache' || CAST(file_seq AS STRING) || '.delete(1)' ELSE '' END AS content
FROM code_meta
""",
    "edges": """
SELECT DISTINCT s.path AS importer, t.path AS importee FROM code_meta s JOIN code_meta t
  ON (s.file_seq % 3 <> 0 AND t.file_seq = s.t1) OR t.file_seq = s.t2
WHERE s.path LIKE '%.ts' AND t.path LIKE '%.ts'
""",
    "history": """
SELECT o_custkey % 20 AS project_id, o_orderkey AS run_id, o_orderdate AS ts, CAST(o_orderkey % 101 AS INT) AS score,
  CASE o_orderkey % 4 WHEN 0 THEN 'diff' WHEN 1 THEN 'full' END AS kind FROM orders
""",
    "claims": """
SELECT event_id AS seq, 'a' || CAST(user_id % 6 AS STRING) AS agent_name,
  CASE WHEN event_id % 2 = 0 THEN 'src/' ELSE '' END || 'm' || CAST(user_id AS STRING) || '.ts' AS file,
  CAST(1 + (event_id * 37) % 400 AS INT) AS line_start FROM events WHERE event_type = 'error'
""",
    "defects": """
SELECT m * 3 + j AS seq, 'D' || CAST(m * 3 + j AS STRING) AS id, path AS file, CAST(1 + (m * 13 + j * 131) % 400 AS INT) AS line_start,
  CASE (m + j) % 3 WHEN 0 THEN 'real-bug' WHEN 1 THEN 'fixed-bug' ELSE 'false-positive' END AS category
FROM modules CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) w
""",
    "changes": """
SELECT event_id AS seq, ts, 'src/m' || CAST(user_id AS STRING) || '.ts' AS path,
  CASE event_type WHEN 'error' THEN 'unlink' WHEN 'signup' THEN 'add' ELSE 'change' END AS kind FROM events
""",
    "call_log": """
SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'triage' WHEN 'signup' THEN 'synthesis' ELSE 'primary' END AS role,
  'prov' || CAST(user_id % 4 AS STRING) AS provider, event_id % 9 = 0 AS used_fallback, value AS duration_ms FROM events
""",
    "agent_batches": """
SELECT DISTINCT project_id, agent_name, seq % 10 AS batch_no, (seq % 10) = 7 AS errored FROM findings
""",
    "decisions": """
SELECT 'd' || CAST(seq AS STRING) AS slug, '# d' || CAST(seq AS STRING) || chr(10) || chr(10) || '**Date:** 2024-01-1' || CAST(seq % 10 AS STRING) || chr(10)
  || '**File:** ' || path || ':' || CAST(line_start AS STRING) || '-' || CAST(line_end AS STRING) || chr(10) || '## Decision' || chr(10) || description AS doc
FROM findings WHERE seq % 50 = 1 AND path IS NOT NULL AND line_start IS NOT NULL
""",
}

_DIFF_HEAD = """
SELECT file_seq, project_id, path, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10)
  || '@@ -1,9 +' || CAST(1 + file_seq % 50 AS STRING) || ',9 @@' || chr(10) || {lines} AS diff
FROM (SELECT file_seq, project_id, text, 'src/m' || CAST(file_seq % 150 AS STRING) || '.ts' AS path
      FROM code_meta WHERE file_seq % 4 = 1) c
"""
_SPARK_LINES = """array_join(transform(split(text, '\\n'), (l, i) ->
  CASE WHEN (i * 5 + file_seq) % 7 < 2 THEN '+' WHEN (i * 5 + file_seq) % 7 = 2 THEN '-' ELSE ' ' END || l), chr(10))"""
_DUCK_LINES = """array_to_string(list_transform(string_split(text, chr(10)), lambda l, j:
  CASE WHEN ((j - 1) * 5 + file_seq) % 7 < 2 THEN '+' WHEN ((j - 1) * 5 + file_seq) % 7 = 2 THEN '-' ELSE ' ' END || l), chr(10))"""

_RESPONSE_HEAD = """
SELECT batch_id, agent_name, 1 AS attempt, 'prov' || CAST(batch_id % 4 AS STRING) AS provider,
  CASE batch_id % 8 WHEN 0 THEN body
    WHEN 1 THEN 'Here is [one] example:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 2 THEN '<thinking>a [b] c</thinking>' || body
    WHEN 3 THEN replace(body, '}}]', '}},]')
    WHEN 4 THEN substring(body, 1, CAST(floor(length(body) * CAST(0.66 AS DOUBLE)) AS INT))
    WHEN 5 THEN 'I found nothing to report here.'
    WHEN 6 THEN ''
    ELSE '[]' END AS content
FROM (SELECT batch_id, agent_name, '[' || {joined} || ']' AS body FROM (
    SELECT seq, CAST(floor(seq / 40) AS BIGINT) AS batch_id, agent_name,
      '{{"title":"' || title || '","severity":"' || CASE WHEN seq % 19 = 0 THEN 'urgent' WHEN seq % 7 = 0 THEN upper(severity) ELSE severity END
      || '","description":"' || description || '","filePath":"' || coalesce(path, '') || '","lineStart":'
      || coalesce(CAST(line_start AS STRING), 'null') || '}}' AS o
    FROM findings) p GROUP BY batch_id, agent_name) b
"""
_SPARK_JOINED = "array_join(transform(array_sort(collect_list(struct(seq, o))), x -> x.o), ',')"
_DUCK_JOINED = "string_agg(o, ',' ORDER BY seq)"


def _views(dialect: str) -> dict[str, str]:
    spark = dialect == "spark"
    out = dict(VIEWS)
    if spark:  # the same rows without cross and either-or joins
        out["edges"] = """
SELECT DISTINCT s.path AS importer, t.path AS importee
FROM (SELECT path, explode(array(CASE WHEN file_seq % 3 <> 0 THEN t1 END, t2)) AS target FROM code_meta) s
JOIN code_meta t ON t.file_seq = s.target WHERE s.path LIKE '%.ts' AND t.path LIKE '%.ts'
"""
        for name, alias, values in (("finding_chunks", "k", "0, 1, 2, 3"), ("defects", "j", "0, 1, 2")):
            out[name] = re.sub(
                r"FROM modules CROSS JOIN \(.*?\) w", f"FROM modules LATERAL VIEW explode(array({values})) w AS {alias}", out[name]
            )
    out["changed_files"] = _DIFF_HEAD.format(lines=_SPARK_LINES if spark else _DUCK_LINES)
    out["responses"] = _RESPONSE_HEAD.format(joined=_SPARK_JOINED if spark else _DUCK_JOINED)
    return out


def _needed(views: dict[str, str], text: str, seen: dict[str, None]) -> None:
    for name, body in views.items():
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(views, body, seen)
            seen.setdefault(name)


def prelude(text: str, dialect: str) -> list[str]:
    """CTE definitions, in dependency order, of every derived view ``text`` mentions."""
    views = _views(dialect)
    seen: dict[str, None] = {}
    _needed(views, text, seen)
    return [f"{n} AS ({views[n].strip()})" for n in seen]


class Fixtures:
    """The given tables of one folder, plus the derived views, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, query: str) -> DataFrame:
        ctes = prelude(query, "spark")
        text = " ".join(ctes) + query
        for t in BASE_TABLES:
            if re.search(rf"\b{t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + query)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")
