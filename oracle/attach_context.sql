WITH c AS (SELECT project_id, file_seq AS seq, path, content, path || ':1-' || CAST(len(string_split(content, chr(10))) AS VARCHAR) AS chunk_id, len(string_split(content, chr(10))) AS end_line,
  nullif(regexp_extract(content, '(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') AS sym FROM files),
w AS (SELECT project_id, chunk_id, seq, word, count(*) AS tf FROM (SELECT project_id, chunk_id, seq, unnest(regexp_extract_all(lower(content), '\b[a-z]{4,}\b')) AS word FROM c) GROUP BY ALL),
n AS (SELECT chunk_id, sum(tf) AS n FROM w GROUP BY chunk_id) , q AS (SELECT DISTINCT project_id, chunk_id AS subject, unnest(regexp_extract_all(lower(concat_ws(' ', sym, substring(content, 1, 200))), '\b[a-z]{4,}\b')) AS word FROM c WHERE sym <> ''),
s AS (SELECT q.project_id, q.subject, w.chunk_id, w.seq, sum(tf) / (n + 1) AS score FROM q JOIN w ON w.project_id = q.project_id AND w.word = q.word AND w.chunk_id <> q.subject JOIN n ON n.chunk_id = w.chunk_id
  WHERE q.word NOT IN ('async', 'await', 'class', 'const', 'export', 'from', 'function', 'import', 'interface', 'return', 'type') GROUP BY q.project_id, q.subject, w.chunk_id, w.seq, n),
found AS (SELECT project_id, subject, chunk_id, score, CAST(row_number() OVER (PARTITION BY subject ORDER BY score DESC, seq) AS INT) AS rank FROM s QUALIFY rank <= 3) , t AS (SELECT DISTINCT project_id, chunk_id, seq, lower(unnest(regexp_extract_all(content, '\b[A-Za-z_][A-Za-z0-9_]{3,}\b'))) AS term FROM c),
-- stop words, import patterns, marker texts and limits are fixed values
u AS (SELECT * FROM t WHERE term NOT IN ('async', 'await', 'class', 'const', 'export', 'from', 'function', 'import', 'interface', 'return', 'type')) , im AS (SELECT DISTINCT project_id, chunk_id AS subject, unnest(CASE WHEN regexp_matches(path, '\.(ts|js)$') THEN regexp_extract_all(content, '(?m)(?:^[ \t]*import\s+(?:[\w$*{}\s,]+?\s+from\s+)?|\brequire\(\s*)[''"]([^''"\n]+)[''"]', 1) ELSE regexp_extract_all(content, '(?:\bimport(?:[\s\S]*?from\s+)?|\brequire\()\s*[''"]([^''"]+)[''"]', 1) END) AS spec FROM c),
st AS (SELECT project_id, chunk_id, seq, content, regexp_replace(path, '\.(ts|js|py)$', '') AS stem, regexp_extract(regexp_replace(path, '\.(ts|js|py)$', ''), '([^/]*)$', 1) AS base FROM c),
ov AS (SELECT a.project_id, a.chunk_id AS subject, b.chunk_id, least(count(*), 4) AS p FROM u a JOIN u b ON a.project_id = b.project_id AND a.term = b.term AND a.chunk_id <> b.chunk_id GROUP BY ALL),
ev AS (
  SELECT project_id, subject, chunk_id, p FROM ov
  UNION ALL SELECT im.project_id, im.subject, st.chunk_id, 10 FROM im JOIN st ON st.project_id = im.project_id AND st.chunk_id <> im.subject AND starts_with(im.spec, '../d') AND st.stem = 'src/' || regexp_replace(regexp_replace(im.spec, '^\.\./', ''), '\.(ts|js|py)$', '')
  UNION ALL SELECT a.project_id, a.chunk_id, b.chunk_id, 4 FROM st a JOIN st b ON a.project_id = b.project_id AND a.chunk_id <> b.chunk_id AND contains(b.content, a.base)),
sc AS (SELECT project_id, subject, chunk_id, CAST(sum(p) AS BIGINT) AS score FROM ev GROUP BY ALL HAVING sum(p) >= 4),
rel AS (SELECT sc.*, CAST(row_number() OVER (PARTITION BY subject ORDER BY score DESC, c.seq) AS INT) AS rank FROM sc JOIN c USING (chunk_id) QUALIFY rank <= 4) , bl AS (
  SELECT subject, 0 AS source, rank, chunk_id, '// --- ' || path || ' (score ' || CAST(score AS VARCHAR) || ', lines 1-' || CAST(end_line AS VARCHAR) || ') ---' || chr(10)
    || CASE WHEN length(content) > 900 THEN substring(content, 1, 900) || chr(10) || '... (truncated)' ELSE content END AS block FROM rel JOIN c USING (chunk_id)
  UNION ALL SELECT subject, 1, rank, chunk_id, '// --- ' || path || ' (lines 1-' || CAST(end_line AS VARCHAR) || CASE WHEN sym <> '' THEN ', ' || sym ELSE '' END || ') ---' || chr(10)
    || CASE WHEN length(content) > 1000 THEN substring(content, 1, 1000) || chr(10) || '... (truncated)' ELSE content END FROM found JOIN c USING (chunk_id)),
b1 AS (SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY subject, chunk_id ORDER BY source, rank) = 1),
ctx AS (SELECT subject, chr(10) || chr(10) || CASE WHEN min(source) = 0 THEN '/* [REPOSITORY CONTEXT] */' || chr(10) ELSE '/* [REPOSITORY CONTEXT (KEYWORD)] */' || chr(10) || chr(10) END || string_agg(block, chr(10) || chr(10) ORDER BY source, rank) || chr(10) || CASE WHEN min(source) = 0 THEN '' ELSE chr(10) END || '/* [END REPOSITORY CONTEXT] */' || chr(10) || chr(10) AS context FROM b1 GROUP BY subject),
w0 AS (SELECT seq, path, content, string_split(content, chr(10)) AS l, coalesce(context, '') AS pre FROM c LEFT JOIN ctx ON ctx.subject = c.chunk_id),
w1 AS (SELECT *, CAST(ceil(length(pre || content) / 4.0) AS INT) AS tok, len(l) AS lines FROM w0),
cum AS (SELECT seq, sum(length(l[i]) + 1) OVER (PARTITION BY seq ORDER BY i) AS chars, length(pre) AS pl FROM w1, unnest(range(1, least(20, lines) + 1)) AS r(i)),
fit AS (SELECT seq, count(*) FILTER (chars <= 4080 - pl) AS k FROM cum GROUP BY seq),
w2 AS (SELECT w1.*, CASE WHEN length(pre) > 0 THEN greatest(1, k) ELSE least(20, lines) END AS e0 FROM w1 JOIN fit USING (seq)),
w3 AS (SELECT *, CASE WHEN e0 > 5 THEN e0 - 5 ELSE e0 END AS s1 FROM w2),
parts AS (
  SELECT path, 0 AS part, pre, 0 AS s, CASE WHEN tok <= 1200 THEN lines ELSE e0 END AS e, l FROM w3
  UNION ALL
  SELECT path, i + 1, '', s1 + 15 * i, least(s1 + 15 * i + 20, lines), l FROM w3, unnest(range(0, 1 + CAST(ceil(greatest(0, lines - (s1 + 20)) / 15.0) AS INT))) AS r(i) WHERE tok > 1200 AND e0 < lines)
SELECT path || ':' || CAST(s + 1 AS VARCHAR) || '-' || CAST(e AS VARCHAR) AS chunk_id, CAST(part AS INT) AS part, CAST(s + 1 AS INT) AS start_line, CAST(e AS INT) AS end_line,
  CAST(ceil(length(pre || array_to_string(l[s + 1 : e], chr(10))) / 4.0) AS INT) AS token_count FROM parts
