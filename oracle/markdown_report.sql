WITH p AS (
  SELECT project_id, agent_name, severity, CASE WHEN score_penalty IS NULL OR isnan(score_penalty) THEN
     CASE severity WHEN 'critical' THEN CAST(10 AS DOUBLE) WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 0.5 ELSE 0 END ELSE score_penalty END * CASE WHEN agent_name <> 'maintainability' THEN CAST(1 AS DOUBLE) WHEN complexity < 5 THEN 0.5 WHEN complexity > 20 THEN 1.5 ELSE 1 END AS pen FROM findings),
d AS (SELECT DISTINCT project_id, unnest(['security','architecture','performance','maintainability','deadCode','testIntelligence','pragmatism','logic']) AS agent_name FROM findings),
k AS (SELECT project_id, agent_name FROM d UNION SELECT project_id, agent_name FROM p),
cat AS (SELECT k.project_id, k.agent_name AS category, CAST(greatest(10, floor(100 - least(coalesce(sum(pen), 0), 90) + 0.5)) AS INT) AS score, count(pen) AS finding_count,
  count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, CAST(coalesce(sum(pen), 0) AS DOUBLE) AS penalty
FROM k LEFT JOIN p ON k.project_id = p.project_id AND k.agent_name = p.agent_name GROUP BY k.project_id, k.agent_name),
f AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r,
  CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔵' ELSE '⚪' END AS mark FROM findings),
x AS (SELECT project_id, symbol_name, string_agg(DISTINCT agent_name, ', ' ORDER BY agent_name) AS agents, min(r) AS r, min(seq) AS seq,
  min(path) AS path, count(DISTINCT path) AS n FROM f WHERE path IS NOT NULL AND path <> '' AND symbol_name <> '' GROUP BY ALL HAVING count(DISTINCT agent_name) >= 2),
xp AS (SELECT project_id, count(*) AS n, sum(CASE r WHEN 0 THEN 15 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 0 END * least(1 + log2(n) * CAST(0.2 AS DOUBLE), 3)) AS pen FROM x GROUP BY project_id),
t AS (SELECT c.project_id, avg(c.score) AS mean, round(sum(c.penalty) + coalesce(any_value(xp.pen), 0), 6) AS pen, sum(finding_count) AS nf, coalesce(any_value(xp.n), 0) AS nx
  FROM cat c LEFT JOIN xp ON xp.project_id = c.project_id GROUP BY c.project_id),
s AS (SELECT project_id, nf, nx, project_id % 3 - 1 AS delta,
  CAST(least(100, floor(mean * CAST(0.6 AS DOUBLE) + greatest(5, floor(100 - least(pen, 95) + 0.5)) * CAST(0.4 AS DOUBLE) + 0.5)) AS INT) AS score FROM t),
cells AS (
  SELECT project_id, 1 AS section, CAST(0 AS DOUBLE) AS rank, category AS path, CAST(0 AS BIGINT) AS seq, 120 AS width,
    [CASE category WHEN 'deadCode' THEN 'Dead Code' WHEN 'testIntelligence' THEN 'Test Intelligence' ELSE upper(category[1]) || category[2:] END, CAST(score AS VARCHAR),
     repeat('█', CAST(floor(score * 8 / CAST(100 AS DOUBLE) + 0.5) AS INT)) || repeat('░', 8 - CAST(floor(score * 8 / CAST(100 AS DOUBLE) + 0.5) AS INT)), CAST(finding_count AS VARCHAR)] AS c FROM cat
  UNION ALL SELECT s.project_id, 2, 0, '', 0, 120, [CAST(count(*) FILTER (r = 0) AS VARCHAR), CAST(count(*) FILTER (r = 1) AS VARCHAR), CAST(count(*) FILTER (r = 2) AS VARCHAR),
     CAST(count(*) FILTER (r = 3) AS VARCHAR), CAST(count(*) FILTER (r = 4) AS VARCHAR), CAST(count(r) AS VARCHAR)] FROM s LEFT JOIN f ON f.project_id = s.project_id GROUP BY s.project_id
  UNION ALL SELECT project_id, 3, 0, '', seq, 120, [CASE r WHEN 0 THEN '🔴 critical' WHEN 1 THEN '🟠 high' WHEN 2 THEN '🟡 medium' WHEN 3 THEN '🔵 low' ELSE '⚪ info' END,
     'Symbol "' || symbol_name || '" flagged across domains', agents, path || CASE WHEN n > 1 THEN ' (+' || CAST(n - 1 AS VARCHAR) || ')' ELSE '' END, CAST(n AS VARCHAR)] FROM x
  UNION ALL SELECT project_id, 4, min(seq), '', min(seq), 120, [agent_name, CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (r = 0) AS VARCHAR), CAST(count(*) FILTER (r = 1) AS VARCHAR)]
    FROM f GROUP BY project_id, agent_name
  UNION ALL SELECT project_id, 5, r, coalesce(path, ''), seq, 200, [mark || ' ' || severity,
     CASE WHEN path IS NULL THEN 'N/A' ELSE path || CASE WHEN line_start IS NULL THEN '' ELSE ':' || CAST(line_start AS VARCHAR) || CASE WHEN line_end IS NULL OR line_end = line_start THEN '' ELSE '-' || CAST(line_end AS VARCHAR) END END END,
     agent_name, title, description] FROM f
  UNION ALL SELECT project_id, 6, -sum(seq % 90 + 1), agent_name, 0, 120, [agent_name, CAST(sum(seq % 90 + 1) AS VARCHAR)] FROM f GROUP BY project_id, agent_name),
rows AS (SELECT project_id, section, rank, path, seq, '| ' || array_to_string(list_transform(c, lambda v: CASE WHEN length(v) <= (width - len(c) * 3) // len(c) THEN v
  ELSE substring(v, 1, (width - len(c) * 3) // len(c) - 1) || '…' END), ' | ') || ' |' AS row FROM cells),
heads AS (SELECT * FROM (VALUES (1, 'Category Scores', '| Category | Score | Bar | Findings |'), (2, 'Debt Estimate', '| Critical | High | Medium | Low | Info | Total |'),
  (3, 'Cross-Agent Findings', '| Severity | Title | Agents | Files | Blast Radius |'), (4, 'Findings Summary', '| Agent | Total | Critical | High |'),
  (5, 'Detailed Findings', '| Severity | File | Category | Title | Description |'), (6, 'Agent Timings', '| Agent | Duration (ms) |')) h(section, heading, names)),
headed AS (SELECT s.project_id, h.section, CAST(-1 AS DOUBLE) AS rank, '' AS path, unnest([0, 1, 2, 3]) AS seq,
  unnest(['## ' || heading, '', CASE WHEN section = 3 AND nx = 0 THEN '*No cross-agent findings.*' WHEN section = 5 AND nf = 0 THEN '*No individual findings.*' ELSE names END,
    CASE WHEN (section = 3 AND nx = 0) OR (section = 5 AND nf = 0) THEN NULL ELSE regexp_replace(names, '[A-Z][^|]* ', '--- ', 'g') END]) AS row FROM s, heads h),
bar AS (SELECT *, CAST(floor(score * 20 / CAST(100 AS DOUBLE) + 0.5) AS INT) AS b,
  CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 75 THEN 'B+' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s),
top AS (SELECT project_id, 0 AS section, CAST(-1 AS DOUBLE) AS rank, '' AS path, unnest([0, 1, 2, 3, 4, 5]) AS seq, unnest([
  '## Score: ' || CAST(score AS VARCHAR) || '/100 (' || grade || ') ' || CASE WHEN delta = 0 THEN '→ No change' WHEN delta > 0 THEN '↑ +' || CAST(delta AS VARCHAR) ELSE '↓ ' || CAST(delta AS VARCHAR) END,
  '', '```', repeat('█', b) || repeat('░', 20 - b), '```', '']) AS row FROM bar)
SELECT project_id, section, rank, path, seq, row FROM rows
UNION ALL SELECT * FROM headed WHERE row IS NOT NULL
UNION ALL SELECT * FROM top
UNION ALL SELECT s.project_id, h.section, 1e15, '', 0, '' FROM s, heads h
