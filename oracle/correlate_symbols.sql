WITH grp AS (SELECT symbol_name AS g, f.*, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM findings f WHERE path IS NOT NULL AND symbol_name IS NOT NULL),
agg AS (
  SELECT project_id, g, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(DISTINCT agent_name) AS na, min(r) AS r,
    min(line_start) AS lo, max(line_start) AS hi, min(seq) AS first_seq, any_value(path) AS path, count(DISTINCT path) AS nf,
    array_to_string(list(title ORDER BY r, seq)[1:3], '; ') AS description
  FROM grp GROUP BY project_id, g HAVING count(DISTINCT agent_name) >= 2)
SELECT project_id, 'symbol' AS kind, 'Symbol "' || g || '" flagged across domains' AS title,
  description, agents, CAST(NULL AS VARCHAR) AS path, g AS symbol_name, CASE r WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, nf AS blast_radius, CAST(NULL AS INT) AS line_lo, CAST(NULL AS INT) AS line_hi, first_seq FROM agg
