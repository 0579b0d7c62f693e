WITH s AS (
  SELECT project_id, symbol_name, count(DISTINCT path) AS r, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS k
  FROM findings WHERE path IS NOT NULL AND symbol_name IS NOT NULL GROUP BY project_id, symbol_name HAVING count(DISTINCT agent_name) >= 2)
SELECT project_id, round(CAST(sum(CASE k WHEN 0 THEN 15 WHEN 1 THEN 8 WHEN 2 THEN 4 ELSE 0 END * least(1 + log2(r) * CAST(0.2 AS DOUBLE), 3)) AS DOUBLE), 6) AS cross_penalty FROM s GROUP BY project_id
