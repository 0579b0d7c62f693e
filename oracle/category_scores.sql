WITH p AS (
  SELECT project_id, agent_name, severity, CASE WHEN score_penalty IS NULL OR isnan(score_penalty) THEN
     CASE severity WHEN 'critical' THEN CAST(10 AS DOUBLE) WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 0.5 ELSE 0 END ELSE score_penalty END * CASE WHEN agent_name <> 'maintainability' THEN CAST(1 AS DOUBLE) WHEN complexity < 5 THEN 0.5 WHEN complexity > 20 THEN 1.5 ELSE 1 END AS pen FROM findings),
d AS (SELECT DISTINCT project_id, unnest(['security','architecture','performance','maintainability','deadCode','testIntelligence','pragmatism','logic']) AS agent_name FROM findings),
k AS (SELECT project_id, agent_name FROM d UNION SELECT project_id, agent_name FROM p)
SELECT k.project_id, k.agent_name AS category, CAST(greatest(10, floor(100 - least(coalesce(sum(pen), 0), 90) + 0.5)) AS INT) AS score, count(pen) AS finding_count,
  count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count, CAST(coalesce(sum(pen), 0) AS DOUBLE) AS penalty
FROM k LEFT JOIN p ON k.project_id = p.project_id AND k.agent_name = p.agent_name GROUP BY k.project_id, k.agent_name
