WITH p AS (
  SELECT *, CASE WHEN score_penalty IS NULL OR isnan(score_penalty) THEN
     CASE severity WHEN 'critical' THEN CAST(10 AS DOUBLE) WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 0.5 ELSE 0 END ELSE score_penalty END AS penalty FROM findings),
q AS (SELECT *, CASE WHEN path IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY project_id, path ORDER BY penalty DESC, seq) END AS fr FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN fr = 1 THEN 0 ELSE 1 END, penalty DESC, seq) AS pick FROM q) SELECT project_id, agent_name, count(*) FILTER (pick > 50) AS omitted FROM s GROUP BY project_id, agent_name HAVING count(*) FILTER (pick > 50) > 0
