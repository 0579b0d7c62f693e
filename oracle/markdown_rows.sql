WITH c AS (SELECT project_id, seq, coalesce(path, '') AS path, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank,
  [CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔵' ELSE '⚪' END || ' ' || severity,
   CASE WHEN path IS NULL THEN 'N/A' ELSE path || CASE WHEN line_start IS NULL THEN '' ELSE ':' || CAST(line_start AS VARCHAR) || CASE WHEN line_end IS NULL OR line_end = line_start THEN '' ELSE '-' || CAST(line_end AS VARCHAR) END END END,
   agent_name, title, description] AS cells FROM findings),
r AS (SELECT project_id, rank, path, seq, '| ' || array_to_string(list_transform(cells, lambda x: CASE WHEN length(x) <= 21 THEN x ELSE substring(x, 1, 20) || '…' END), ' | ') || ' |' AS row FROM c) SELECT * FROM r
