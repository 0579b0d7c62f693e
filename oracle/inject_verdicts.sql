WITH c AS (
  SELECT a.project_id, a.path, least(a.line_start, b.line_start) AS line_start, greatest(a.line_end, b.line_end) AS line_end, a.seq AS sa, (a.seq + b.seq) % 7 AS k
  FROM findings a JOIN findings b ON a.project_id = b.project_id AND a.path = b.path
    AND a.seq < b.seq AND a.agent_name <> b.agent_name AND abs(a.line_start - b.line_start) <= 60)
SELECT seq, project_id, agent_name, severity, title, description, path, line_start, line_end, '' AS tags FROM findings
UNION ALL
SELECT NULL, project_id, 'architecture', 'info', '[VERDICT] ' || path || ':' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR),
  'Decision: keep ' || CAST(sa AS VARCHAR) || chr(10) || 'Tradeoff: slower' || CASE WHEN k = 1 THEN chr(10) || 'Saved as: adr-1.md' ELSE '' END,
  path, line_start, line_end, 'architectural-decision,arbitration-verdict'
FROM c WHERE k < 3
