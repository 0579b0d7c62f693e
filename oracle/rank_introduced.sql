SELECT seq, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity_rank
FROM head_findings f SEMI JOIN changed_files c ON c.path = f.path AND c.project_id = f.project_id
