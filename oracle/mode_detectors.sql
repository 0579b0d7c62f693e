SELECT DISTINCT agent_name AS name, agent_name <> 'logic' AS builtin, CASE agent_name WHEN 'architecture' THEN 0 WHEN 'maintainability' THEN 1 ELSE 2 END AS position
FROM findings WHERE agent_name IN ('architecture', 'maintainability', 'logic')
