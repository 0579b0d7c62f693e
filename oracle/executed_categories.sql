WITH b AS (SELECT project_id, agent_name, bool_or(errored) AS e FROM agent_batches GROUP BY ALL UNION ALL SELECT DISTINCT project_id, 'deadCode', TRUE FROM agent_batches)
SELECT project_id, agent_name AS category, e AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.project_id = b.project_id AND f.agent_name = b.agent_name) AS failed FROM b
