SELECT project_id, agent_name, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM findings GROUP BY ALL
