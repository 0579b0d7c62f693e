WITH s AS (SELECT project_id, symbol_name, min(seq) AS seq FROM findings WHERE path IS NOT NULL AND symbol_name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT agent_name) >= 2) SELECT f.project_id, CAST(count(*) AS INT) AS bugs, CAST((SELECT count(*) FROM s WHERE s.project_id = f.project_id) AS INT) AS issues FROM findings f GROUP BY f.project_id
