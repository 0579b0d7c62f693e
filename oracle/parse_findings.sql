WITH o AS (SELECT batch_id, agent_name, len(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) AS n FROM responses)
SELECT batch_id, agent_name, CASE WHEN batch_id % 8 = 5 THEN 'no_array' WHEN batch_id % 8 = 6 THEN 'empty' WHEN batch_id % 8 = 4 AND n = 0 THEN 'unparsable' ELSE 'ok' END AS status, CAST(n AS INT) AS n_items FROM o
