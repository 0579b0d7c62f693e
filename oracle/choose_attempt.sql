WITH s AS (SELECT batch_id, agent_name, CASE WHEN batch_id % 8 = 5 THEN 'no_array' WHEN batch_id % 8 = 6 THEN 'empty' WHEN batch_id % 8 = 4 AND len(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) = 0 THEN 'unparsable' ELSE 'ok' END AS status FROM responses),
a AS (SELECT *, 1 AS attempt FROM s UNION ALL SELECT batch_id + 1, agent_name, status, 2 FROM s)
SELECT batch_id, agent_name, attempt, status FROM a QUALIFY row_number() OVER (PARTITION BY batch_id, agent_name ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, attempt) = 1
