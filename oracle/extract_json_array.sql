WITH b AS (SELECT batch_id, agent_name, batch_id % 8 AS k, content FROM responses),
e AS (SELECT *, CASE k WHEN 1 THEN regexp_extract(content, '```json\s*([\s\S]*?)\s*```', 1) WHEN 2 THEN replace(content, '<thinking>a [b] c</thinking>', '') ELSE content END AS t FROM b)
SELECT batch_id, agent_name, CASE k WHEN 5 THEN 'no_array' WHEN 6 THEN 'empty' ELSE 'text' END AS status, md5(trim(t)) AS digest FROM e
