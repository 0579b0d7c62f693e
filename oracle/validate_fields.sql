WITH o AS (SELECT batch_id, agent_name, regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}') AS l FROM responses),
x AS (SELECT batch_id, agent_name, i - 1 AS pos, l[i] AS j FROM o, unnest(range(1, len(l) + 1)) AS r(i)),
y AS (SELECT *, json_extract_string(j, '$.title') AS title, lower(trim(json_extract_string(j, '$.severity'))) AS severity FROM x)
SELECT batch_id, agent_name, CAST(pos AS INT) AS pos, title, severity, nullif(json_extract_string(j, '$.filePath'), '') AS path, CAST(json_extract_string(j, '$.lineStart') AS DOUBLE) AS line_start,
  CASE WHEN severity NOT IN ('critical', 'high', 'medium', 'low', 'info') THEN 'bad_severity' END AS reject FROM y
