WITH o AS (SELECT batch_id, agent_name, batch_id % 8 AS k, len(regexp_extract_all(content, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) AS n FROM responses)
SELECT batch_id, agent_name, 'info' AS severity, '[REVIEW INCOMPLETE] ' || agent_name || ' response could not be parsed' AS title,
  'The ' || agent_name || ' agent''s response for this batch ' || CASE k WHEN 5 THEN 'contained no JSON findings array' WHEN 6 THEN 'was empty' ELSE 'could not be parsed as JSON' END
  || '. Findings for this batch may be missing — this is not a signal that the reviewed code is clean.' AS description, 'review-incomplete,parse-failure' AS tags
FROM o WHERE k IN (5, 6) OR (k = 4 AND n = 0)
