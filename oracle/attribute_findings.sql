WITH f AS (SELECT CAST(floor(seq / 40) AS BIGINT) AS batch_id, severity, title, description, CASE seq % 6 WHEN 0 THEN agent_name WHEN 1 THEN 'testIntelligence' WHEN 2 THEN 'deadCode' WHEN 3 THEN 'architecture' WHEN 5 THEN agent_name END AS agent_name FROM findings)
SELECT batch_id, agent_name, severity, title, description FROM f WHERE agent_name IS NOT NULL
UNION ALL SELECT batch_id, 'combined', 'info', '[REVIEW INCOMPLETE] combined response could not be parsed', 'The combined agent''s response for this batch dropped ' || CAST(count(*) AS VARCHAR)
  || ' finding(s) with an agentName that didn''t match any active domain. Findings for this batch may be missing — this is not a signal that the reviewed code is clean.' FROM f WHERE agent_name IS NULL GROUP BY batch_id
