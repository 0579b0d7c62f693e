SELECT seq, CASE WHEN agent_name <> 'logic' AND severity = 'critical' THEN CAST(length(agent_name) AS DOUBLE) WHEN agent_name <> 'logic' AND severity = 'low' THEN 1.5 WHEN isnan(score_penalty) THEN -1.0 ELSE score_penalty END AS score_penalty FROM findings
