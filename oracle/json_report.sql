WITH s AS (SELECT project_id, symbol_name, min(seq) AS seq FROM findings WHERE path IS NOT NULL AND symbol_name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT agent_name) >= 2) SELECT project_id, 'bug' AS kind, seq, title, line_start AS line FROM findings UNION ALL SELECT project_id, 'issue', seq, 'Symbol "' || symbol_name || '" flagged across domains', NULL FROM s
