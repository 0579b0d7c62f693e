SELECT role, seq % 3 AS shift, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, count(DISTINCT provider) > 1 AS degraded FROM call_log GROUP BY ALL
