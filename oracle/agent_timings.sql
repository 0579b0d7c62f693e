WITH t AS (SELECT role, provider, round(sum(duration_ms), 3) AS duration_ms FROM call_log GROUP BY ALL)
SELECT role, provider, duration_ms, row_number() OVER (PARTITION BY role ORDER BY duration_ms DESC, provider) AS rank, round(duration_ms / max(duration_ms) OVER (PARTITION BY role), 6) AS share FROM t
