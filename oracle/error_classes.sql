SELECT provider, CASE WHEN seq % 11 IN (0, 1) THEN 'auth' WHEN seq % 11 IN (3, 4, 5) THEN 'quota' ELSE 'retryable' END AS error_class, count(*) AS n FROM call_log GROUP BY ALL
