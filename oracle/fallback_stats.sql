SELECT role, count(*) AS total, count(*) FILTER (used_fallback) AS fallbacks FROM call_log GROUP BY role
