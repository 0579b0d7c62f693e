WITH f AS (SELECT path FROM modules UNION ALL SELECT path FROM code_meta)
SELECT f.path, count(c.seq) AS churn_count FROM f LEFT JOIN changes c ON c.path = f.path GROUP BY f.path
