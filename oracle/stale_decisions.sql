WITH d AS (SELECT slug, epoch(TIMESTAMP '2024-02-14 12:00:00' - CAST(CAST(regexp_extract(doc, '\*\*Date:\*\* (\S+)', 1) AS DATE) AS TIMESTAMP)) / 86400.0 AS a FROM decisions)
SELECT slug, CAST(floor(a) AS INT) AS age_days FROM d WHERE a > 30
