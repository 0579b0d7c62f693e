WITH f AS (SELECT *, min(score) OVER (PARTITION BY project_id) AS lo, max(score) OVER (PARTITION BY project_id) AS hi,
  row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, run_id DESC) AS age FROM history WHERE coalesce(kind, 'full') <> 'diff')
SELECT project_id, run_id, ts, score, age, CAST(floor(CAST(score - lo AS DOUBLE) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 7 + 0.5) AS INT) AS level FROM f WHERE age <= 20
