SELECT run_id AS k, CAST(run_id AS VARCHAR) AS run_id, CAST(score AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS delta, kind, CAST(score AS DOUBLE) AS total,
  CASE run_id % 7 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS n_categories, CAST(CASE WHEN run_id % 7 = 2 THEN 0 ELSE 3 END AS DOUBLE) AS finding_count FROM history WHERE run_id % 7 NOT IN (1, 4)
