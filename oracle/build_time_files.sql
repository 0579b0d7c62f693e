WITH p AS (SELECT project_id, CASE WHEN file_seq % 9 = 0 THEN 'scripts/' || path WHEN file_seq % 10 = 0 THEN regexp_replace(path, '\.\w+$', '.config.ts') END AS path FROM files)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY path) AS INT) AS n FROM p WHERE path IS NOT NULL) WHERE n <= 20
