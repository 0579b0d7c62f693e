WITH g AS (SELECT project_id, path, 'cache' || CAST(file_seq AS VARCHAR) AS name, 'Map' AS kind, file_seq % 16 = 0 AS has_cleanup FROM files WHERE file_seq % 8 = 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY path) AS INT) AS n FROM g) WHERE n <= 15
