WITH f AS (SELECT path, file_seq, regexp_replace(path, '/[^/]*$', '') AS d FROM files WHERE path LIKE '%.py')
SELECT path, '..d1.f' || CAST(file_seq AS VARCHAR) AS spec, 'src/d1/f' || CAST(file_seq AS VARCHAR) AS target FROM f
UNION ALL SELECT path, '.a', d || '/a' FROM f UNION ALL SELECT path, '.b', d || '/b' FROM f
