SELECT file_seq, CAST(i AS INT) AS rank, [path, 'x/y.ts', 'z' || CAST(file_seq AS VARCHAR) || '.ts'][i + 1] AS name FROM code_meta, unnest(range(0, CASE file_seq % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 3 END)) AS r(i)
