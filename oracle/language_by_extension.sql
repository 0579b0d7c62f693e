SELECT file_seq, path, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' END AS language FROM files WHERE path NOT LIKE '%.txt'
