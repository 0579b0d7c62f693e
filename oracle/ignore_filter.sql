SELECT file_seq, path FROM files WHERE NOT (starts_with(path, 'src/d3/') OR (path LIKE '%.js' AND NOT path LIKE 'src/d4/%.js')
  OR regexp_matches(path, '^src/d5/f[^/]*5\.ts$') OR regexp_matches(path, '^src/(?:.*/)?f77\.ts$'))
