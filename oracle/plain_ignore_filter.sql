SELECT file_seq, path FROM files WHERE NOT (starts_with(path, 'src/d3/') OR path LIKE '%.py' OR regexp_matches(path, '(^|/)f1[^/]\.ts$'))
