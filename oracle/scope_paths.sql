SELECT file_seq, path FROM files f WHERE regexp_matches(path, '^src/d(1|7|8)/') AND EXISTS (
  SELECT 1 FROM code_meta c WHERE c.file_seq % 50 = 7 AND (f.path = regexp_replace(c.path, '/[^/]*$', '') OR starts_with(f.path, regexp_replace(c.path, '/[^/]*$', '') || '/')))
