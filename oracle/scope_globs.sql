SELECT file_seq, path FROM files WHERE regexp_matches(path, '^src/d2/.*$') OR regexp_matches(path, '^(?:.*/)?f1[^/]\.ts$') OR path LIKE '%.py'
  OR starts_with(path, 'd9/') OR path LIKE '%/d9/%' OR path = 'f100.ts' OR path LIKE '%/f100.ts' OR path LIKE 'f100.ts/%' OR path LIKE '%/f100.ts/%'
