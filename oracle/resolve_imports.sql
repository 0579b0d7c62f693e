WITH x AS (SELECT path, CASE WHEN regexp_matches(path, '\.(ts|js)$') THEN regexp_extract_all(content, '(?m)(?:^[ \t]*import\s+(?:[\w$*{}\s,]+?\s+from\s+)?|\brequire\(\s*)[''"]([^''"\n]+)[''"]', 1) ELSE regexp_extract_all(content, '(?:\bimport(?:[\s\S]*?from\s+)?|\brequire\()\s*[''"]([^''"]+)[''"]', 1) END AS s FROM files WHERE path NOT LIKE '%.txt'),
y AS (SELECT path, s[i] AS spec, min(i) AS p FROM x, unnest(range(1, len(s) + 1)) AS r(i) GROUP BY ALL),
t AS (SELECT path, spec, 'src/' || regexp_replace(spec, '^\.\./', '') AS r FROM y WHERE starts_with(spec, '../d')),
c AS (SELECT t.path, t.spec, f.path AS target, CASE WHEN f.path = r THEN 0 WHEN f.path = r || '.ts' THEN 1 WHEN f.path = r || '.js' THEN 5 ELSE 20 END AS k
  FROM t JOIN files f ON f.path NOT LIKE '%.txt' AND f.path IN (r, r || '.ts', r || '.js', regexp_replace(r, '\.js$', '') || '.ts'))
SELECT path, spec, min_by(target, k) AS target FROM c GROUP BY path, spec
