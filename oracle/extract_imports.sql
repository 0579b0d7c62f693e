WITH x AS (SELECT path, CASE WHEN regexp_matches(path, '\.(ts|js)$') THEN regexp_extract_all(content, '(?m)(?:^[ \t]*import\s+(?:[\w$*{}\s,]+?\s+from\s+)?|\brequire\(\s*)[''"]([^''"\n]+)[''"]', 1) ELSE regexp_extract_all(content, '(?:\bimport(?:[\s\S]*?from\s+)?|\brequire\()\s*[''"]([^''"]+)[''"]', 1) END AS s FROM files WHERE path NOT LIKE '%.txt'),
y AS (SELECT path, s[i] AS spec, min(i) AS p FROM x, unnest(range(1, len(s) + 1)) AS r(i) GROUP BY ALL) SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY p) - 1 AS INT) AS pos, spec FROM y
