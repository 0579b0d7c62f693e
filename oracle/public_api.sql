WITH ex AS (SELECT path, regexp_replace(content, 'import (\{ a \} from )?''', 'export * from ''', 'g') AS c FROM files),
sp AS (SELECT path, unnest(regexp_extract_all(c, 'export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+[''"]([^''"]+)[''"]', 1)) AS spec FROM ex),
t AS (SELECT path, spec, 'src/' || regexp_replace(spec, '^\.\./', '') AS r FROM sp WHERE starts_with(spec, '../d')),
c AS (SELECT t.path, t.spec, f.path AS target, CASE WHEN f.path = r THEN 0 WHEN f.path = r || '.ts' THEN 1 WHEN f.path = r || '.js' THEN 3 ELSE 20 END AS k
  FROM t JOIN files f ON f.path IN (r, r || '.ts', r || '.js', regexp_replace(r, '\.js$', '') || '.ts')),
l AS (SELECT path, min_by(target, k) AS nxt FROM c GROUP BY path, spec),
w AS (
  SELECT f.path, 0 AS depth FROM files f WHERE f.path IN (SELECT min(path) FROM code_meta WHERE path LIKE '%.ts' UNION SELECT max(path) FROM code_meta WHERE path LIKE '%.ts' UNION SELECT 'dist/d1/f1.js' UNION SELECT 'src/d1/f1.ts')
  UNION SELECT l.nxt, w.depth + 1 FROM w JOIN l ON l.path = w.path WHERE w.depth < 60),
m AS (SELECT path, CAST(min(depth) AS INT) AS depth FROM w GROUP BY path)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY depth, path) AS INT) AS n FROM m) WHERE n <= 60
