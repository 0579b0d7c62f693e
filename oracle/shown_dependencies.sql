WITH t AS (
  SELECT path AS seed, path, 0 AS depth FROM code_meta
  UNION SELECT t.seed, e.importee, t.depth + 1 FROM t JOIN edges e ON e.importer = t.path WHERE t.depth < 3),
m AS (SELECT seed, path, CAST(min(depth) AS INT) AS depth FROM t WHERE depth > 0 GROUP BY seed, path)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY depth, path) AS INT) AS n FROM m) WHERE n <= 2
