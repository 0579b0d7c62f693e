WITH e AS (SELECT DISTINCT importer AS a, importee AS b FROM edges),
-- the 40 shortest are found well below this many steps
walk AS (
  SELECT a AS s, b AS l, [a] AS p FROM e WHERE b >= a
  UNION ALL SELECT w.s, e.b, list_append(w.p, w.l) FROM walk w JOIN e ON e.a = w.l WHERE w.l > w.s AND e.b >= w.s AND len(w.p) < 14 AND NOT list_contains(w.p, w.l)),
c AS (SELECT array_to_string(p, '>') AS cycle, CAST(len(p) AS INT) AS length FROM walk WHERE l = s)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY length, cycle) AS INT) AS n FROM c) WHERE n <= 40
