WITH w0 AS (SELECT project_id, file_seq, path, content, string_split(content, chr(10)) AS l, CAST(ceil(length(content) / 4.0) AS INT) AS tok FROM files),
w1 AS (SELECT *, CASE WHEN tok <= 1020 OR len(l) <= 20 THEN 1 ELSE 1 + CAST(ceil((len(l) - 20) / 15.0) AS INT) END AS nw FROM w0),
win AS (
  SELECT project_id, file_seq, path, CAST(i AS INT) AS part, CAST(15 * i + 1 AS INT) AS start_line,
    CAST(CASE WHEN tok <= 1020 THEN len(l) ELSE least(15 * i + 20, len(l)) END AS INT) AS end_line,
    CASE WHEN tok <= 1020 THEN content ELSE array_to_string(l[15 * i + 1 : 15 * i + 20], chr(10)) END AS content
  FROM w1, unnest(range(0, nw)) AS r(i)),
windows AS (SELECT *, path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS chunk_id, CAST(ceil(length(content) / 4.0) AS INT) AS token_count FROM win)
,  r AS (
  SELECT project_id, CAST((file_seq * 7919) % 10007 AS DOUBLE) AS rank, CASE file_seq % 4 WHEN 0 THEN './' || path WHEN 1 THEN regexp_replace(path, '^src/d[0-9]+/', '') WHEN 2 THEN upper(path) ELSE 'nowhere.ts' END AS name
  FROM code_meta),
k AS (SELECT DISTINCT project_id, name, regexp_replace(regexp_replace(trim(name), '^\.?/+', ''), '/+$', '') AS k FROM r),
hit AS (
  SELECT k.project_id, k.name, 1 AS tier, f.path FROM k JOIN files f ON f.project_id = k.project_id AND f.path = k.k
  UNION ALL SELECT k.project_id, k.name, 2, f.path FROM k JOIN files f ON f.project_id = k.project_id AND ends_with(f.path, '/' || k.k)
  UNION ALL SELECT k.project_id, k.name, 3, f.path FROM k JOIN files f ON f.project_id = k.project_id AND lower(f.path) = lower(k.k)),
one AS (SELECT project_id, name, tier, min(path) AS path FROM hit GROUP BY ALL HAVING tier = 1 OR min(path) = max(path)),
res AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY project_id, name ORDER BY tier) = 1),
ranked AS (SELECT r.project_id, r.rank, r.name, res.path, res.tier FROM r JOIN res USING (project_id, name))
, fr AS (SELECT project_id, path, min(rank) AS rank FROM ranked GROUP BY ALL),
o AS (SELECT w.project_id, w.path, w.part, w.token_count AS s, row_number() OVER (PARTITION BY w.project_id ORDER BY fr.rank, w.path, w.part) AS i FROM windows w JOIN fr USING (project_id, path)),
walk AS (
  SELECT project_id, i, s <= 40000 AS taken, CASE WHEN s <= 40000 THEN CAST(s AS BIGINT) ELSE 0 END AS spent FROM o WHERE i = 1
  UNION ALL
  SELECT o.project_id, o.i, k.spent + o.s <= 40000, CASE WHEN k.spent + o.s <= 40000 THEN k.spent + o.s ELSE k.spent END FROM walk k JOIN o ON o.project_id = k.project_id AND o.i = k.i + 1),
p1 AS (SELECT project_id, path, part, s, spent FROM o JOIN walk USING (project_id, i) WHERE taken),
ex AS (SELECT DISTINCT c.project_id, e.importee AS path FROM edges e JOIN code_meta c ON c.path = e.importer JOIN p1 ON p1.project_id = c.project_id AND p1.path = e.importer),
o2 AS (SELECT w.project_id, w.path, w.part, w.token_count AS s, row_number() OVER (PARTITION BY w.project_id ORDER BY w.path, w.part) AS i FROM windows w SEMI JOIN ex USING (project_id, path) ANTI JOIN p1 USING (project_id, path)),
u AS (SELECT project_id, max(spent) AS u FROM p1 GROUP BY ALL),
walk2 AS (
  SELECT project_id, CAST(0 AS BIGINT) AS i, FALSE AS taken, u AS spent FROM u
  UNION ALL
  SELECT o2.project_id, o2.i, k.spent + o2.s <= 40000, CASE WHEN k.spent + o2.s <= 40000 THEN k.spent + o2.s ELSE k.spent END FROM walk2 k JOIN o2 ON o2.project_id = k.project_id AND o2.i = k.i + 1)
SELECT project_id, path, 0 AS chunk_seq, part AS piece, CAST(s AS BIGINT) AS size, spent, 1 AS phase FROM p1
UNION ALL SELECT project_id, path, 0, part, CAST(s AS BIGINT), spent, 2 FROM o2 JOIN walk2 USING (project_id, i) WHERE taken
