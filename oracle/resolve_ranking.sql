WITH  r AS (
  SELECT project_id, CAST((file_seq * 7919) % 10007 AS DOUBLE) AS rank, CASE file_seq % 4 WHEN 0 THEN './' || path WHEN 1 THEN regexp_replace(path, '^src/d[0-9]+/', '') WHEN 2 THEN upper(path) ELSE 'nowhere.ts' END AS name
  FROM code_meta),
k AS (SELECT DISTINCT project_id, name, regexp_replace(regexp_replace(trim(name), '^\.?/+', ''), '/+$', '') AS k FROM r),
hit AS (
  SELECT k.project_id, k.name, 1 AS tier, f.path FROM k JOIN files f ON f.project_id = k.project_id AND f.path = k.k
  UNION ALL SELECT k.project_id, k.name, 2, f.path FROM k JOIN files f ON f.project_id = k.project_id AND ends_with(f.path, '/' || k.k)
  UNION ALL SELECT k.project_id, k.name, 3, f.path FROM k JOIN files f ON f.project_id = k.project_id AND lower(f.path) = lower(k.k)),
one AS (SELECT project_id, name, tier, min(path) AS path FROM hit GROUP BY ALL HAVING tier = 1 OR min(path) = max(path)),
res AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY project_id, name ORDER BY tier) = 1),
ranked AS (SELECT r.project_id, r.rank, r.name, res.path, res.tier FROM r JOIN res USING (project_id, name)) SELECT * FROM ranked
