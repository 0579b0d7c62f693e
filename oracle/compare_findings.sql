WITH paths AS (SELECT DISTINCT project_id, path FROM changed_files),
h AS (SELECT f.*, coalesce(line_start, 0) AS ln, substring(title, 1, 40) AS t, row_number() OVER (PARTITION BY project_id, path, coalesce(line_start, 0), substring(title, 1, 40) ORDER BY seq) AS n
  FROM head_findings f SEMI JOIN paths USING (project_id, path)),
b AS (SELECT f.*, coalesce(line_start, 0) AS ln, substring(title, 1, 40) AS t, row_number() OVER (PARTITION BY project_id, path, coalesce(line_start, 0), substring(title, 1, 40) ORDER BY seq) AS n
  FROM base_findings f SEMI JOIN paths USING (project_id, path)),
hl AS (SELECT * FROM h ANTI JOIN b USING (project_id, path, ln, t, n)),
bl AS (SELECT * FROM b ANTI JOIN h USING (project_id, path, ln, t, n)),
cand AS (SELECT h.project_id, h.path, h.t, h.seq AS hs, b.seq AS bs, row_number() OVER (PARTITION BY h.project_id, h.path, h.t ORDER BY abs(h.ln - b.ln), h.seq, b.seq) AS k
  FROM hl h JOIN bl b ON h.project_id = b.project_id AND h.path = b.path AND h.t = b.t AND abs(h.ln - b.ln) <= 10),
walk AS (
  SELECT project_id, path, t, k, [hs] AS hm, [bs] AS bm FROM cand WHERE k = 1
  UNION ALL
  SELECT c.project_id, c.path, c.t, c.k, CASE WHEN list_contains(w.hm, c.hs) OR list_contains(w.bm, c.bs) THEN w.hm ELSE list_append(w.hm, c.hs) END,
    CASE WHEN list_contains(w.hm, c.hs) OR list_contains(w.bm, c.bs) THEN w.bm ELSE list_append(w.bm, c.bs) END
  FROM walk w JOIN cand c ON c.project_id = w.project_id AND c.path = w.path AND c.t = w.t AND c.k = w.k + 1),
fin AS (SELECT hm, bm FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path, t ORDER BY k DESC) AS r FROM walk) WHERE r = 1),
mh AS (SELECT unnest(hm) AS seq FROM fin), mb AS (SELECT unnest(bm) AS seq FROM fin),
compared AS (
  SELECT 'introduced' AS bucket, seq, project_id, severity, path, line_start, title FROM hl WHERE seq NOT IN (SELECT seq FROM mh)
  UNION ALL SELECT 'unchanged', seq, project_id, severity, path, line_start, title FROM h WHERE seq NOT IN (SELECT seq FROM hl WHERE seq NOT IN (SELECT seq FROM mh))
  UNION ALL SELECT 'resolved', seq, project_id, severity, path, line_start, title FROM bl WHERE seq NOT IN (SELECT seq FROM mb))
SELECT bucket, seq, path, line_start, title FROM compared
