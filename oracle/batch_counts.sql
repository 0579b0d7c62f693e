WITH w0 AS (SELECT project_id, file_seq, path, content, string_split(content, chr(10)) AS l, CAST(ceil(length(content) / 4.0) AS INT) AS tok FROM files),
w1 AS (SELECT *, CASE WHEN tok <= 1020 OR len(l) <= 20 THEN 1 ELSE 1 + CAST(ceil((len(l) - 20) / 15.0) AS INT) END AS nw FROM w0),
win AS (
  SELECT project_id, file_seq, path, CAST(i AS INT) AS part, CAST(15 * i + 1 AS INT) AS start_line,
    CAST(CASE WHEN tok <= 1020 THEN len(l) ELSE least(15 * i + 20, len(l)) END AS INT) AS end_line,
    CASE WHEN tok <= 1020 THEN content ELSE array_to_string(l[15 * i + 1 : 15 * i + 20], chr(10)) END AS content
  FROM w1, unnest(range(0, nw)) AS r(i)),
windows AS (SELECT *, path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS chunk_id, CAST(ceil(length(content) / 4.0) AS INT) AS token_count FROM win)
, o AS (SELECT project_id, chunk_id, part, path, content, token_count AS w, row_number() OVER (PARTITION BY project_id ORDER BY file_seq, part) AS i FROM windows),
walk AS (
  SELECT project_id, i, CAST(w AS BIGINT) AS carry, CAST(0 AS BIGINT) AS batch_no FROM o WHERE i = 1
  UNION ALL
  SELECT o.project_id, o.i, CASE WHEN k.carry + o.w > 6000 THEN o.w ELSE k.carry + o.w END, CASE WHEN k.carry + o.w > 6000 THEN k.batch_no + 1 ELSE k.batch_no END
  FROM walk k JOIN o ON o.project_id = k.project_id AND o.i = k.i + 1)
SELECT project_id, max(batch_no) + 1 AS batches FROM walk GROUP BY project_id
