WITH w0 AS (SELECT project_id, file_seq, path, content, string_split(content, chr(10)) AS l, CAST(ceil(length(content) / 4.0) AS INT) AS tok FROM files),
w1 AS (SELECT *, CASE WHEN tok <= 1020 OR len(l) <= 20 THEN 1 ELSE 1 + CAST(ceil((len(l) - 20) / 15.0) AS INT) END AS nw FROM w0),
win AS (
  SELECT project_id, file_seq, path, CAST(i AS INT) AS part, CAST(15 * i + 1 AS INT) AS start_line,
    CAST(CASE WHEN tok <= 1020 THEN len(l) ELSE least(15 * i + 20, len(l)) END AS INT) AS end_line,
    CASE WHEN tok <= 1020 THEN content ELSE array_to_string(l[15 * i + 1 : 15 * i + 20], chr(10)) END AS content
  FROM w1, unnest(range(0, nw)) AS r(i)),
windows AS (SELECT *, path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS chunk_id, CAST(ceil(length(content) / 4.0) AS INT) AS token_count FROM win)
, o AS (SELECT w.project_id, w.path, w.part, w.token_count AS s, row_number() OVER (PARTITION BY w.project_id ORDER BY least(len(string_split(f.content, chr(10))) / 50, 5) DESC, w.path, w.part) AS i
  FROM windows w JOIN files f USING (file_seq)),
walk AS (
  SELECT project_id, i, s <= 40000 AS taken, CASE WHEN s <= 40000 THEN CAST(s AS BIGINT) ELSE 0 END AS spent FROM o WHERE i = 1
  UNION ALL
  SELECT o.project_id, o.i, k.spent + o.s <= 40000, CASE WHEN k.spent + o.s <= 40000 THEN k.spent + o.s ELSE k.spent END FROM walk k JOIN o ON o.project_id = k.project_id AND o.i = k.i + 1)
SELECT project_id, path, 0 AS chunk_seq, part AS piece, CAST(s AS BIGINT) AS size, spent FROM o JOIN walk USING (project_id, i) WHERE taken
