WITH w0 AS (SELECT project_id, file_seq, path, content, string_split(content, chr(10)) AS l, CAST(ceil(length(content) / 4.0) AS INT) AS tok FROM files),
w1 AS (SELECT *, CASE WHEN tok <= 1020 OR len(l) <= 20 THEN 1 ELSE 1 + CAST(ceil((len(l) - 20) / 15.0) AS INT) END AS nw FROM w0),
win AS (
  SELECT project_id, file_seq, path, CAST(i AS INT) AS part, CAST(15 * i + 1 AS INT) AS start_line,
    CAST(CASE WHEN tok <= 1020 THEN len(l) ELSE least(15 * i + 20, len(l)) END AS INT) AS end_line,
    CASE WHEN tok <= 1020 THEN content ELSE array_to_string(l[15 * i + 1 : 15 * i + 20], chr(10)) END AS content
  FROM w1, unnest(range(0, nw)) AS r(i)),
windows AS (SELECT *, path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS chunk_id, CAST(ceil(length(content) / 4.0) AS INT) AS token_count FROM win) , c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY part) AS rn, count(*) OVER (PARTITION BY path) AS n FROM windows)
SELECT chunk_id, rn = 2 AND n > 2 AS truncated, CAST(CASE WHEN rn = 2 AND n > 2 THEN n - 2 ELSE 0 END AS BIGINT) AS dropped FROM c WHERE rn <= 2
