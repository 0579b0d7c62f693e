WITH lines AS (
  SELECT project_id, path, i AS line, path LIKE '%.py' AS hashed, regexp_replace(l[i], '''(?:[^''\\]|\\.)*''|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`', '', 'g') AS t
  FROM (SELECT *, string_split(content, chr(10)) AS l FROM files WHERE path NOT LIKE '%.txt') f, unnest(range(1, len(l) + 1)) AS r(i)),
marks AS (
  SELECT project_id, path, line, hashed, CASE WHEN hashed THEN '#' ELSE '(?://|/\*+|^\s*\*)' END AS pre, CASE WHEN hashed THEN '$' ELSE '(?:\*/)?\s*$' END AS post, t
  FROM lines WHERE contains(lower(t), '@rv')),
found AS (
  SELECT project_id, path, CAST(line AS INT) AS line,
    CASE WHEN regexp_matches(t, '(?i)' || pre || '\s*@rv\s+review\s*:\s*(.+?)' || post) THEN 'review'
         WHEN regexp_matches(t, '(?i)' || pre || '\s*@rv\s+focus\s*:\s*(.+?)' || post) THEN 'focus'
         WHEN regexp_matches(t, '(?i)' || pre || '\s*@rv\s+ignore\b') THEN 'ignore' END AS type,
    CASE WHEN regexp_matches(t, '(?i)' || pre || '\s*@rv\s+review\s*:\s*(.+?)' || post) THEN trim(regexp_extract(t, '(?i)' || pre || '\s*@rv\s+review\s*:\s*(.+?)' || post, 1))
         WHEN regexp_matches(t, '(?i)' || pre || '\s*@rv\s+focus\s*:\s*(.+?)' || post) THEN trim(regexp_extract(t, '(?i)' || pre || '\s*@rv\s+focus\s*:\s*(.+?)' || post, 1)) END AS value,
    regexp_matches(t, '(?i)' || pre || '\s*@rv\s+ignore-file\b') AS fl
  FROM marks),
ann AS (SELECT project_id, path, line, type, value, type = 'ignore' AND fl AS file_level FROM found WHERE type IS NOT NULL)
, w0 AS (SELECT project_id, file_seq, path, content, string_split(content, chr(10)) AS l, CAST(ceil(length(content) / 4.0) AS INT) AS tok FROM files),
w1 AS (SELECT *, CASE WHEN tok <= 1020 OR len(l) <= 20 THEN 1 ELSE 1 + CAST(ceil((len(l) - 20) / 15.0) AS INT) END AS nw FROM w0),
win AS (
  SELECT project_id, file_seq, path, CAST(i AS INT) AS part, CAST(15 * i + 1 AS INT) AS start_line,
    CAST(CASE WHEN tok <= 1020 THEN len(l) ELSE least(15 * i + 20, len(l)) END AS INT) AS end_line,
    CASE WHEN tok <= 1020 THEN content ELSE array_to_string(l[15 * i + 1 : 15 * i + 20], chr(10)) END AS content
  FROM w1, unnest(range(0, nw)) AS r(i)),
windows AS (SELECT *, path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) AS chunk_id, CAST(ceil(length(content) / 4.0) AS INT) AS token_count FROM win)
SELECT chunk_id, path FROM windows w WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.path = w.path AND a.file_level)
