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
ann AS (SELECT project_id, path, line, type, value, type = 'ignore' AND fl AS file_level FROM found WHERE type IS NOT NULL) SELECT project_id, CASE WHEN type = 'ignore' AND file_level THEN 'ignored_file' WHEN type = 'ignore' THEN 'ignored_line' ELSE type END AS request, path, line, value FROM ann WHERE type = 'ignore' OR value <> ''
