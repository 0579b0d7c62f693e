WITH w0 AS (SELECT file_seq, path, content, string_split(content, chr(10)) AS l, CASE WHEN file_seq % 2 = 0 THEN repeat('context line' || chr(10), 120) ELSE '' END AS pre FROM files),
w1 AS (SELECT *, CAST(ceil(length(pre || content) / 4.0) AS INT) AS tok, len(l) AS n FROM w0),
cum AS (SELECT file_seq, i, sum(length(l[i]) + 1) OVER (PARTITION BY file_seq ORDER BY i) AS c, length(pre) AS pl FROM w1, unnest(range(1, least(20, n) + 1)) AS r(i)),
fit AS (SELECT file_seq, count(*) FILTER (c <= 4080 - pl) AS k FROM cum GROUP BY file_seq),
w2 AS (SELECT w1.*, CASE WHEN length(pre) > 0 THEN greatest(1, k) ELSE least(20, n) END AS e0 FROM w1 JOIN fit USING (file_seq)),
w3 AS (SELECT *, CASE WHEN e0 > 5 THEN e0 - 5 ELSE e0 END AS s1 FROM w2),
parts AS (
  SELECT file_seq, path, 0 AS part, pre, 0 AS s, CASE WHEN tok <= 1020 THEN n ELSE e0 END AS e, l FROM w3
  UNION ALL
  SELECT file_seq, path, i + 1, '', s1 + 15 * i, least(s1 + 15 * i + 20, n), l FROM w3, unnest(range(0, 1 + CAST(ceil(greatest(0, n - (s1 + 20)) / 15.0) AS INT))) AS r(i) WHERE tok > 1020 AND e0 < n)
SELECT path || ':' || CAST(s + 1 AS VARCHAR) || '-' || CAST(e AS VARCHAR) AS chunk_id, file_seq, CAST(part AS INT) AS part, CAST(s + 1 AS INT) AS start_line, CAST(e AS INT) AS end_line,
  CAST(ceil(length(pre || array_to_string(l[s + 1 : e], chr(10))) / 4.0) AS INT) AS token_count, md5(array_to_string(l[s + 1 : e], chr(10))) AS digest FROM parts
