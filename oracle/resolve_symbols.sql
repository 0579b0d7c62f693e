WITH l AS (
  SELECT path, 'sym' || CAST(file_seq % 40 AS VARCHAR) AS name, i, l[i] AS t, l
  FROM (SELECT *, string_split(content, chr(10)) AS l FROM files) f, unnest(range(1, len(l) + 1)) AS r(i)),
s AS (SELECT path, name, min(i) AS s FROM l WHERE regexp_matches(t, '(?:function|def)\s+' || name || '\s*\(|class\s+' || name || '(?:\s|\s*[:(])|const\s+' || name || '\s*=\s*(?:async\s+)?\(') GROUP BY ALL),
e AS (
  SELECT s.path, s.name, s.s, min(b.i) AS c FROM s JOIN l a ON a.path = s.path AND a.i = s.s LEFT JOIN l b ON b.path = s.path AND b.i > s.s AND regexp_replace(b.t, '\s+', '', 'g') <> ''
    AND length(regexp_extract(b.t, '^(\s*)', 1)) <= length(regexp_extract(a.t, '^(\s*)', 1)) GROUP BY ALL),
o AS (SELECT e.path, e.name, CAST(s AS INT) AS s, CAST(coalesce(c - 1, len(l.l)) AS INT) AS e, l.l FROM e JOIN l ON l.path = e.path AND l.i = 1)
SELECT path || ':' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) AS chunk_id, name AS symbol_name, s AS start_line, e AS end_line,
  CAST(ceil(length(array_to_string(l[s : e], chr(10))) / 4.0) AS INT) AS token_count, md5(array_to_string(l[s : e], chr(10))) AS digest FROM o
