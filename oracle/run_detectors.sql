WITH l AS (SELECT path, i, l[i] AS t FROM (SELECT *, string_split(content, chr(10)) AS l FROM files WHERE path NOT LIKE '%.txt') f, unnest(range(1, len(l) + 1)) AS r(i)),
h AS (
  SELECT path, i, t, 'todo' AS agent_name, 'low' AS severity, CAST(NULL AS DOUBLE) AS p FROM l WHERE regexp_matches(t, 'TODO|FIXME')
  UNION ALL SELECT path, i, t, 'mapGlobals', 'medium', 3.0 FROM l WHERE regexp_matches(t, 'new Map\(\)')
  UNION ALL SELECT path, i, t, 'longLine', 'info', NULL FROM l WHERE length(t) > 300)
SELECT path, CAST(i AS INT) AS line_start, agent_name, severity, p AS score_penalty, CAST(length(t) AS INT) AS n_chars FROM h
