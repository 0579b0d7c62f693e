WITH tagged AS (
  SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) AS tw,
    list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda w: w <> '')) AS dw
  FROM findings WHERE TRUE),
sims AS (
  SELECT a.seq AS a, b.seq AS b, a.agent_name = b.agent_name AS same, a.severity = b.severity AS same_sev, a.line_start AS la, b.line_start AS lb,
    CASE WHEN len(a.tw) = 0 OR len(b.tw) = 0 THEN 0.0 ELSE len(list_intersect(a.tw, b.tw)) / (len(a.tw) + len(b.tw) - len(list_intersect(a.tw, b.tw))) END AS ts,
    CASE WHEN len(a.dw) = 0 OR len(b.dw) = 0 THEN 0.0 ELSE len(list_intersect(a.dw, b.dw)) / (len(a.dw) + len(b.dw) - len(list_intersect(a.dw, b.dw))) END AS ds
  FROM tagged a JOIN tagged b ON a.project_id = b.project_id AND coalesce(a.path, '') = coalesce(b.path, '') AND a.seq < b.seq
    AND ((a.line_start IS NULL AND b.line_start IS NULL) OR abs(a.line_start - b.line_start) <= 60)),
links AS (
  SELECT a, b FROM sims WHERE
    (la IS NOT NULL AND (ts > CASE WHEN same THEN 0.5 ELSE 0.7 END OR (la = lb AND NOT same AND same_sev AND ts > 0.5)))
    OR (la IS NULL AND greatest(ts, ds) > CASE WHEN same THEN 0.5 ELSE 0.7 END)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT seq AS node, seq AS other FROM tagged UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT node AS seq, min(other) AS component FROM reach GROUP BY node)
SELECT seq, component FROM comp
