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
,
ordered AS (
  SELECT component, f.*, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r
  FROM findings f JOIN comp USING (seq)),
folded AS (
  SELECT component, count(*) AS n_merged,
    list_reduce(list({'r': r, 's': seq, 'd': description} ORDER BY seq), lambda x, y:
      CASE WHEN x.r <= y.r THEN {'r': x.r, 's': x.s, 'd': CASE WHEN x.d = y.d THEN x.d ELSE x.d || chr(10) || chr(10) || 'Additional context: ' || y.d END}
           ELSE {'r': y.r, 's': y.s, 'd': CASE WHEN x.d = y.d THEN y.d ELSE y.d || chr(10) || chr(10) || 'Additional context: ' || x.d END} END) AS k,
    max(coalesce(score_penalty, 0)) AS p, max(score_penalty) AS ep, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents
  FROM ordered GROUP BY component),
merged AS (
  SELECT component, f.seq, project_id, agent_name, severity, title, k.d AS description, path, line_start, line_end,
    CASE WHEN n_merged = 1 THEN ep WHEN ep IS NOT NULL THEN p END AS score_penalty,
    CASE WHEN n_merged > 1 THEN agents END AS merged_from, n_merged, complexity
  FROM folded JOIN findings f ON f.seq = k.s)
,
words AS (SELECT DISTINCT title, description, lower(title || ' ' || description) AS t FROM merged),
-- the two word lists are fixed values
hits AS (
  SELECT title, description,
    len(list_filter(['add','throttle','encrypt','validate','lock','strict','check','boundary','limit','ensure','harden','guard','require','prevent','enforce','sanitize','escape','restrict','fail-safe','timeout','reject','deny','authenticate','authorize'], lambda w: regexp_matches(t, '\b' || w || '\b')))
    - len(list_filter(['remove','skip','fast-path','relax','bypass','inline','delete','cache','memoize','omit','drop','ignore','simplify','fast','assume','allow','permit','shortcut','optimize','lazy','defer','speed','permissive'], lambda w: regexp_matches(t, '\b' || w || '\b'))) AS d
  FROM words),
side AS (SELECT m.*, sign(d) AS sg, abs(d) AS mg FROM merged m JOIN hits USING (title, description) WHERE path IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL)
SELECT a.project_id, a.path, least(a.line_start, b.line_start) AS line_start, greatest(a.line_end, b.line_end) AS line_end,
  a.seq AS seq_a, b.seq AS seq_b, a.agent_name AS agent_name_a, b.agent_name AS agent_name_b,
  CASE WHEN a.sg * b.sg = -1 AND a.mg > 1 AND b.mg > 1 THEN 'high' ELSE 'low' END AS confidence
FROM side a JOIN side b ON a.project_id = b.project_id AND a.path = b.path AND a.seq < b.seq AND a.agent_name <> b.agent_name
  AND abs(a.line_start - b.line_start) <= 60
