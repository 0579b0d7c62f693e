WITH tagged_l AS (
  SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) AS tw,
    list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda w: w <> '')) AS dw
  FROM findings WHERE path IS NOT NULL AND line_start IS NOT NULL),
sims_l AS (
  SELECT a.seq AS a, b.seq AS b, a.agent_name = b.agent_name AS same, a.severity = b.severity AS same_sev, a.line_start AS la, b.line_start AS lb,
    CASE WHEN len(a.tw) = 0 OR len(b.tw) = 0 THEN 0.0 ELSE len(list_intersect(a.tw, b.tw)) / (len(a.tw) + len(b.tw) - len(list_intersect(a.tw, b.tw))) END AS ts,
    CASE WHEN len(a.dw) = 0 OR len(b.dw) = 0 THEN 0.0 ELSE len(list_intersect(a.dw, b.dw)) / (len(a.dw) + len(b.dw) - len(list_intersect(a.dw, b.dw))) END AS ds
  FROM tagged_l a JOIN tagged_l b ON a.project_id = b.project_id AND coalesce(a.path, '') = coalesce(b.path, '') AND a.seq < b.seq
    AND ((a.line_start IS NULL AND b.line_start IS NULL) OR abs(a.line_start - b.line_start) <= 60)),
links_l AS (
  SELECT a, b FROM sims_l WHERE
    (la IS NOT NULL AND (ts > CASE WHEN same THEN 0.5 ELSE 0.7 END ))
    OR (la IS NULL AND greatest(ts, ds) > CASE WHEN same THEN 0.5 ELSE 0.7 END)),
both_ways_l AS (SELECT a, b FROM links_l UNION ALL SELECT b, a FROM links_l),
reach_l AS (SELECT seq AS node, seq AS other FROM tagged_l UNION SELECT r.node, e.b FROM reach_l r JOIN both_ways_l e ON r.other = e.a),
comp_l AS (SELECT node AS seq, min(other) AS component FROM reach_l GROUP BY node)
,
grp_l AS (SELECT component AS g, f.*, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM findings f JOIN comp_l USING (seq)),
agg_l AS (
  SELECT project_id, g, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(DISTINCT agent_name) AS na, min(r) AS r,
    min(line_start) AS lo, max(line_start) AS hi, min(seq) AS first_seq, any_value(path) AS path, count(DISTINCT path) AS nf,
    array_to_string(list(title ORDER BY r, seq)[1:3], '; ') AS description
  FROM grp_l GROUP BY project_id, g HAVING count(DISTINCT agent_name) >= 2)
,
tagged_f AS (
  SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> '')) AS tw,
    list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda w: w <> '')) AS dw
  FROM findings WHERE path IS NOT NULL AND line_start IS NULL),
sims_f AS (
  SELECT a.seq AS a, b.seq AS b, a.agent_name = b.agent_name AS same, a.severity = b.severity AS same_sev, a.line_start AS la, b.line_start AS lb,
    CASE WHEN len(a.tw) = 0 OR len(b.tw) = 0 THEN 0.0 ELSE len(list_intersect(a.tw, b.tw)) / (len(a.tw) + len(b.tw) - len(list_intersect(a.tw, b.tw))) END AS ts,
    CASE WHEN len(a.dw) = 0 OR len(b.dw) = 0 THEN 0.0 ELSE len(list_intersect(a.dw, b.dw)) / (len(a.dw) + len(b.dw) - len(list_intersect(a.dw, b.dw))) END AS ds
  FROM tagged_f a JOIN tagged_f b ON a.project_id = b.project_id AND coalesce(a.path, '') = coalesce(b.path, '') AND a.seq < b.seq
    AND ((a.line_start IS NULL AND b.line_start IS NULL) OR abs(a.line_start - b.line_start) <= 60)),
links_f AS (
  SELECT a, b FROM sims_f WHERE
    (la IS NOT NULL AND (ts > CASE WHEN same THEN 0.5 ELSE 0.7 END ))
    OR (la IS NULL AND greatest(ts, ds) > CASE WHEN same THEN 0.5 ELSE 0.7 END)),
both_ways_f AS (SELECT a, b FROM links_f UNION ALL SELECT b, a FROM links_f),
reach_f AS (SELECT seq AS node, seq AS other FROM tagged_f UNION SELECT r.node, e.b FROM reach_f r JOIN both_ways_f e ON r.other = e.a),
comp_f AS (SELECT node AS seq, min(other) AS component FROM reach_f GROUP BY node)
,
grp_f AS (SELECT component AS g, f.*, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM findings f JOIN comp_f USING (seq)),
agg_f AS (
  SELECT project_id, g, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(DISTINCT agent_name) AS na, min(r) AS r,
    min(line_start) AS lo, max(line_start) AS hi, min(seq) AS first_seq, any_value(path) AS path, count(DISTINCT path) AS nf,
    array_to_string(list(title ORDER BY r, seq)[1:3], '; ') AS description
  FROM grp_f GROUP BY project_id, g HAVING count(DISTINCT agent_name) >= 2)
,
grp_s AS (SELECT symbol_name AS g, f.*, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM findings f WHERE path IS NOT NULL AND symbol_name IS NOT NULL),
agg_s AS (
  SELECT project_id, g, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents, count(DISTINCT agent_name) AS na, min(r) AS r,
    min(line_start) AS lo, max(line_start) AS hi, min(seq) AS first_seq, any_value(path) AS path, count(DISTINCT path) AS nf,
    array_to_string(list(title ORDER BY r, seq)[1:3], '; ') AS description
  FROM grp_s GROUP BY project_id, g HAVING count(DISTINCT agent_name) >= 2)
,
clusters AS (SELECT project_id, 'lines' AS kind, 'Multi-domain issues near ' || path || ':' || CAST(lo AS VARCHAR) || CASE WHEN lo = hi THEN '' ELSE '-' || CAST(hi AS VARCHAR) END AS title,
  description, agents, path, CAST(NULL AS VARCHAR) AS symbol_name, CASE r WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, CAST(1 AS BIGINT) AS blast_radius, lo AS line_lo, hi AS line_hi, first_seq FROM agg_l),
numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, path, agents ORDER BY first_seq) AS i FROM clusters),
walk AS (
  SELECT project_id, path, agents, CAST(1 AS BIGINT) AS i, [{'lo': line_lo, 'hi': line_hi, 'id': first_seq}] AS kept FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.project_id, n.path, n.agents, n.i, CASE WHEN len(list_filter(w.kept, lambda k: k.lo <= n.line_hi AND n.line_lo <= k.hi)) > 0 THEN w.kept
     ELSE list_append(w.kept, {'lo': n.line_lo, 'hi': n.line_hi, 'id': n.first_seq}) END
  FROM walk w JOIN numbered n ON n.project_id = w.project_id AND n.path = w.path AND n.agents = w.agents AND n.i = w.i + 1),
final AS (SELECT kept, row_number() OVER (PARTITION BY project_id, path, agents ORDER BY i DESC) AS rn FROM walk),
ids AS (SELECT unnest(kept).id AS id FROM final WHERE rn = 1),
crossed AS (SELECT * FROM clusters WHERE first_seq IN (SELECT id FROM ids)
UNION ALL SELECT project_id, 'file' AS kind, 'Multi-domain issues in ' || path AS title,
  description, agents, path, CAST(NULL AS VARCHAR) AS symbol_name, CASE r WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, CAST(1 AS BIGINT) AS blast_radius, CAST(NULL AS INT) AS line_lo, CAST(NULL AS INT) AS line_hi, first_seq FROM agg_f
UNION ALL SELECT project_id, 'symbol' AS kind, 'Symbol "' || g || '" flagged across domains' AS title,
  description, agents, CAST(NULL AS VARCHAR) AS path, g AS symbol_name, CASE r WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity, nf AS blast_radius, CAST(NULL AS INT) AS line_lo, CAST(NULL AS INT) AS line_hi, first_seq FROM agg_s)
SELECT * FROM crossed
