WITH r AS (SELECT * FROM history WHERE coalesce(kind, 'full') <> 'diff'), c AS (SELECT project_id, run_id, ts - INTERVAL 1 HOUR AS cut_ts FROM history WHERE kind = 'diff')
SELECT c.project_id, c.run_id AS cut_id, c.cut_ts, (SELECT max_by(r.score, (r.ts, r.run_id)) FROM r WHERE r.project_id = c.project_id AND r.ts <= c.cut_ts) AS base_score FROM c
