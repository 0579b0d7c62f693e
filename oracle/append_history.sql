SELECT project_id, run_id, ts, score, kind FROM (SELECT *, row_number() OVER (PARTITION BY project_id, coalesce(kind, 'full') = 'diff' ORDER BY ts DESC, run_id DESC) AS rn FROM history) WHERE rn <= 50
