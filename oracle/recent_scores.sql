SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, run_id DESC) AS position FROM history WHERE coalesce(kind, 'full') <> 'diff') WHERE position <= 10
