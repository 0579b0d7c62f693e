WITH h AS (SELECT *, last_value(CASE WHEN coalesce(kind, 'full') <> 'diff' THEN score END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM history)
SELECT project_id, run_id, score, p AS previous_score, coalesce(score - p, 0) AS delta FROM h
