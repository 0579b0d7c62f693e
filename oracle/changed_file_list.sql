WITH q AS (SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS i, count(*) OVER (PARTITION BY project_id) AS total FROM (SELECT DISTINCT project_id, path FROM changed_files))
SELECT project_id, total, string_agg(path, ', ' ORDER BY i) || CASE WHEN total > 10 THEN chr(10) || '  ...and ' || CAST(total - 10 AS VARCHAR) || ' more (truncated)' ELSE '' END AS listing FROM q WHERE i <= 10 GROUP BY project_id, total
