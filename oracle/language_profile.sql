WITH l AS (SELECT project_id, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' ELSE 'python' END AS lang FROM files
  WHERE path NOT LIKE '%.txt')
SELECT project_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, bool_or(lang IN ('typescript', 'javascript')) AS first_class FROM l GROUP BY project_id
