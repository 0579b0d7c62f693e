WITH h AS (SELECT *, row_number() OVER (PARTITION BY project_id, path, coalesce(line_start, 0), substring(title, 1, 40) ORDER BY seq) AS n FROM head_findings WHERE path IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id, path, coalesce(line_start, 0), substring(title, 1, 40) ORDER BY seq) AS n FROM base_findings WHERE path IS NOT NULL)
SELECT h.seq, b.seq AS base_seq FROM h JOIN b ON h.project_id = b.project_id AND h.path = b.path AND coalesce(h.line_start, 0) = coalesce(b.line_start, 0)
  AND substring(h.title, 1, 40) = substring(b.title, 1, 40) AND h.n = b.n
