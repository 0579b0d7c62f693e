WITH cand AS (
  SELECT c.seq, d.id, d.category, row_number() OVER (PARTITION BY c.seq ORDER BY abs(c.line_start - d.line_start), CASE WHEN d.category = 'real-bug' THEN 0 ELSE 1 END, d.seq) AS k
  FROM claims c JOIN defects d ON (ends_with(c.file, d.file) OR ends_with(d.file, c.file)) AND abs(c.line_start - d.line_start) <= 10),
m AS (SELECT c.seq, c.agent_name, k.id AS defect_id, k.category, CASE WHEN k.category = 'real-bug' THEN 'tp' ELSE 'fp' END AS outcome FROM claims c LEFT JOIN cand k ON c.seq = k.seq AND k.k = 1) SELECT * FROM m
