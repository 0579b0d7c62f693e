WITH hit AS (
  SELECT f.seq, c.chunk_seq, c.start_line, f.line_start, row_number() OVER (PARTITION BY f.seq ORDER BY c.chunk_seq) AS rn
  FROM findings f JOIN finding_chunks c ON lower(f.path) = lower(c.path) AND f.line_start BETWEEN c.start_line AND c.end_line)
SELECT f.seq, CAST(CASE WHEN h.line_start <= h.start_line + 40 THEN h.chunk_seq + 3 ELSE h.chunk_seq * 10 + 7 END AS INT) AS complexity
FROM findings f LEFT JOIN hit h ON f.seq = h.seq AND rn = 1
