SELECT seq, path, line_start, line_end FROM findings f WHERE path IS NULL OR line_start IS NULL OR NOT EXISTS (
  SELECT 1 FROM findings m WHERE m.seq % 37 = 5 AND m.line_start IS NOT NULL AND m.path = f.path AND f.line_start <= m.line_start + 1 AND coalesce(f.line_end, f.line_start) >= m.line_start)
