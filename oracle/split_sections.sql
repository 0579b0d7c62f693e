WITH d AS (
  SELECT doc_id, 'intro' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '## ARCHITECTURE.md' || chr(10) || 'ARCHITECTURE' ELSE '' END || text
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '## DATA_FLOWS.md' || chr(10) || 'DATA_FLOWS' ELSE '' END || lang
    || CASE WHEN doc_id % 5 <> 0 THEN chr(10) || '## DANGER_ZONES.md' || chr(10) || 'DANGER_ZONES' ELSE '' END || text
    || CASE WHEN doc_id % 7 < 3 THEN chr(10) || '## GOTCHAS.md' || chr(10) || 'GOTCHAS' ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, t, k, ['## ARCHITECTURE.md', '## DATA_FLOWS.md', '## DANGER_ZONES.md', '## GOTCHAS.md'][k] AS marker FROM d, unnest(range(1, 5)) AS r(k)),
p AS (SELECT *, instr(t, marker) AS s FROM m WHERE instr(t, marker) > 0)
SELECT a.doc_id, a.marker, md5(regexp_replace(substring(a.t, a.s, coalesce((SELECT min(b.s) FROM p b WHERE b.doc_id = a.doc_id AND b.k > a.k), length(a.t) + 1) - a.s), '^\s+|\s+$', '', 'g')) AS digest FROM p a
