WITH f AS (
  SELECT seq, path_raw,
    CASE WHEN path_raw IS NOT NULL THEN list_reduce(list_prepend('', string_split(path_raw, '/')), lambda acc, x:
      CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '')
           WHEN acc = '' THEN x ELSE acc || '/' || x END) END AS p,
    CAST(floor(line_start_raw + 0.5) AS INT) AS s, CAST(floor(CAST(line_end_raw AS DOUBLE) + 0.5) AS INT) AS e
  FROM findings_raw),
cand AS (
  SELECT f.seq, c.end_line, row_number() OVER (PARTITION BY f.seq ORDER BY
     CASE WHEN s IS NULL OR e IS NULL OR e <= c.end_line THEN 0 ELSE 1 END, c.chunk_seq) AS rn
  FROM f JOIN finding_chunks c ON lower(f.p) = lower(c.path) AND (s IS NULL OR (c.start_line <= s AND s <= c.end_line))),
known AS (SELECT DISTINCT lower(path) AS k FROM finding_chunks)
SELECT f.seq,
  CASE WHEN path_raw IS NULL THEN 'ok' WHEN k.k IS NULL THEN 'unknown_path' WHEN c.seq IS NULL THEN 'outside_chunks' ELSE 'ok' END AS status,
  p AS path, s AS line_start,
  CASE WHEN path_raw IS NULL OR e IS NULL OR s IS NULL THEN e WHEN e < s THEN s WHEN e > c.end_line THEN c.end_line ELSE e END AS line_end
FROM f LEFT JOIN cand c ON f.seq = c.seq AND rn = 1 LEFT JOIN known k ON lower(f.p) = k.k
