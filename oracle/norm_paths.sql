WITH raw AS (
  SELECT seq, path_raw, '../x/./' || path_raw || CASE WHEN seq % 3 = 0 THEN '\..\b.ts' ELSE '' END AS messy_raw FROM findings_raw),
long AS (SELECT seq, 'p' AS w, path_raw AS p FROM raw UNION ALL SELECT seq, 'm', messy_raw FROM raw),
folded AS (
  SELECT seq, w, CASE WHEN p IS NOT NULL THEN list_reduce(list_prepend('', string_split(replace(trim(p), '\', '/'), '/')), lambda acc, x:
    CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '')
         WHEN acc = '' THEN x ELSE acc || '/' || x END) END AS p FROM long)
SELECT a.seq, a.p AS path, lower(a.p) AS key, b.p AS messy
FROM folded a JOIN folded b ON a.seq = b.seq AND a.w = 'p' AND b.w = 'm'
