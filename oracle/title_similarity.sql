WITH t AS (
  SELECT DISTINCT project_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> ''))) AS s FROM findings),
p AS (
  SELECT a.project_id, array_to_string(a.s, ' ') AS a, array_to_string(b.s, ' ') AS b,
    len(list_intersect(a.s, b.s)) AS o, len(a.s) AS na, len(b.s) AS nb
  FROM t a JOIN t b ON a.project_id = b.project_id AND array_to_string(a.s, ' ') < array_to_string(b.s, ' '))
SELECT project_id, a, b, round(o / (na + nb - o), 6) AS sim FROM p WHERE na > 0 AND nb > 0 AND o / (na + nb - o) > 0.5
