WITH words AS (SELECT DISTINCT title, description, lower(concat_ws(' ', title, description)) AS t FROM findings),
-- the two word lists are fixed values
hits AS (
  SELECT title, description,
    len(list_filter(['add','throttle','encrypt','validate','lock','strict','check','boundary','limit','ensure','harden','guard','require','prevent','enforce','sanitize','escape','restrict','fail-safe','timeout','reject','deny','authenticate','authorize'], lambda w: regexp_matches(t, '\b' || w || '\b')))
    - len(list_filter(['remove','skip','fast-path','relax','bypass','inline','delete','cache','memoize','omit','drop','ignore','simplify','fast','assume','allow','permit','shortcut','optimize','lazy','defer','speed','permissive'], lambda w: regexp_matches(t, '\b' || w || '\b'))) AS d
  FROM words)
SELECT seq, CAST(sign(d) AS INT) AS sign, CAST(abs(d) AS INT) AS margin FROM findings f JOIN hits h ON f.title IS NOT DISTINCT FROM h.title AND f.description IS NOT DISTINCT FROM h.description
