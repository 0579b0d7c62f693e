WITH f AS (
  SELECT *, coalesce(path, 'global') AS file, coalesce(symbol_name, 'file') AS sym, coalesce(CAST(line_start AS VARCHAR), 'file') AS ln,
    array_to_string(list_sort(list_distinct(['t' || CAST(seq % 3 AS VARCHAR), agent_name])), ',') AS tags FROM findings)
SELECT seq, agent_name || ':' || severity || ':' || file || ':' || sym || ':' || substring(sha1(
  agent_name || ':' || severity || ':' || file || ':' || sym || ':' || ln || ':' || tags || ':' || substring(lower(title), 1, 40)), 1, 12) AS fingerprint
FROM f
