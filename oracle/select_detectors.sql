WITH b AS (SELECT DISTINCT agent_name AS name FROM findings)
SELECT name, TRUE AS builtin, position FROM (SELECT name, CAST(row_number() OVER (ORDER BY length(name), name) - 1 AS INT) AS position FROM b) WHERE position < 3
UNION ALL SELECT DISTINCT symbol_name, FALSE, 3 FROM findings WHERE symbol_name IS NOT NULL
