WITH c AS (SELECT project_id, file_seq AS seq, path, content, path || ':1-' || CAST(len(string_split(content, chr(10))) AS VARCHAR) AS chunk_id, len(string_split(content, chr(10))) AS end_line,
  nullif(regexp_extract(content, '(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') AS sym FROM files),
w AS (SELECT project_id, chunk_id, seq, word, count(*) AS tf FROM (SELECT project_id, chunk_id, seq, unnest(regexp_extract_all(lower(content), '\b[a-z]{4,}\b')) AS word FROM c) GROUP BY ALL),
n AS (SELECT chunk_id, sum(tf) AS n FROM w GROUP BY chunk_id) , t AS (SELECT DISTINCT project_id, chunk_id, seq, lower(unnest(regexp_extract_all(content, '\b[A-Za-z_][A-Za-z0-9_]{3,}\b'))) AS term FROM c),
u AS (SELECT * FROM t WHERE term NOT IN ('async', 'await', 'class', 'const', 'export', 'from', 'function', 'import', 'interface', 'return', 'type')) SELECT c.seq, CAST(count(term) AS INT) AS n, md5(coalesce(string_agg(term, ' ' ORDER BY term), '')) AS digest FROM c LEFT JOIN u ON u.chunk_id = c.chunk_id GROUP BY c.seq
