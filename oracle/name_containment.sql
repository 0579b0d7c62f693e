WITH c AS (SELECT project_id, file_seq AS seq, path, content, path || ':1-' || CAST(len(string_split(content, chr(10))) AS VARCHAR) AS chunk_id, len(string_split(content, chr(10))) AS end_line,
  nullif(regexp_extract(content, '(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') AS sym FROM files),
w AS (SELECT project_id, chunk_id, seq, word, count(*) AS tf FROM (SELECT project_id, chunk_id, seq, unnest(regexp_extract_all(lower(content), '\b[a-z]{4,}\b')) AS word FROM c) GROUP BY ALL),
n AS (SELECT chunk_id, sum(tf) AS n FROM w GROUP BY chunk_id) SELECT a.project_id, regexp_extract(a.path, '/(f\d+)\.\w+$', 1) AS needle, b.chunk_id FROM c a JOIN c b ON a.project_id = b.project_id AND contains(b.content, regexp_extract(a.path, '/(f\d+)\.\w+$', 1))
