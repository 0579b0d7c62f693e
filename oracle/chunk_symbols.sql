SELECT file_seq, nullif(regexp_extract(content, '(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1), '') AS symbol_name FROM files
