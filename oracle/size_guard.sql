SELECT file_seq, CAST(strlen(content) AS BIGINT) AS size_bytes, strlen(content) > 4096 AS skipped FROM files
