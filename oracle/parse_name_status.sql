SELECT file_seq, path, CASE WHEN file_seq % 6 < 2 THEN 'old/' || path END AS old_path, CASE file_seq % 6 WHEN 2 THEN 'added' WHEN 4 THEN 'deleted' ELSE 'modified' END AS status FROM code_meta
