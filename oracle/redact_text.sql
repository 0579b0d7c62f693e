SELECT doc_id, CAST(len(regexp_extract_all(text, '\b[A-Za-z0-9_.-]{20,}\b')) AS INT) AS hits,
  md5(regexp_replace(text, '\b([A-Za-z0-9_.-]{4})[A-Za-z0-9_.-]{12,}([A-Za-z0-9_.-]{4})\b', '\1...\2', 'g')) AS digest FROM documents
