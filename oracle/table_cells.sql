WITH e AS (SELECT file_seq, replace(replace(replace(replace(content, '\', '\\'), '|', '\|'), '`', '\`'), chr(10), ' ') AS c FROM files)
SELECT file_seq, CASE WHEN length(c) <= 21 THEN c ELSE substring(c, 1, 20) || '…' END AS cell FROM e
