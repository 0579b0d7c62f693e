WITH l AS (SELECT file_seq, path, i, l[i] AS t FROM (SELECT *, string_split(diff, chr(10)) AS l FROM changed_files) f, unnest(range(1, len(l) + 1)) AS r(i)),
h AS (SELECT *, sum(CASE WHEN starts_with(t, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY file_seq ORDER BY i) AS seen FROM l)
SELECT file_seq, path, CAST(count(*) FILTER (starts_with(t, '+') AND NOT (seen = 0 AND starts_with(t, '+++'))) AS INT) AS additions,
  CAST(count(*) FILTER (starts_with(t, '-') AND NOT (seen = 0 AND starts_with(t, '---'))) AS INT) AS deletions FROM h GROUP BY file_seq, path
