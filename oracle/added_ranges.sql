WITH l AS (SELECT project_id, file_seq, path, i, l[i] AS t FROM (SELECT *, string_split(diff, chr(10)) AS l FROM changed_files) f, unnest(range(4, len(l) + 1)) AS r(i)),
h AS (
  SELECT *, 1 + file_seq % 50 + coalesce(sum(CASE WHEN starts_with(t, '-') THEN 0 ELSE 1 END) OVER (PARTITION BY file_seq ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head,
    sum(CASE WHEN starts_with(t, '+') THEN 0 ELSE 1 END) OVER (PARTITION BY file_seq ORDER BY i) AS run FROM l),
ranges AS (SELECT project_id, file_seq, path, CAST(min(head) AS INT) AS range_start, CAST(max(head) AS INT) AS range_end FROM h WHERE starts_with(t, '+') GROUP BY project_id, file_seq, path, run) SELECT * FROM ranges
