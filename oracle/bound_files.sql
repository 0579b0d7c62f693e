WITH r AS (SELECT seq, ts, path, CASE WHEN seq % 7 < 4 THEN seq % 7 ELSE 0 END AS n, seq % 7 = 5 AS e FROM changes),
d AS (SELECT * FROM r WHERE n > 0 OR NOT e),
w AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS k, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS cleans FROM d),
l AS (SELECT path, n AS n_findings, seq FROM w WHERE k = 1 AND n > 0),
f AS (SELECT path, min_by(ts, (ts, seq)) AS first_seen, min_by(seq, (ts, seq)) AS first_seq FROM w WHERE cleans = 0 GROUP BY path) SELECT path, first_seen FROM l JOIN f USING (path) QUALIFY row_number() OVER (ORDER BY first_seen DESC, first_seq DESC) <= 30
