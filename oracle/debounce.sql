WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, seq) AS nx FROM changes)
SELECT path, seq, ts + INTERVAL 6 HOUR AS fire_ts FROM n WHERE kind <> 'unlink' AND (nx IS NULL OR nx - ts > INTERVAL 6 HOUR)
