SELECT seq, seq % 2 = 0 AS is_conflict, title AS decision, 't' AS tradeoff, CASE WHEN seq % 4 = 1 THEN CAST(85 AS DOUBLE) ELSE CAST(seq % 100 AS DOUBLE) END AS confidence, 'N/A' AS losing_side FROM findings WHERE seq % 4 <> 3
