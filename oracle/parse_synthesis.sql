SELECT seq, 'S ' || CAST(seq AS VARCHAR) AS summary, 1 AS n_fixes, CAST(2 AS DOUBLE) AS rank, title, CAST(1.5 AS DOUBLE) AS hours, 'a.ts' AS files, 'o' AS observations, 'fix' AS best_fix FROM findings WHERE seq % 3 <> 2
