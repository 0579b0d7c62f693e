SELECT seq FROM findings f WHERE NOT (severity IN ('critical', 'high') AND ((seq % 3 <> 0 AND seq % 5 = 1) OR (seq % 3 = 0 AND path IS NOT NULL AND path NOT IN (SELECT path FROM modules WHERE m % 4 <> 0))))
