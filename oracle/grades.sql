SELECT run_id, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 75 THEN 'B+' WHEN score >= 70 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN score >= 90 THEN 'brightgreen' WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' WHEN score >= 40 THEN 'orange' ELSE 'red' END AS colour FROM history
