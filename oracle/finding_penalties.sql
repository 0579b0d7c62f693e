SELECT seq, CASE WHEN score_penalty IS NULL OR isnan(score_penalty) THEN
     CASE severity WHEN 'critical' THEN CAST(10 AS DOUBLE) WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 0.5 ELSE 0 END ELSE score_penalty END
   * CASE WHEN agent_name <> 'maintainability' THEN CAST(1 AS DOUBLE) WHEN complexity < 5 THEN 0.5 WHEN complexity > 20 THEN 1.5 ELSE 1 END AS penalty FROM findings
