SELECT project_id, coalesce(sum(hours_wasted) FILTER (severity = 'critical'), 0) AS critical, coalesce(sum(hours_wasted) FILTER (severity = 'high'), 0) AS high, coalesce(sum(hours_wasted) FILTER (severity = 'medium'), 0) AS medium,
  coalesce(sum(hours_wasted) FILTER (severity = 'low'), 0) AS low, coalesce(sum(hours_wasted) FILTER (severity <> 'info'), 0) AS total FROM findings GROUP BY project_id
