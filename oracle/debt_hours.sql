SELECT project_id, coalesce(sum(estimated_hours) FILTER (severity = 'critical'), 0) AS critical, coalesce(sum(estimated_hours) FILTER (severity = 'high'), 0) AS high, coalesce(sum(estimated_hours) FILTER (severity = 'medium'), 0) AS medium,
  coalesce(sum(estimated_hours) FILTER (severity = 'low'), 0) AS low, coalesce(sum(estimated_hours) FILTER (severity <> 'info'), 0) AS total FROM findings GROUP BY project_id
