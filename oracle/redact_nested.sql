SELECT event_id, event_type AS kind, '[REDACTED]' AS auth, '[REDACTED]' AS call_key, 'retry' AS who,
  CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' ELSE props END AS header,
  CASE WHEN event_id % 5 <> 0 THEN '[REDACTED]' END AS tried_password,
  CASE WHEN event_id % 5 <> 0 THEN value END AS took
FROM events
