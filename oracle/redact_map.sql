SELECT event_id, '[REDACTED]' AS token, props AS first FROM events
