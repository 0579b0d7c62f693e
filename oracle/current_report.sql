SELECT path, seq, '- **[' || upper(severity) || ']** ' || title || CASE WHEN line_start IS NULL THEN '' ELSE ' (Line ' || CAST(line_start AS VARCHAR) || ')' END || chr(10) || '  - *' || agent_name || '*: ' || description AS value FROM findings WHERE path IS NOT NULL
