SELECT slug, CAST(regexp_extract(doc, '\*\*Date:\*\* (\S+)', 1) AS DATE) AS decided_on, regexp_extract(doc, '\*\*File:\*\* (.+):(\d+)-(\d+)', 1) AS path,
  CAST(regexp_extract(doc, '\*\*File:\*\* (.+):(\d+)-(\d+)', 2) AS INT) AS line_start, CAST(regexp_extract(doc, '\*\*File:\*\* (.+):(\d+)-(\d+)', 3) AS INT) AS line_end,
  split_part(doc, '## Decision' || chr(10), 2) AS decision FROM decisions
