WITH d AS (
  SELECT regexp_replace(regexp_extract(doc, '/([^/]+):\d+-\d+', 1), '\.[^.]+$', '') || '-' || substring(md5(regexp_extract(doc, '\*\*File:\*\* (.+):(\d+)-(\d+)', 1)
    || regexp_extract(doc, ':(\d+)-(\d+)', 1) || split_part(doc, '## Decision' || chr(10), 2)), 1, 6) AS slug, CAST(CAST(regexp_extract(doc, '\*\*Date:\*\* (\S+)', 1) AS DATE) AS TIMESTAMP) AS modified_at FROM decisions),
m AS (SELECT slug, max(modified_at) AS modified_at FROM d GROUP BY slug)
SELECT slug, modified_at FROM m QUALIFY row_number() OVER (ORDER BY modified_at DESC, slug) <= 100
