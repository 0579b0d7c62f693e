SELECT CAST(i AS INT) AS n, ['zod', 'ajv'][i + 1] AS library FROM (SELECT unnest(range(0, 2)) AS i FROM (SELECT count(*) FROM code_meta))
