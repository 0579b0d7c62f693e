WITH f AS (SELECT file_seq, lower('src/' || ['auth', 'api', 'store', 'guardType', 'vm', 'billing', 'util', 'config', 'mock', 'dto', 'plain'][file_seq % 11 + 1] || '/' || regexp_replace(path, '^src/', '')) AS p,
  len(string_split(content, chr(10))) AS loc FROM files)
SELECT file_seq, round(CAST(least(loc / 50, 5) + CASE WHEN regexp_matches(p, 'auth|login|session|token|password|secret|key') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'api|route|handler|controller|endpoint') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(p, 'service|repository|dao|store') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'middleware|interceptor|guard|acl|permission|policy|tenant|scope|rbac|access') THEN 8 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'runtime|vm|sandbox|exec|spawn|crypto|eval') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(p, 'payment|billing|stripe|webhook') THEN 9 ELSE 0 END
  + CASE WHEN regexp_matches(p, 'util|helper|common|shared') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(p, 'config|env|settings') THEN 7 ELSE 0 END
  - CASE WHEN regexp_matches(p, 'test|spec|mock|fixture') THEN 5 ELSE 0 END
  - CASE WHEN regexp_matches(p, 'type|interface|dto') AND NOT regexp_matches(p, '(auth|user|payment|session|security|permission|policy|rbac).*(type|interface|dto)|(type|interface|dto).*(auth|user|payment|session|security|permission|policy|rbac)') THEN 2 ELSE 0 END AS DOUBLE), 6) AS risk FROM f
