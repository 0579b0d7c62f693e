WITH f AS (SELECT regexp_replace(path, '\.\w+$', ['.cpp', '.go', '.rs'][file_seq % 3 + 1]) AS path, '#include <a/b.h>' || chr(10) || 'import (' || chr(10) || ' "fmt"' || chr(10) || ' "os"' || chr(10) || ')' || chr(10) || 'import "net"' || chr(10) || 'use crate::x;' || chr(10) || content AS c FROM files),
x AS (SELECT path, list_concat(regexp_extract_all(c, '(?:\bimport(?:[\s\S]*?from\s+)?|\brequire\()\s*[''"]([^''"]+)[''"]', 1), CASE WHEN path LIKE '%.cpp' THEN regexp_extract_all(c, '#include\s*[<"]([^>"]+)[>"]', 1)
   WHEN path LIKE '%.rs' THEN regexp_extract_all(c, '\b(?:use|extern\s+crate)\s+([\w:]+)', 1)
   ELSE list_concat(flatten(list_transform(regexp_extract_all(c, '\bimport\s*\(([\s\S]*?)\)', 1), lambda b: regexp_extract_all(b, '"([^"]+)"', 1))), regexp_extract_all(c, '\bimport\s+"([^"]+)"', 1)) END) AS s FROM f),
y AS (SELECT path, s[i] AS spec, min(i) AS p FROM x, unnest(range(1, len(s) + 1)) AS r(i) GROUP BY ALL),
z AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY p) - 1 AS INT) AS pos, spec FROM y)
SELECT path, pos, spec FROM z
