SELECT path, CAST(sum(i) AS BIGINT) AS importer_count, CAST(sum(o) AS BIGINT) AS import_count FROM (SELECT importee AS path, 1 AS i, 0 AS o FROM edges UNION ALL SELECT importer, 0, 1 FROM edges) GROUP BY path
