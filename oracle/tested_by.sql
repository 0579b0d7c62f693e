SELECT DISTINCT importee AS path, regexp_replace(importer, '^src/', 'tests/') AS test_path FROM edges WHERE regexp_matches(importer, '^src/d1?7/') AND NOT regexp_matches(importee, '^src/d1?7/')
