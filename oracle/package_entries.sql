SELECT unnest([min(path), max(path), 'dist/d1/f1.js', 'src/d1/f1.ts']) AS path, TRUE AS is_library FROM code_meta WHERE path LIKE '%.ts'
