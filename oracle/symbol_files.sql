SELECT DISTINCT project_id, symbol_name, path FROM findings WHERE path IS NOT NULL AND symbol_name IS NOT NULL
