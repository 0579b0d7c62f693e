SELECT file_seq, path FROM files WHERE file_seq % 80 = 3 OR path LIKE 'src/d11/%'
