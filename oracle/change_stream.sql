SELECT seq, ts, path, kind FROM changes WHERE seq % 5 <> 0
