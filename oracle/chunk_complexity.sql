WITH b AS (SELECT file_seq, regexp_replace(content, '"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|''[^''\\\n]*(?:\\[^\n][^''\\\n]*)*''|`[^`\\]*(?:\\[^\n][^`\\]*)*`|//[^\n]*|/\*[\s\S]*?\*/', ' ', 'g') AS t FROM files)
SELECT file_seq, CAST(len(regexp_extract_all(t, '\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?\s')) + 1 AS INT) AS complexity FROM b
