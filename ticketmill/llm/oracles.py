"""DuckDB SQL for the operators that SQL can express."""

SUBSTRING = r"""
WITH words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
    SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS seq
    FROM words
), firsts AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(seq, ' ')) AS first_doc
    FROM windows WHERE len(seq) = 13
), covered AS (
    SELECT w.doc_id, w.i, w.word,
           coalesce(max(CASE WHEN f.first_doc < f.doc_id THEN 1 ELSE 0 END)
                    OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
    FROM words w LEFT JOIN firsts f USING (doc_id, i)
), edged AS (
    SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM covered
), totals AS (
    SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept_sha256,
           CAST(sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_spans
    FROM edged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM documents d LEFT JOIN totals t USING (doc_id)
"""

VARIANTS = """
WITH RECURSIVE steps AS (
  SELECT list(CAST(c AS BIGINT) ORDER BY b) AS crc_table FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
  )
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents
), distinct_runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS times
  FROM runs GROUP BY ALL
), octets AS (
  SELECT doc_id, word, times, flatten(list_transform(string_split(doc_id || ':' || word, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END)) AS bytes
  FROM distinct_runs
), hashed AS (
  SELECT word, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda c, x: xor(c >> 8, crc_table[xor(c & 255, x) + 1]))) AS h
  FROM octets, steps
), slipped AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(word, 1, CAST(h % length(word) AS INT)) || substring(word, CAST(h % length(word) AS INT) + 2)
    ELSE word END AS word, times FROM hashed
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cuts AS (
  SELECT word, n, i, substring(word, 1, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place,
    count(*) OVER (PARTITION BY word) AS n_near FROM near
), known AS (
  SELECT w.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.place = 1
), followed AS (
  SELECT word, word AS root, form AS further FROM known
  UNION ALL SELECT f.word, k.word, k.form FROM followed f JOIN known k ON f.further = k.word
)
SELECT k.word, k.form, f.root, k.n, k.n_near, k.form_n
FROM known k JOIN followed f ON k.word = f.word AND f.further IS NULL
"""
