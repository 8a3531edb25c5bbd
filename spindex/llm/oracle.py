"""DuckDB SQL for the operators that SQL can express.

The others are tested against brute force, an exact round trip or held-out
labels (``tests/llm``): 1 and 2 need a tokenizer, 4 is approximate, 9 and 10
are learned.
"""

OP3 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hx FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY hx) AS keep FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hx, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to,
  true AS intact
FROM g
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT *, coalesce(least(cap, w * (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1)), cap) AS target
  FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, h) AS words
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), e AS (
  SELECT *, min(CASE WHEN upto > rest THEN h END) OVER (PARTITION BY source) AS boundary FROM c
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(2, whole + CASE WHEN h < boundary OR (h = boundary AND upto - rest < rest - (upto - words)) THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM e
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

OP8 = r"""
WITH l AS (
  SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)
), p AS (
  SELECT doc_id, i, 2 AS n, x || chr(10) || y AS body FROM l WHERE y IS NOT NULL AND regexp_matches(x || y, '[^\x20\x09-\x0D]')
  UNION ALL
  SELECT doc_id, i, 1, x FROM l WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 50
), f AS (
  SELECT doc_id, i, n FROM p QUALIFY row_number() OVER (PARTITION BY n, body ORDER BY doc_id, i) > 1
), g AS (
  SELECT doc_id, i FROM f UNION SELECT doc_id, i + 1 FROM f WHERE n = 2
), k AS (
  SELECT l.doc_id, l.i, l.x, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i
)
SELECT d.doc_id, CAST(count(k.i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (k.gone) AS BIGINT) AS removed_lines,
  CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(k.x, chr(10) ORDER BY k.i) FILTER (NOT k.gone), '') END AS text
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.text
"""

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

OP11 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
z AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
p AS (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY t, nn),
s AS (
  SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * n.n * z.nn) // z.ll)))) AS BIGINT) AS score
  FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t JOIN n ON n.doc_id = p.doc_id, z GROUP BY q.item_id, p.doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 50
"""

_OP12_ROUND = """, a{r} AS (
  SELECT vec_id, x.p, x.x, min(struct_pack(d := list_sum(list_transform(list_zip(x.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i := e.i)) AS b
  FROM parts x JOIN e{r} e ON x.p = e.p GROUP BY vec_id, x.p, x.x
), e{s} AS (
  SELECT e.p, e.i, coalesce(m.x, e.x) AS x
  FROM e{r} e LEFT JOIN (
    SELECT p, i, list(CAST(floor(total / n) AS BIGINT) ORDER BY pos) AS x
    FROM (SELECT p, b.i AS i, pos, CAST(sum(x[pos]) AS DOUBLE) AS total, count(*) AS n
          FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS pos) GROUP BY p, b.i, pos)
    GROUP BY p, i
  ) m ON m.p = e.p AND m.i = e.i
)"""

OP12 = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda z: CAST(floor(4096 * CAST(z AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
), parts AS (
  SELECT vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM kept, (SELECT unnest(range(8)) AS p)
), e0 AS (
  SELECT p, i, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM parts) WHERE i < 16
)""" + "".join(_OP12_ROUND.format(r=r, s=r + 1) for r in range(6)) + """, f AS (
  SELECT vec_id, x.p, min(struct_pack(d := list_sum(list_transform(list_zip(x.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i := e.i)) AS b
  FROM parts x JOIN e6 e ON x.p = e.p GROUP BY vec_id, x.p
), c AS (
  SELECT vec_id, string_agg(format('{:02x}', b.i), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM f GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM e6
)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN kept ON c.vec_id = kept.vec_id CROSS JOIN h
"""

OP13 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE|TEXT)\]')) AS n_text,
    length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE|TEXT)\]')) AS n_role
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 13 ELSE 23 + n_role END) AS BIGINT)
    AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL = {"op3_warc": OP3, "op5_mix": OP5, "op6_exact_dedup": OP6, "op7_jaccard_join": OP7, "op8_line_dedup": OP8,
       "op11_lexical_search": OP11, "op12_codes": OP12, "op13_chat": OP13}
