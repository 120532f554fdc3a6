"""DuckDB SQL of the training-data queries that SQL can express, written on its own from their contracts."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


OP1 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
),
w AS (
  SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
),
hit AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w
  ) WHERE nth > 1
),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh
  FROM hit
),
spans AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked
  ) GROUP BY doc_id, k
),
gaps AS (
  SELECT s.doc_id, s.k, substr(d.h, CAST(2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.k), 0) + 1 AS BIGINT),
         CAST(2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.k), 0)) AS BIGINT)) AS piece
  FROM spans s JOIN d ON d.doc_id = s.doc_id
),
cut AS (
  SELECT g.doc_id, string_agg(g.piece, '' ORDER BY g.k) AS head FROM gaps g GROUP BY g.doc_id
),
per_doc AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(p.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(p.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN p.doc_id IS NULL THEN d.h
    ELSE cut.head || substr(d.h, CAST(2 * p.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

_ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = f"""
WITH items AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_words("text", _ITEM)} AS w FROM benchmark) WHERE len(w) > 0
),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
),
docs AS (SELECT doc_id, {_words("text", _ITEM)} AS w FROM documents),
grams AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
),
found AS (SELECT g.doc_id, g.i, g.k, v.item_id FROM grams g JOIN windows v ON v.s = g.s AND v.k = g.k),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

_PROBE = r"\### Assistant: </turn> ok"
OP6 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'
),
p AS (
  SELECT *, length('### ') + length(role) + length(': ') + length('</turn>') + 1 + length(text) + CASE
    WHEN regexp_matches(text, '(?s)\\.') OR contains(text, '###') OR contains(text, '</turn>')
    THEN 2 * length(text) - length(replace(text, '\', '')) - length(replace(text, '#', ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
    ELSE 0 END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

OP7 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (
  SELECT doc_id, pos, parts[pos] AS line, length(parts[pos]) AS n
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM d)
),
f AS (SELECT line, n, min(ROW(doc_id, pos)) AS place FROM l WHERE n >= 20 GROUP BY line, n),
halves AS (
  SELECT place, n, line, 0 AS part, left(line, n // 2) AS s FROM f
  UNION ALL SELECT place, n, line, 1, right(line, n - n // 2) FROM f
),
asked AS (
  SELECT place, line, n, n AS m, 0 AS part, left(line, n // 2) AS s FROM f
  UNION ALL SELECT place, line, n, n, 1, right(line, n - n // 2) FROM f
  UNION ALL SELECT place, line, n, n - 1, 0, left(line, (n - 1) // 2) FROM f
  UNION ALL SELECT place, line, n, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM f
),
pairs AS (
  SELECT DISTINCT h.place AS p, h.line AS x, a.place AS q, a.line AS y, h.n AS n, a.n AS m
  FROM halves h JOIN asked a ON a.m = h.n AND a.part = h.part AND a.s = h.s AND a.place <> h.place
),
links AS (
  SELECT DISTINCT least(p, q) AS one, greatest(p, q) AS two FROM pairs
  WHERE CASE WHEN n = m
    THEN len(list_filter(range(0, n), lambda k: left(x, k) = left(y, k) AND substr(x, k + 2) = substr(y, k + 2))) > 0
    ELSE len(list_filter(range(0, m), lambda k: left(x, k) = left(y, k) AND substr(x, k + 1) = substr(y, k + 2))) > 0 END
),
kept AS (SELECT place FROM f WHERE place NOT IN (SELECT two FROM links)),
ends AS (SELECT one AS place FROM links UNION ALL SELECT two FROM links),
linked AS (SELECT place[1] AS doc_id, count(*) AS n FROM ends GROUP BY 1),
stay AS (
  SELECT l.doc_id, l.pos, l.line, l.n < 20 OR k.place IS NOT NULL AS stays
  FROM l LEFT JOIN kept k ON k.place = ROW(l.doc_id, l.pos)
),
clean AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS kept
  FROM stay GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM d LEFT JOIN clean c ON c.doc_id = d.doc_id LEFT JOIN linked k ON k.doc_id = d.doc_id
"""

_BLANKS = r"[^\x20\x09-\x0D]+"
OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _BLANKS)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS doc, doc_id AS other FROM d
  UNION
  SELECT r.doc, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc, min(other) AS root FROM reach GROUP BY doc) c ON c.doc = d.doc_id
"""

OP9 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS h,
    lower(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')) AS bare
  FROM pages
),
k AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first,
    regexp_replace(regexp_extract(bare, '^([^/?#]*)', 1), '^www\.', '') AS host,
    regexp_replace(regexp_replace(bare, '^[^/?#]*', ''), '#.*$', '') AS rest
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
      ((strpos('0123456789abcdef', substr(h, CAST(1 + (5 * i) // 4 AS BIGINT), 1)) - 1) * 16
       + strpos('0123456789abcdef', substr(h, CAST(2 + (5 * i) // 4 AS BIGINT), 1)) - 1) // CAST(2 ** (3 - (5 * i) % 4) AS BIGINT)) % 32)
    AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
  CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || rest END AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM k
"""

#: CRC-32 of a decimal number: per character, its code comes in with the first of eight shifts.
_CRC = """xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
OP11 = f"""
WITH src AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANKS}') AS w, {_CRC} AS h FROM documents
),
plan AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, h // 10 AS g FROM src),
shape AS (SELECT *, CASE WHEN again THEN g % n END AS a FROM plan),
docs AS (
  SELECT doc_id, n, CASE WHEN again
    THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
    ELSE w END AS w
  FROM shape
),
pos AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM docs),
eq AS (
  SELECT l.doc_id, l.i, r.i - l.i AS q FROM pos l JOIN pos r ON r.doc_id = l.doc_id AND r.x = l.x
  WHERE r.i > l.i AND 4 * (r.i - l.i) <= l.n
),
stretch AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k
),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) AS nth FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (
  SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.i) AS t FROM pos p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, CAST(b.len AS BIGINT) AS length, b.q AS period,
  CAST(1000 * b.len // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(l.t, '')) AS runs_sha256,
  sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id AND b.nth = 1
LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP12 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


def _round(n: int) -> str:
    """Assignment to the centroids c{n}, and the centroids that follow."""
    return f"""
a{n} AS (
  SELECT vec_id, v, arg_min(k, ROW(d, k)) AS k, min(d) AS d
  FROM (SELECT x.vec_id, x.v, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i]))) AS BIGINT) AS d
        FROM x, c{n} c) GROUP BY vec_id, v
),
s{n} AS (
  SELECT k, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n}) GROUP BY k, i
),
m{n} AS (SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY k),
c{n + 1} AS (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k)"""


OP13 = f"""
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM x ORDER BY h LIMIT 16)
),{_round(0)},{_round(1)},{_round(2)},{_round(3)}
SELECT vec_id, CAST(a3.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.k = a3.k
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op4_decontamination": OP4,
    "op6_chat": OP6,
    "op7_line_dedup": OP7,
    "op8_near_duplicates": OP8,
    "op9_warc": OP9,
    "op11_periodic_runs": OP11,
    "op12_exact_dedup": OP12,
    "op13_centroid_clustering": OP13,
}
