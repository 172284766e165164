"""SQL for DuckDB with the results of this package's queries, where SQL can express them."""

from __future__ import annotations

OP2 = r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host,
         TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (page_id % 366)::INT AS seen
  FROM pages
), h AS (
  SELECT DISTINCT host AS domain, ('0x' || substr(md5(host), 1, 4))::INT AS a, ('0x' || substr(md5(host), 5, 4))::INT AS b,
         ('0x' || substr(md5(host), 9, 4))::INT AS c, ('0x' || substr(md5(host), 13, 4))::INT AS d
  FROM p WHERE host IS NOT NULL
), s AS (
  SELECT domain, ['adult', 'malware', 'spam'][c % 3 + 1] AS category, b, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (a % 200) AS first FROM h WHERE d % 7 < 4
), u AS (
  SELECT domain, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (('0x' || substr(md5(domain), 1, 4))::INT % 200) AS first,
         ('0x' || substr(md5(domain), 17, 4))::INT AS x, ('0x' || substr(md5(domain), 21, 4))::INT AS y
  FROM (SELECT DISTINCT regexp_extract(domain, '[^.]+\.[^.]+$') AS domain FROM h) WHERE domain <> ''
), v AS (
  SELECT domain, category, first AS valid_from, CASE WHEN b % 2 = 0 THEN first + INTERVAL 90 DAY END AS valid_to FROM s
  UNION ALL
  SELECT domain, category, first + INTERVAL 150 DAY, NULL FROM s WHERE b % 4 = 0
  UNION ALL
  SELECT domain, 'network', first, first + INTERVAL 120 DAY FROM u WHERE x % 5 < 2
  UNION ALL
  SELECT domain, 'tracker', first, first + INTERVAL 120 DAY FROM u WHERE y % 5 < 2
), hits AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(valid_from) AS active_since
  FROM p JOIN v ON (host = domain OR (host LIKE '%.' || domain AND domain LIKE '%.%')) AND valid_from <= seen AND (valid_to IS NULL OR seen < valid_to)
  GROUP BY page_id
)
SELECT p.page_id, host, n IS NOT NULL AS blocked, coalesce(n, 0)::BIGINT AS n_matches, categories, active_since
FROM p LEFT JOIN hits ON p.page_id = hits.page_id
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n,
         coalesce(source, chr(0) || 'null') AS s, md5('0:' || coalesce(source, chr(0) || 'null') || ':' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents
), t AS (SELECT s, sum(n)::BIGINT AS tokens FROM d GROUP BY s),
q AS (SELECT list(tokens::DOUBLE / total) AS p, ln(count(*)) AS ln_n, min(tokens::DOUBLE / total) AS least
      FROM t, (SELECT sum(tokens)::DOUBLE AS total FROM t) WHERE tokens > 0),
e AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END
  FROM (SELECT i, lo, hi, m, ln(list_sum(list_transform(p, lambda x: x ** m))) - m * list_sum(list_transform(p, lambda x: x ** m * ln(x))) / list_sum(list_transform(p, lambda x: x ** m)) >= 0.97 * ln_n - 1e-12 AS ok
        FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN 1.0 ELSE (lo + hi) / 2 END AS m FROM e WHERE i < 60), q)
), r AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END
  FROM (SELECT i, lo, hi, m, least ** m / list_sum(list_transform(p, lambda x: x ** m)) <= 4.0 * least * (1 + 1e-12) AS ok
        FROM (SELECT i, lo, hi, CASE WHEN i = 0 THEN 0.0 ELSE (lo + hi) / 2 END AS m FROM r WHERE i < 60), q)
), a AS (
  SELECT round(greatest((SELECT (lo + hi) / 2 FROM e WHERE i = 60), (SELECT (lo + hi) / 2 FROM r WHERE i = 60)), 6) AS a
), w AS (
  SELECT s, tokens, CASE WHEN tokens > 0 THEN floor((tokens::DOUBLE / total) ** a / list_sum(list_transform(p, lambda x: x ** a)) * total + 1e-6)::BIGINT ELSE 0 END AS want
  FROM t, q, a, (SELECT sum(tokens)::DOUBLE AS total FROM t)
), k AS (
  SELECT doc_id, source, n, CASE WHEN tokens > 0 THEN want // tokens ELSE 0 END AS whole, want, tokens,
         sum(n) OVER (PARTITION BY d.s ORDER BY place) AS upto
  FROM d JOIN w ON d.s = w.s
)
SELECT doc_id, source, n AS n_tokens, (whole + CASE WHEN tokens > 0 AND upto <= want - whole * tokens THEN 1 ELSE 0 END)::BIGINT AS copies FROM k
"""

OP3 = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT rep, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (
  SELECT DISTINCT rep, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w
), z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies::BIGINT AS n_copies
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN k ON k.node = t.rep LEFT JOIN n ON n.a = t.rep
"""

OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE r > 1) GROUP BY doc_id),
x AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
y AS (SELECT doc_id, w, list_sort(gone) AS gone, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)) AS kept FROM x)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_transform(kept, lambda j: w[j]), ' ')) AS kept_sha256,
       len(list_filter(gone, lambda j: NOT list_contains(gone, j - 1)))::BIGINT AS n_repeats
FROM y
"""

#: Each different set of words once; candidates share one of the rarest words that a Jaccard similarity of 0.8 must share.
OP7 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
s AS (SELECT doc_id, k, line, doc_id * 1048576 + k AS place, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS w FROM l),
e AS (SELECT row_number() OVER () AS id, w, len(w) AS n, min(place) AS first FROM s WHERE len(w) > 0 GROUP BY w),
x AS (SELECT id, n, unnest(w) AS t FROM e),
f AS (SELECT t, count(*) AS c FROM x GROUP BY t),
r AS (SELECT id, n, x.t, row_number() OVER (PARTITION BY id ORDER BY c, x.t) AS pos FROM x JOIN f ON x.t = f.t),
q AS (SELECT id, n, t FROM r WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM q a JOIN q b ON a.t = b.t AND a.id <> b.id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
m AS (SELECT p.a AS id, min(y.first) AS other FROM p JOIN e z ON z.id = p.a JOIN e y ON y.id = p.b WHERE 9 * len(list_intersect(z.w, y.w)) >= 4 * (z.n + y.n) GROUP BY p.a),
g AS (SELECT s.doc_id, s.k, s.line, coalesce(s.place > least(e.first, coalesce(m.other, e.first)), FALSE) AS gone FROM s LEFT JOIN e ON s.w = e.w LEFT JOIN m ON m.id = e.id),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""

#: The table of the byte-wise CRC-32, and the CRC of hexadecimal bytes.
_CRC_TABLE = """k AS (SELECT list(c ORDER BY i) AS k FROM (
  SELECT i, list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i)))"""
_CRC = "xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, k[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP13 = f"""
WITH {_CRC_TABLE},
x AS (SELECT TRUE AS own, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT FALSE, item_id, {_WORDS} FROM benchmark),
f AS (SELECT own, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM x),
g AS (SELECT own, id, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT f, {_CRC} % 10000 AS bucket FROM h, k),
b AS (SELECT own, id, bucket, sum(n)::BIGINT AS n FROM g JOIN c ON g.f = c.f GROUP BY ALL),
n AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM b GROUP BY bucket),
z AS (SELECT sum(s) + 10000 AS s, sum(t) + 10000 AS t FROM n),
a AS (SELECT bucket, floor(1000 * ln((n.t + 1) * z.s / ((n.s + 1) * z.t)))::BIGINT AS gain FROM n, z),
w AS (SELECT id, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n FROM b JOIN a ON b.bucket = a.bucket WHERE own GROUP BY id),
d AS (SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, coalesce(len(x.w), 0) >= 20 AS able
      FROM x LEFT JOIN w USING (id) WHERE own),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY able) AS of FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 5 * of // 100 THEN r END::BIGINT AS rank FROM r
"""


def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """The path of a state after one more edit."""
    text = f"{state}.r" if line is None else f"{state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {text}}}"


def _least(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}])[1]"


def _kept(to: str, since: str, initial: str, role: str) -> str:
    """Paths into a state: its own with the row deleted, those of other states with it rerolled or kept; paths that are not open cost a billion more."""
    shut = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE cut_off END"
    other = f"CASE WHEN left(role, 1) <> '{initial}' THEN 1000000000 ELSE {shut} END"
    moves = [_edit(to, "3", "D")]
    for x in since:
        moves += [_edit(x, f"2 + {shut}", "R", f"'{role}:' || text")] * bool(role) + [_edit(x, other, "K", "role || ':' || text")]
    return _least(*moves)


_BIG = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"

OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS f
      FROM (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations), k),
e AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d, range(2) t(i) WHERE f <> 0 AND (i = 0 OR f = 3)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos,
             CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM g),
n AS (SELECT *, (fault = 'truncated')::BIGINT AS cut_off, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM h),
m AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY conv_id),
v AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS o, {_BIG} AS s, {{'c': 2::BIGINT, 'a': 'I', 'r': 'user:'}} AS u, {{'c': 4::BIGINT, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS a FROM m
  UNION ALL
  SELECT conv_id, pos, o, s, u, {_least("a", _edit("u", "2", "I", "'assistant:'"))} FROM (
    SELECT conv_id, pos, o, s, {_least("u", *(_edit(x, "2", "I", "'user:'") for x in "osa"))} AS u, a FROM (
      SELECT n.conv_id, n.pos, {_edit("o", "3", "D")} AS o, {_kept("s", "o", "s", "")} AS s, {_kept("u", "osa", "u", "user")} AS u, {_kept("a", "u", "a", "assistant")} AS a
      FROM v JOIN n ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND n.pos = v.pos + 1))
),
w AS (SELECT m.*, {_least("o", "a")} AS best FROM v JOIN m ON v.conv_id IS NOT DISTINCT FROM m.conv_id AND v.pos = m.rows)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id
"""

EDITS = """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, (length(t) - length(t) // 3)::BIGINT) || substr(next, 1, (length(t) // 3)::BIGINT)) AS edited_sha256 FROM n
"""

COUNTS = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
x AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
"""

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 999) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(digits, lambda c, k: CASE WHEN k % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 9 AND 15"),
}


def _spans(k: int, kind: str) -> str:
    """Matches of a pattern with their places: what lies between matches tells how far in they begin."""
    pattern, fine = _KINDS[kind]
    return rf"""SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, m[i] AS m, list_reverse(regexp_extract_all(m[i], '[0-9]')) AS digits, (list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) - length(m[i]))::BIGINT AS start
      FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents WHERE text IS NOT NULL))) WHERE {fine}"""


PII_BASE = rf"""
WITH s AS ({" UNION ALL ".join(_spans(k, kind) for k, kind in enumerate(_KINDS))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _KINDS)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM documents d LEFT JOIN a USING (doc_id)
"""

UNIGRAMS = rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce({_CRC} % 7 = 2, FALSE) AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS x FROM documents), k),
t AS (SELECT doc_id, held_out, token, count(*) AS n FROM (SELECT doc_id, held_out, unnest(list_append(w, '')) AS token FROM d) GROUP BY ALL),
c AS (SELECT token, sum(n)::BIGINT AS c FROM t WHERE NOT held_out GROUP BY token),
z AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, sum(t.n)::BIGINT AS n_tokens, coalesce(sum(t.n) FILTER (c > 0), 0)::BIGINT AS n_known, any_value(z.n) AS train_tokens, round(sum(t.n * log10((coalesce(c, 0) + 1)::DOUBLE / (z.n + z.v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (token), z GROUP BY doc_id, held_out
"""

ORACLE: dict[str, str] = {"op2_url_filters": OP2, "op3_near_duplicates": OP3, "op6_mixing": OP6, "op7_line_dedup": OP7, "op9_substring_dedup": OP9, "op12_conversation_repair": OP12, "op13_importance_resampling": OP13, "fingerprint_edits": EDITS, "quality_counts": COUNTS, "pii_base": PII_BASE, "unigram_scores": UNIGRAMS}
