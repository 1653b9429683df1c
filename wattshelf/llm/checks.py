"""DuckDB SQL that gives the rows of the numbered queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(coalesce(text, '')))) AS place
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT 0 AS round, source, source_size, weight, false AS is_full FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight, is_full OR level * weight > 3.0 * source_size
  FROM (
    SELECT *, (sum(source_size) OVER () - sum(CASE WHEN is_full THEN 3.0 * source_size ELSE 0 END) OVER ())::DOUBLE
              / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS level
    FROM filling WHERE round < 40)),
last AS (SELECT * FROM filling WHERE round = 40),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN 3.0::DOUBLE * source_size ELSE weight *
         (sum(source_size) OVER () - sum(CASE WHEN is_full THEN 3.0 * source_size ELSE 0 END) OVER ())::DOUBLE
         / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM last),
cut AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole,
         CAST(floor(target + 1e-6) AS BIGINT) AS words
  FROM targets),
placed AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, c.words - c.whole * c.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source),
taken AS (SELECT *, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS extra FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(whole * size + extra AS BIGINT) AS taken, whole, extra
FROM taken
"""

SUFFIX = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM hexed WHERE len(h) >= 200),
windows AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS w, md5_number(substr(h, 2 * p + 1, 200)) AS v FROM starts),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w, v ORDER BY doc_id, p) AS n FROM windows),
hits AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q
         FROM ranked WHERE n > 1),
marked AS (SELECT *, CASE WHEN q IS NULL OR p > q + 100 THEN 1 ELSE 0 END AS fresh FROM hits),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS from_here FROM runs r),
kept AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * from_here + 1, 2 * (a - from_here)), '' ORDER BY a) AS head,
         max(b) AS tail, sum(b - a) AS removed, count(*) AS spans
  FROM gaps g JOIN hexed d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM hexed d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

LINE_RULES = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
  FROM documents),
windows AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w) AS n
  FROM (SELECT r, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS w
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM base WHERE len(words) > 2))),
repeats AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE n > 1) GROUP BY r),
lines AS (SELECT r, source, md5(text) AS text, unnest(string_split(text, chr(10))) AS line FROM base),
worded AS (SELECT * FROM lines WHERE regexp_matches(line, '{WORD}')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY r),
normal AS (
  SELECT r, source, text, regexp_replace(regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '[1-9]', '0', 'g'), '^ | $', '', 'g') AS norm,
         sum(len(regexp_extract_all(line, '{WORD}'))) AS words
  FROM worded GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM normal GROUP BY source),
frequent AS (
  SELECT l.source, norm FROM normal l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, norm, h.n HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) > 0.10 * h.n),
removed AS (
  SELECT r, sum(words) AS n FROM normal l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(m.n, 0) AS BIGINT) AS removed_words
  FROM base b LEFT JOIN dups d USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN removed m USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM failed
"""

NEAR_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[p : p + least(5, len(words)) - 1], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS p FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 5 * shared.n >= 4 * (p.n + q.n - shared.n)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a)
SELECT c.doc_id, c.class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM classes c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON c.doc_id = l.a
"""

WARC = """
WITH hashed AS (
  SELECT page_id, encode(coalesce(html, '')) AS body,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
         array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
           4 * (instr('0123456789abcdef', substr(sha1(encode(coalesce(html, ''))), i, 1)) - 1) + 1, 4)), '') AS bits
  FROM pages)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
           + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
           + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM hashed
"""

URLS = r"""
WITH parsed AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(?:www|m)\.', '')
                                      || regexp_replace(path, '(?:\.html?|/+)$', '') END AS k
  FROM parsed),
listed AS (SELECT DISTINCT k FROM keyed WHERE k IS NOT NULL AND regexp_matches(html, '[a-z0-9]@[a-z0-9-]+\.[a-z]')),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM keyed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT n.page_id, host, path, rule, coalesce(v, CASE WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.k IS NOT NULL AS listed
FROM keyed n LEFT JOIN best b ON n.page_id = b.page_id LEFT JOIN listed l ON n.k = l.k
"""

DECONTAMINATE = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS words FROM benchmark WHERE item_id IS NOT NULL),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{PLAIN_WORD}') AS words FROM documents),
grams AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS w, array_to_string(words[p : p + least(10, len(words)) - 1], ' ') AS g
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM items WHERE len(words) > 0)),
widths AS (SELECT DISTINCT w FROM grams),
windows AS (
  SELECT r, w, p, array_to_string(words[p : p + w - 1], ' ') AS g
  FROM (SELECT r, w, words, unnest(range(1, len(words) - w + 2)) AS p FROM docs, widths WHERE len(words) >= w)),
hits AS (SELECT r, p, x.w, item_id FROM windows x JOIN grams y ON x.w = y.w AND x.g = y.g),
words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + w)) AS q FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words w USING (r) LEFT JOIN found f USING (r)
"""

UNIT = "[A-Za-z]+|[^A-Za-z]"

FILL_MIDDLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS d FROM base),
cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
              WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

SEED_EXTEND = rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM base WHERE len(words) >= 35),
windows AS (SELECT r, p, array_to_string(words[p : p + 34], ' ') AS w FROM starts),
hits AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY hash(w), md5_number(w)) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM hits),
places AS (SELECT r, doc_id, words, unnest(range(1, len(words) + 1)) AS q FROM base),
kept AS (SELECT r, string_agg(words[q], ' ' ORDER BY q) AS k, count(*) AS n FROM places ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (r)
"""

FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
LEAF = "sha256(" + " || ".join(FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: crc32 of the decimal id: bytes and, after each, eight shifts, folded from left to right.
CRC = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, (v & 1) * 3988292384) END))"""

#: Nodes of all groups, level by level: (keys, pos, n, digest). A tree ends at the level with one node.
LEVELS = """
  SELECT 0 AS level, {keys}, pos, n, digest FROM {nodes}
  UNION ALL
  SELECT level + 1, {keys}, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY level, {keys}, pos // 3"""

MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS g, source, {LEAF.format(text='text')} AS leaf,
         CASE WHEN {CRC} % 2 = 0 THEN {LEAF.format(text="replace(text, chr(10), '')")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)- 1 AS pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM leaves),
lower AS ({LEVELS.format(keys="g", nodes="placed", name="lower")}),
subroots AS (SELECT g, digest, level AS height, row_number() OVER (ORDER BY g)- 1 AS pos, count(*) OVER () AS n FROM lower WHERE n = 1),
upper AS ({LEVELS.format(keys="t", nodes="(SELECT 0 AS t, * FROM subroots)", name="upper")}),
root AS (SELECT digest AS root FROM upper WHERE n = 1),
flanks AS (
  SELECT p.r, l.level AS step, coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos < p.pos // pow3), '') AS before,
         coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos > p.pos // pow3), '') AS after
  FROM placed p JOIN (SELECT *, CAST(power(3, level) AS BIGINT) AS pow3 FROM lower WHERE n > 1) l ON l.g = p.g AND l.pos // 3 = p.pos // pow3 // 3 GROUP BY p.r, l.level
  UNION ALL
  SELECT p.r, 1000 + l.level, coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos < s.pos // pow3), ''),
         coalesce(string_agg(l.digest, '' ORDER BY l.pos) FILTER (l.pos > s.pos // pow3), '')
  FROM placed p JOIN subroots s ON p.g = s.g
       JOIN (SELECT *, CAST(power(3, level) AS BIGINT) AS pow3 FROM upper WHERE n > 1) l ON l.pos // 3 = s.pos // pow3 // 3 GROUP BY p.r, l.level),
steps AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM flanks),
folding AS (
  SELECT 0 AS k, r, coalesce(tampered, leaf) AS node FROM placed
  UNION ALL
  SELECT f.k + 1, f.r, sha256(before || node || after) FROM folding f JOIN steps s ON s.r = f.r AND s.k = f.k + 1),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY r),
folded AS (SELECT r, arg_max(node, k) AS folded_root FROM folding GROUP BY r)
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON p.g = s.g CROSS JOIN root LEFT JOIN proofs USING (r) JOIN folded USING (r)
"""
