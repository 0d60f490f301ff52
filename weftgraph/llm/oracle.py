"""DuckDB SQL with the rows of those operators that SQL can express."""

from __future__ import annotations

#: Terms in lower case by letter, kept ones by language, prices in whole numbers; every two sources over every kept term.
SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT rn, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rn) AS docs FROM t GROUP BY ALL),
v AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM v GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n, v.n AS lang_n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM k GROUP BY ALL),
p AS (
  SELECT k.lang, k.source, k.term, k.n, 1 + (1000000000 * (k.n + 5)) // (s.n + 5 * l.v) AS p, 1 + (1000000000 * (k.lang_n + 5)) // (l.n + 5 * l.v) AS q
  FROM k JOIN s USING (lang, source) JOIN l USING (lang)
), sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: crc32 of a conversation's number, bit by bit; then a row for each conversation and prefix, and one for each prefix and what begins with it.
PREFIX_TRIE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM own
), built AS (
  SELECT own.conv_id, list_concat(coalesce(base.turns[1:h], []), own.turns[h + 1:]) AS turns
  FROM own JOIN crc USING (conv_id) LEFT JOIN own base ON base.conv_id = own.conv_id - own.conv_id % 20
), steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
members AS (SELECT conv_id, depth, turns[1:depth] AS prefix, turns[1:depth - 1] AS above, depth = len(turns) AS ends FROM steps),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN depth > 0 THEN above END) AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(prefix)[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM members GROUP BY prefix, depth
), kids AS (SELECT above AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sized AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix, depth)),
upward AS (SELECT unnest(range(0, depth + 1)) AS up, prefix, saved, n_children = 0 AS leaf FROM sized),
totals AS (SELECT prefix[1:up] AS prefix, up AS depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM upward GROUP BY ALL)
SELECT s.conv_id, s.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n AS n_convs, s.n_children, totals.n_leaves, totals.saved_tokens, s.ends_sha256
FROM sized s JOIN totals USING (prefix, depth) LEFT JOIN nodes p ON p.prefix = s.above AND p.depth = s.depth - 1
"""
