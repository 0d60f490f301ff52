"""DuckDB SQL that gives the same rows as the registered queries, written from their definitions."""

from __future__ import annotations

from weftgraph.functions import text as T
from weftgraph.functions.turkish import VERB_STEMS
from weftgraph.operators.morphology import CONNECTIVES, ENDINGS, WHOLE_ENDINGS
from weftgraph.operators.routing import SYNONYMS
from weftgraph.plans.queries import CASES, KEYWORDS, LOADED, ROUTED, SLEEP_WEIGHT, TENSES


def _values(rows: tuple) -> str:
    quoted = lambda x: str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


LOWER_TR = "lower(translate({0}, 'İI', 'iı'))"
WORDS = "list_filter(regexp_split_to_array(" + LOWER_TR + r", '[^\p{{L}}_$-]'), lambda w: strlen(w) > 1)"
FOLD = "translate(" + LOWER_TR + f", '{T.FOLD_FROM}', '{T.FOLD_TO}')"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

PACKED = r"""string_split(list_reduce(list_prepend('', list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')),
    lambda a, w: CASE WHEN split_part(a, chr(1), -1) = '' THEN a || w
                      WHEN strlen(split_part(a, chr(1), -1)) + strlen(w) + 1 > 150 THEN a || chr(1) || w
                      ELSE a || ' ' || w END), chr(1))"""


def _chunks(docs: str) -> str:
    """CTEs up to chunks(doc_id, part, pos, chunk, place) of docs (doc_id, part, text)."""
    return rf"""docs AS ({docs}),
pieces AS (SELECT doc_id, part, list_filter(list_transform(regexp_split_to_array(text, '[.?!\n;]'), lambda x: {TRIM.format("x")}), lambda x: strlen(x) >= 5) AS ps FROM docs),
lists AS (SELECT doc_id, part, flatten(list_transform(ps, lambda p: CASE WHEN strlen(p) <= 150 THEN [p] ELSE {PACKED} END)) AS cs FROM pieces),
chunks AS (SELECT doc_id, part, pos, chunk, doc_id * 134217728 + pos * 128 AS place FROM (SELECT doc_id, part, unnest(cs) AS chunk, unnest(range(len(cs))) AS pos FROM lists))"""


DOCS = "SELECT doc_id, lang || '_' || source AS part, text FROM documents"
ONE_PART = "SELECT doc_id, 'general' AS part, text FROM documents"
ITEMS = "SELECT item_id AS doc_id, 'general' AS part, text FROM benchmark"
NODES = "nodes AS (SELECT part, min(place) AS node_id, chunk AS content FROM chunks GROUP BY part, chunk)"
TAGS = f"tags AS (SELECT part, node_id, tag, count(*)::DOUBLE AS weight FROM (SELECT part, node_id, unnest({WORDS.format('content')}) AS tag FROM nodes) GROUP BY ALL)"
EDGES = """edges AS (SELECT DISTINCT src_part, src_id, part AS dst_part, node_id AS dst_id, 0.85::DOUBLE AS weight, 0::BIGINT AS co_firings, 'Sequential' AS edge_type, NULL::VARCHAR AS role
  FROM (SELECT c.doc_id, c.pos, n.part, n.node_id, lag(n.part) OVER w AS src_part, lag(n.node_id) OVER w AS src_id
        FROM chunks c JOIN nodes n ON n.part = c.part AND n.content = c.chunk WINDOW w AS (PARTITION BY c.doc_id ORDER BY c.pos)) WHERE src_id IS NOT NULL)"""


def _graph(docs: str = DOCS) -> str:
    return ",\n".join((_chunks(docs), NODES, TAGS, EDGES))


TRIMMED = TRIM.format("text")
KIND = rf"""CASE WHEN regexp_matches({TRIMMED}, '^((fn|let|struct|impl|use|pub|\$|>) )') OR contains({TRIMMED}, 'println!')
    OR (contains({TRIMMED}, '{{') AND contains({TRIMMED}, '}}') AND contains({TRIMMED}, chr(10))) THEN 'Code'
  WHEN {TRIMMED} IN ('+', '-', '*', '/', '=') THEN 'Operator'
  WHEN contains({TRIMMED}, '=') OR (length(regexp_replace({TRIMMED}, '[^+*/-]', '', 'g')) >= 2 AND regexp_matches({TRIMMED}, '[0-9]')) THEN 'Equation'
  ELSE 'Concept' END"""

PART_NAMES = "parts AS (SELECT DISTINCT lang || '_' || source AS part FROM documents)"
PART_INDEX = f"""components AS (SELECT DISTINCT part, unnest(string_split({FOLD.format('part')}, '_')) AS name FROM parts),
part_index AS (SELECT DISTINCT part, k AS key FROM (SELECT part, name, unnest(list_transform(range(1, length(name) + 1), lambda n: substr(name, 1, n))) AS k FROM components) WHERE k = name OR strlen(k) > 4)"""
#: None of the queries' words has an ending that comes off without word statistics, so words are stems here.
ROUTING_STEMS = rf"""queries AS (SELECT * FROM (VALUES {_values(ROUTED)}) q(query_id, query)),
stems AS (SELECT DISTINCT query_id, {FOLD.format('word')} AS stem FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[\s?!.,]'), lambda w: strlen(w) > 1)) AS word FROM queries)),
counts AS (SELECT stem, count(DISTINCT part) AS n FROM (SELECT DISTINCT stem FROM stems) LEFT JOIN part_index ON key = stem GROUP BY stem)"""
RARITY = "1.0 / (1.0 + n / greatest((SELECT count(*) FROM parts), 1) + ln(n + 1.0))"
ROUTES = f"""scored AS (SELECT query_id, part, sum({RARITY}) AS score FROM stems JOIN counts USING (stem) JOIN part_index ON key = stem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, part) AS rank FROM scored),
routes AS (SELECT query_id, part, score, rank FROM ranked WHERE rank <= 15)"""
KEYWORD_TAGS = f"""keywords AS (SELECT * FROM (VALUES {_values(KEYWORDS)}) q(query_id, query)),
said AS (SELECT query_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT query_id, {WORDS.format('query')} AS ws FROM keywords)),
heavy AS (SELECT word, 1.0 / (1.0 + n / greatest((SELECT count(*) FROM parts), 1) + ln(n + 1.0)) AS a
  FROM (SELECT word, count(DISTINCT part) AS n FROM (SELECT DISTINCT word FROM said) LEFT JOIN part_index ON key = {FOLD.format('word')} GROUP BY word)),
synonyms AS (SELECT * FROM (VALUES {_values(tuple((g, a) for given, asked in SYNONYMS for g in given for a in asked))}) s(word, other)),
wanted AS (SELECT query_id, word AS tag, 2 * pos AS ord, true AS is_word, a FROM said JOIN heavy USING (word)
  UNION ALL SELECT query_id, other, 2 * pos + 1, false, a * 0.8 FROM said JOIN heavy USING (word) JOIN synonyms USING (word)),
summed AS (SELECT query_id, tag, coalesce(sum(a) FILTER (is_word), 0.0) + CASE WHEN arg_min(is_word, ord) THEN 0.0 ELSE arg_min(a, ord) END AS a FROM wanted GROUP BY ALL),
query_tags AS (SELECT query_id, tag, a / max(a) OVER (PARTITION BY query_id) AS weight FROM summed)"""
SEEDS = """seeds AS (SELECT query_id, part, node_id, least(1.0, sum(t.weight * q.weight)) AS act FROM tags t JOIN query_tags q USING (tag) GROUP BY ALL HAVING sum(t.weight * q.weight) > 0.05)"""


def _step(before: str, after: str) -> str:
    return f"""{after} AS (SELECT query_id, part, node_id, greatest(0.0, least(1.0, sum(act))) AS act FROM (
    SELECT query_id, part, node_id, act * 0.95 AS act FROM {before}
    UNION ALL SELECT query_id, dst_part, dst_id, act * weight FROM {before} JOIN edges ON src_part = part AND src_id = node_id WHERE act > 0.05) GROUP BY ALL)"""


ACTIVE = ",\n".join((
    SEEDS, _step("seeds", "once"), _step("once", "twice"),
    "active AS (SELECT query_id, part, node_id, act FROM twice WHERE act > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, part, node_id) <= 20)",
))
SPREAD = ",\n".join((_graph(), PART_NAMES, PART_INDEX, KEYWORD_TAGS, ACTIVE))

SUPPLY = """edges AS (SELECT 'supplier' AS src_part, l_suppkey AS src_id, 'part' AS dst_part, l_partkey AS dst_id,
  round(avg(l_discount) * 400) / 100.0 AS weight, count(*) FILTER (l_returnflag = 'R') AS co_firings FROM lineitem GROUP BY ALL)"""
CHUNK_PAIRS = """placed AS (SELECT c.doc_id, c.pos, n.node_id FROM chunks c JOIN nodes n ON n.part = c.part AND n.content = c.chunk),
pairs AS (SELECT DISTINCT a.node_id AS src_id, b.node_id AS dst_id FROM placed a JOIN placed b USING (doc_id) WHERE a.pos = 0)"""
CLUSTERS = """both_ways AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE weight > 0.30 UNION SELECT dst_id, src_id FROM edges WHERE weight > 0.30),
found(node_id, cluster) USING KEY (node_id) AS (SELECT a, a FROM both_ways
  UNION (SELECT e.b, min(f.cluster) FROM found f JOIN both_ways e ON e.a = f.node_id JOIN recurring.found r ON r.node_id = e.b WHERE f.cluster < r.cluster GROUP BY e.b)),
sizes AS (SELECT cluster, count(*) AS size FROM found GROUP BY cluster HAVING count(*) >= 3),
tag_weights AS (SELECT cluster, tag, sum(weight) AS weight FROM tags JOIN found USING (node_id) GROUP BY ALL),
named AS (SELECT cluster, size, tag FROM sizes LEFT JOIN tag_weights USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 9) DESC, tag) = 1),
renamed AS (SELECT cluster, size, CASE WHEN tag IN ('mozilla', 'hoare', 'servo') THEN 'rust_history' ELSE coalesce(tag, 'part_' || cluster) END AS new_part FROM named)"""
HEADED = rf"""split AS (SELECT coalesce(ls[1], '') AS path, page_no, ls FROM (SELECT doc_id AS page_no, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS ls FROM documents)),
lines AS (SELECT path, page_no, unnest(ls) AS line, unnest(range(len(ls))) AS line_no, len(ls) AS n FROM split)"""
LINES = rf"""split AS (SELECT source AS path, doc_id AS page_no, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT path, page_no, unnest(ls) AS line, unnest(range(len(ls))) AS line_no, len(ls) AS n FROM split)"""
RUNNING = """page_count AS (SELECT path, count(DISTINCT page_no) AS pages FROM split GROUP BY path),
edge_lines AS (SELECT path, line, count(DISTINCT page_no) AS n_pages FROM lines WHERE line_no < 2 OR n - line_no <= 2 GROUP BY ALL),
running AS (SELECT path, line, n_pages FROM edge_lines JOIN page_count USING (path) WHERE pages >= 2 AND n_pages >= greatest(2, ceil(0.3 * pages)))"""
IS_NUMBER = r"((regexp_matches(line, '^[0-9\s/-]*[0-9][0-9\s/-]*$') AND strlen(line) <= 10) OR regexp_matches(lower(line), '^(sayfa|page)'))"
IS_CONTENTS = "(contains(line, '..') OR length(regexp_replace(line, '[^.]', '', 'g')) >= 5)"
IS_COLLAPSED = r"""((strlen(line) < 3 AND NOT regexp_matches(line, '^[\p{L}\p{N}]*$')) OR length(regexp_replace(line, '[\p{L}\p{N}\s''.,?!\-+*/=]', '', 'g')) / strlen(line) > 0.35)"""
BARE = r"regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')"


def _votes(words: tuple) -> str:
    return f"sum(len(list_filter(ws, lambda w: list_contains([{', '.join(repr(x) for x in words)}], w))))::BIGINT"


def _title(column: str) -> str:
    plain = f"translate(translate(replace(lower({column}), 'i̇', 'i'), '{T.FOLD_FROM}', '{T.FOLD_TO}'), ' -', '__')"
    return f"regexp_replace(regexp_replace(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


_VOWELS = "aeıioöuüAEIİOÖUÜ"


def _harmony(words: str, name: str) -> str:
    """CTE of each word of words (word): its vowels, link letters and softened form."""
    return rf"""{name} AS (SELECT *, CASE WHEN vowel IN ('a', 'ı') THEN 'ı' WHEN vowel IN ('o', 'u') THEN 'u' WHEN vowel IN ('ö', 'ü') THEN 'ü' ELSE 'i' END AS narrow,
    CASE WHEN vowel IN ('a', 'ı', 'o', 'u') THEN 'a' ELSE 'e' END AS wide, left(word, length(word) - 1) || translate(right(word, 1), 'ktpç', 'ğdbc') AS soft
  FROM (SELECT word, CASE WHEN {LOWER_TR.format("word")} = 'rust' THEN 'a' WHEN {LOWER_TR.format("word")} = 'wgpu' THEN 'u'
      ELSE coalesce(nullif(translate(regexp_extract(word, '([{_VOWELS}])[^{_VOWELS}]*$', 1), 'AEIİOÖUÜ', 'aeıioöuü'), ''), 'e') END AS vowel,
    regexp_matches(word, '[{_VOWELS}]$') AS open_end, CASE WHEN regexp_matches(word, '[fstkçşhpFSTKÇŞHP]$') THEN 't' ELSE 'd' END AS dental,
    regexp_matches(word, '^\p{{Lu}}|\p{{N}}|[wqxWQX]') AS name, length(regexp_replace(word, '[^{_VOWELS}]', '', 'g')) AS syllables FROM ({words})))"""


def _cased(ending: str, h: str = "h") -> str:
    """with_case of h's word."""
    suffix = f"""CASE {ending} WHEN '-i' THEN CASE WHEN {h}.open_end THEN 'y' ELSE '' END || {h}.narrow WHEN '-e' THEN CASE WHEN {h}.open_end THEN 'y' ELSE '' END || {h}.wide
    WHEN '-de' THEN {h}.dental || {h}.wide WHEN '-den' THEN {h}.dental || {h}.wide || 'n' WHEN '-in' THEN CASE WHEN {h}.open_end THEN 'n' ELSE '' END || {h}.narrow || 'n'
    WHEN '-ler' THEN 'l' || {h}.wide || 'r' ELSE '' END"""
    return f"""CASE WHEN {h}.word = '' THEN '' WHEN {h}.name THEN {h}.word || chr(39) || {suffix} ELSE CASE WHEN {ending} IN ('-i', '-e', '-in') AND NOT {h}.open_end THEN {h}.soft ELSE {h}.word END || {suffix} END"""


def _tensed(ending: str, h: str = "h") -> str:
    """with_tense of h's word."""
    return f"""CASE {ending} WHEN '-meli' THEN {h}.word || CASE {h}.wide WHEN 'a' THEN 'malı' ELSE 'meli' END WHEN '-di' THEN {h}.word || {h}.dental || {h}.narrow
    ELSE CASE WHEN regexp_matches({h}.word, '[aeıioöuü]$') THEN {h}.word || 'r' WHEN {h}.word = 'et' THEN 'eder'
      ELSE {h}.word || CASE WHEN {h}.syllables > 1 OR {h}.word IN ('et', 'al', 'ver', 'bul', 'gel', 'gör', 'kal', 'ol', 'dur', 'vur') THEN {h}.narrow ELSE {h}.wide END || 'r' END END"""


_CAPITAL = "replace(upper(left({0}, 1)), 'ẞ', 'SS') || substr({0}, 2)"
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g'), '(?s)<[^>]*(>|\z)|>', '', 'g'), '\s+', ' ', 'g')"

FILE_STEM = r"translate(regexp_replace(regexp_replace(lower(p_name || '.txt'), '\.[^.]*$', ''), '^rust_', ''), ' ', '_')"
FILE_NAME = f"regexp_replace(regexp_replace(regexp_replace({FILE_STEM}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


def _strengthened(before: str, after: str, query_id: int) -> str:
    now = f"(SELECT part, node_id, act FROM active WHERE query_id = {query_id})"
    return f"""{after} AS (SELECT src_part, src_id, dst_part, dst_id,
  CASE WHEN a IS NULL THEN weight ELSE greatest(0.0, least(1.0, weight + 0.1 * a * b - 0.02 * weight)) END AS weight, co_firings + CASE WHEN a > 0.3 AND b > 0.3 THEN 1 ELSE 0 END AS co_firings
  FROM (SELECT e.*, s.act AS a, coalesce(d.act, 0) AS b FROM {before} e LEFT JOIN {now} s ON s.part = src_part AND s.node_id = src_id AND s.act > 0.05
    LEFT JOIN {now} d ON d.part = dst_part AND d.node_id = dst_id))"""


STRENGTHENED = ",\n".join(_strengthened(f"round{k}" if k else "edges", f"round{k + 1}", q) for k, (q, _) in enumerate(KEYWORDS))

STATS = f"""stats AS (SELECT word, count(*)::DOUBLE AS freq, sum(n) / 10.0 AS edge_weight
  FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents) GROUP BY ALL) GROUP BY word HAVING count(*) >= 3)"""
NO_STATS = "stats AS (SELECT NULL::VARCHAR AS word, NULL::DOUBLE AS freq, NULL::DOUBLE AS edge_weight WHERE false)"
TOKENS = f"tokens AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS word FROM documents)"
HARD = "left({0}, length({0}) - 1) || translate(right({0}, 1), 'ğdbc', 'ktpç')"
SHORTER = HARD.format("left(stem, length(stem) - length(e))")
LOW = LOWER_TR.format("stem")
LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
#: One ending comes off in each round: the first that leaves a valid stem.
STEMS = f"""endings AS (SELECT * FROM (VALUES {_values(tuple((k, s, e) for k, (s, e) in enumerate(ENDINGS)))}) x(k, s, e)),
stemming AS (SELECT word, word AS stem, '' AS suffix, false AS ended, 0 AS round FROM tokens WHERE NOT contains(word, chr(39))
  UNION ALL SELECT word, best.shorter, CASE WHEN suffix = '' THEN best.s ELSE suffix END, freq > 0, round + 1
  FROM (SELECT t.word, t.suffix, t.round, coalesce(a.freq, 0) AS freq, arg_min({{'shorter': t.shorter, 's': t.s}}, t.k) AS best
    FROM (SELECT *, {LOW} AS low, {SHORTER} AS shorter FROM stemming JOIN endings ON ends_with({LOW}, e) AND length(stem) >= length(e) + 3
      AND (length(e) > 1 OR ((SELECT count(*) FROM stats) > 0 AND right({LOW}, 2) NOT IN ({LISTED(WHOLE_ENDINGS)}))) WHERE NOT ended) t
    LEFT JOIN stats a ON a.word = t.low LEFT JOIN stats b ON b.word = {LOWER_TR.format("t.shorter")}
    WHERE coalesce(a.freq, 0) <= 0 OR (coalesce(b.freq, 0) > 0 AND coalesce(a.edge_weight, 0) <= 2 * coalesce(b.edge_weight, 0)) GROUP BY t.word, t.suffix, t.round, a.freq)),
quoted AS (SELECT word, split_part(word, chr(39), 1) AS stem, substr(word, strpos(word, chr(39)) + 1) AS rest FROM tokens WHERE contains(word, chr(39))),
nouns AS (SELECT word, arg_max(stem, round) AS stem, arg_max(suffix, round) AS suffix FROM stemming GROUP BY word UNION ALL SELECT word, stem,
  CASE WHEN regexp_matches(rest, 'da|de|ta|te') THEN '-de' WHEN regexp_matches(rest, 'dan|den|tan|ten') THEN '-den' WHEN regexp_matches(rest, 'in|ın|un|ün') THEN '-in'
    WHEN regexp_matches(rest, 'i|ı|u|ü') THEN '-i' WHEN regexp_matches(rest, 'e|a') THEN '-e' ELSE '' END FROM quoted)"""
VERBS = f"""verb_stems AS (SELECT * FROM (VALUES {_values(tuple(enumerate(VERB_STEMS)))}) v(k, verb)),
lowered AS (SELECT word, {LOWER_TR.format('word')} AS low FROM tokens),
begun AS (SELECT word, low, k, verb, CASE WHEN verb = 'et' AND starts_with(low, 'ed') THEN 'ed' ELSE verb END AS begins FROM lowered JOIN verb_stems
  ON starts_with(low, CASE WHEN verb = 'et' AND starts_with(low, 'ed') THEN 'ed' ELSE verb END)),
tensed AS (SELECT word, low, k, verb, length(begins) AS size, substr(low, length(begins) + 1) AS rest FROM begun),
tried AS (SELECT word, low, k, verb, size, CASE WHEN rest = '' THEN '-r' WHEN regexp_matches(rest, 'meli|malı') THEN '-meli' WHEN regexp_matches(rest, '[dt][iıuü]') THEN '-di'
  WHEN regexp_matches(rest, 'm[ea]k') THEN '-mek' WHEN contains(rest, 'r') THEN '-r' END AS tense FROM tensed),
longest AS (SELECT t.word, max(length(s.word)) AS longest FROM (SELECT DISTINCT word, low, unnest(list_transform(range(1, length(low) + 1), lambda n: left(low, n))) AS head FROM tried WHERE tense IS NOT NULL) t
  JOIN stats s ON s.word = t.head GROUP BY t.word),
verbs AS (SELECT word, arg_min(verb, k) AS verb, arg_min(tense, k) AS tense FROM tried LEFT JOIN longest USING (word) WHERE tense IS NOT NULL AND (longest IS NULL OR longest <= size) GROUP BY word)"""
BARE_WORD = r"regexp_replace(w, '^[!-&(-/:-@\\^-`{-~]+|[!-&(-/:-@\\^-`{-~]+$', '', 'g')"
SPOKEN = rf"""spoken AS (SELECT chunk, {TRIM.format('chunk')} AS plain FROM (SELECT DISTINCT chunk FROM chunks)),
kinds AS (SELECT chunk, plain, list_filter(list_transform(regexp_split_to_array(plain, '\s+'), lambda w: {BARE_WORD}), lambda w: w <> '') AS ws,
  CASE WHEN {KIND.replace(TRIMMED, 'plain')} IN ('Operator', 'Equation') OR contains(plain, '=') THEN 'whole' WHEN {KIND.replace(TRIMMED, 'plain')} = 'Code' THEN 'code' ELSE 'words' END AS kind FROM spoken),
placed AS (SELECT chunk, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM kinds WHERE kind = 'words'),
tokens AS (SELECT DISTINCT word FROM placed)"""
CONCEPTS = f"""called AS (SELECT *, {LOWER_TR.format('word')} IN ({LISTED(CONNECTIVES)}) AS joins FROM placed LEFT JOIN verbs USING (word) LEFT JOIN nouns USING (word)),
slots AS (SELECT chunk, pos, CASE WHEN joins THEN NULL WHEN verb IS NOT NULL THEN '[' || verb || ']' ELSE stem END AS concept,
  CASE WHEN joins THEN {LOWER_TR.format('word')} WHEN verb IS NOT NULL THEN '{T.VERB}' || tense
    ELSE CASE WHEN pos = min(pos) FILTER (NOT joins AND verb IS NULL) OVER (PARTITION BY chunk) THEN '{T.SUBJECT}' ELSE '{T.OBJECT}' END || suffix END AS slot FROM called),
once AS (SELECT chunk, concept, min(pos) AS pos FROM slots WHERE concept IS NOT NULL GROUP BY ALL),
concept_lists AS (SELECT chunk, list(concept ORDER BY pos) AS concepts FROM once GROUP BY chunk),
templates AS (SELECT chunk, string_agg(slot, ' + ' ORDER BY pos) AS template FROM slots GROUP BY chunk),
split AS (SELECT chunk, CASE kind WHEN 'whole' THEN [plain] WHEN 'code' THEN ws ELSE coalesce(concepts, []) END AS concepts, coalesce(template, '') AS template
  FROM kinds LEFT JOIN concept_lists USING (chunk) LEFT JOIN templates USING (chunk))"""


def _concept_graph(order: str = "text") -> str:
    """CTEs up to cnodes(part, node_id, content, kind) and cedges."""
    kept = "" if order == "wiki" else "WHERE template <> ''"
    said = "" if order == "wiki" else "UNION ALL SELECT 'core_language', template, place, 'template' FROM texts WHERE template <> ''"
    return f"""{_chunks(DOCS)}, {STATS}, {SPOKEN}, {STEMS}, {VERBS}, {CONCEPTS},
texts AS (SELECT c.*, concepts, template FROM chunks c JOIN split USING (chunk)),
terms AS (SELECT doc_id, pos, part, place, unnest(concepts) AS concept, unnest(range(len(concepts))) AS rank FROM texts {kept}),
contents AS (SELECT part, chunk AS content, place, 'chunk' AS kind FROM chunks UNION ALL SELECT part, concept, place + least(rank + 1, 127), 'concept' FROM terms {said}),
cnodes AS (SELECT part, content, min(place) AS node_id, arg_min(kind, (place, kind)) AS kind FROM contents GROUP BY ALL),
named AS (SELECT t.*, node_id, starts_with(concept, '[') AND ends_with(concept, ']') AND length(concept) > 1 AS is_verb FROM terms t JOIN cnodes n ON n.part = t.part AND n.content = t.concept),
ruled AS (SELECT *, lag(node_id) OVER (PARTITION BY doc_id, pos ORDER BY rank) AS before, arg_min(node_id, rank) FILTER (is_verb) OVER (PARTITION BY doc_id, pos) AS verb_id,
  min(rank) FILTER (NOT is_verb) OVER (PARTITION BY doc_id, pos) AS first_noun FROM named),
stepped AS (SELECT c.doc_id, c.pos, c.place, n.part, n.node_id, lag(n.part) OVER w AS src_part, lag(n.node_id) OVER w AS src_id
  FROM chunks c JOIN cnodes n ON n.part = c.part AND n.content = c.chunk WINDOW w AS (PARTITION BY c.doc_id ORDER BY c.pos)),
fired AS (SELECT part AS src_part, before AS src_id, part AS dst_part, node_id AS dst_id, 0.85 AS weight, 'Sequential' AS edge_type, NULL::VARCHAR AS role, place, 1 AS phase, rank FROM ruled WHERE before IS NOT NULL
  UNION ALL SELECT part, node_id, part, verb_id, 0.8, 'Semantic', CASE WHEN rank = first_noun THEN '{T.ROLE_SUBJECT}' ELSE '{T.ROLE_OBJECT}' END, place, 2, rank FROM ruled WHERE NOT is_verb AND verb_id IS NOT NULL
  UNION ALL SELECT src_part, src_id, part, node_id, 0.85, 'Sequential', NULL, place, {0 if order == "wiki" else 3}, 0 FROM stepped WHERE src_id IS NOT NULL),
cedges AS (SELECT src_part, src_id, dst_part, dst_id, arg_max(weight, (place, phase, rank))::DOUBLE AS weight, 0::BIGINT AS co_firings, arg_max(edge_type, (place, phase, rank)) AS edge_type,
  arg_max(role, (place, phase, rank)) FILTER (role IS NOT NULL) AS role FROM fired GROUP BY ALL)"""


SHOWN = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(content, '(?s)\{\{.*?\}\}', '', 'g'),
  repeat(chr(39), 3), ''), repeat(chr(39), 2), ''), ')|', ''), '(|', ''), chr(10), ' '), chr(13), ''), ' {2,}', ' ', 'g'), '^[ \t\n\r|*()\[\]{}]+|[ \t\n\r|*()\[\]{}]+$', '', 'g')"""
DOC_PATHS = """paths AS (SELECT c.doc_id, n.part, n.node_id, n.content, (c.pos + CASE c.pos % 4 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END) AS step
  FROM chunks c JOIN nodes n ON n.part = c.part AND n.content = c.chunk)"""


def _capped(text: str) -> str:
    """Runs of each ASCII sign cut to four; the tables have no runs of others."""
    out = rf"regexp_replace({text}, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')"
    for sign in "!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\'":
        quoted = sign.replace("'", "''")
        out = f"regexp_replace({out}, '[{chr(92)}{quoted}]{{5,}}', '{(quoted * 4).replace(chr(92), chr(92) * 2)}', 'g')"
    return out


ORACLE = {
    "chunk_sentences": f"WITH {_chunks(DOCS)} SELECT doc_id, pos, chunk FROM chunks",
    "word_counts_per_doc": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS word FROM documents) GROUP BY ALL",
    "node_kind_counts": f"SELECT {KIND} AS kind, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents) t(text) GROUP BY ALL",
    "part_name_from_title": f"SELECT page_id, CASE WHEN name = '' THEN 'general' ELSE name END AS part FROM (SELECT page_id, {_title('url')} AS name FROM pages)",
    "part_name_from_file": f"""SELECT p_partkey, CASE WHEN name LIKE '%ownership%' THEN 'ownership' WHEN name LIKE '%borrowing%' OR name LIKE '%reference%' THEN 'borrowing'
        WHEN name LIKE '%slice%' THEN 'slices' WHEN contains(name, 'guessing_game') THEN 'guessing_game' WHEN name = 'programming_language' THEN 'rust'
        WHEN name LIKE '%hellocargo%' THEN 'cargo' WHEN name LIKE '%helloworld%' THEN 'hello_world' WHEN contains(name, 'control_flow') THEN 'control_flow'
        WHEN contains(name, 'data_types') THEN 'data_types' WHEN name LIKE '%comments%' THEN 'comments' WHEN name LIKE '%functions%' THEN 'functions'
        WHEN contains(name, 'quantum_physics') THEN 'quantum' ELSE name END AS part FROM (SELECT p_partkey, {FILE_NAME} AS name FROM part)""",
    "html_plain": rf"""SELECT page_id, {TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|\z)', '', 'g'), '(?s)<[^>]*(>|\z)|>', '', 'g'), '\s+', ' ', 'g')")} AS plain FROM pages""",
    "dedupe_first_content": f"WITH {_chunks(DOCS)}, {NODES} SELECT part, node_id, content, {KIND.replace('text', 'content')} AS node_type FROM nodes",
    "dedupe_global": f"""WITH {_chunks(DOCS)}, firsts AS (SELECT chunk AS content, arg_min(part, place) AS part, min(place) AS node_id FROM chunks GROUP BY chunk)
        SELECT part, node_id, content, {KIND.replace('text', 'content')} AS node_type FROM firsts""",
    "sequence_edges": f"WITH {_graph()} SELECT * FROM edges",
    "conversation_steps": """WITH said AS (SELECT conv_id, turn, text, conv_id * 134217728 + turn * 128 AS place FROM conversations),
        placed AS (SELECT s.*, min(place) OVER (PARTITION BY text) AS node_id FROM said s)
        SELECT src_id, node_id AS dst_id, place FROM (SELECT *, lag(node_id) OVER (PARTITION BY conv_id ORDER BY turn) AS src_id FROM placed) WHERE src_id IS NOT NULL""",
    "node_tags": f"WITH {_graph()} SELECT part, tag, sum(weight) AS weight, count(*) AS nodes FROM tags GROUP BY ALL",
    "edge_upsert_last_writer": """SELECT 'supplier' AS src_part, l_suppkey AS src_id, 'part' AS dst_part, l_partkey AS dst_id,
        round(arg_max(greatest(0.0, least(1.0, l_quantity / 40.0)), (l_orderkey, l_linenumber, l_extendedprice, l_quantity)), 6) AS weight, 0::BIGINT AS co_firings,
        arg_max(CASE WHEN l_linestatus = 'O' THEN 'Sequential' ELSE 'Semantic' END, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS edge_type,
        arg_max(l_returnflag, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) FILTER (l_returnflag <> 'N') AS role FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "word_stats": f"""WITH {_graph()}, ends AS (SELECT part, node_id, sum(weight) AS w FROM (SELECT src_part AS part, src_id AS node_id, weight FROM edges UNION ALL SELECT dst_part, dst_id, weight FROM edges) GROUP BY ALL),
        spelled AS (SELECT part, node_id, {LOWER_TR.format('content')} AS word FROM nodes UNION SELECT part, node_id, content FROM nodes)
        SELECT word, count(*)::DOUBLE AS freq, round(coalesce(sum(w), 0.0), 6) AS edge_weight FROM spelled LEFT JOIN ends USING (part, node_id) GROUP BY word""",
    "document_frequency": f"WITH {PART_NAMES}, {PART_INDEX}, {ROUTING_STEMS} SELECT stem, n FROM counts",
    "query_idf": f"WITH {PART_NAMES}, {PART_INDEX}, {KEYWORD_TAGS} SELECT query_id, tag, round(weight, 6) AS weight FROM query_tags",
    "route_parts_topk": f"""WITH {PART_NAMES}, {PART_INDEX}, {ROUTING_STEMS}, {ROUTES} SELECT query_id, part, round(score, 6) AS score, rank FROM routes
        UNION ALL SELECT query_id, 'general', 0.0, 1 FROM queries WHERE query_id NOT IN (SELECT query_id FROM routes)""",
    "seed_activation": f"WITH {_graph()}, {PART_NAMES}, {PART_INDEX}, {KEYWORD_TAGS}, {SEEDS} SELECT query_id, part, node_id, round(act, 6) AS act FROM seeds",
    "propagate_two_steps_top20": f"WITH {SPREAD} SELECT query_id, part, node_id, content, round(act, 6) AS act FROM active JOIN nodes USING (part, node_id)",
    "part_wide_activation": f"""WITH {SPREAD}, {ROUTING_STEMS}, {ROUTES},
        wide AS (SELECT query_id, part, node_id, max(act) AS act FROM (SELECT * FROM active UNION ALL SELECT query_id, part, node_id, 1.0 FROM routes JOIN nodes USING (part)) GROUP BY ALL)
        SELECT query_id, part, count(*) AS nodes, round(sum(act), 4) AS act FROM wide GROUP BY ALL""",
    "hebbian_update": f"WITH {SPREAD}, {STRENGTHENED} SELECT src_part, src_id, dst_part, dst_id, round(weight, 6) AS weight, co_firings FROM round{len(KEYWORDS)}",
    "hebbian_new_pairs": f"""WITH {SPREAD}, hot AS (SELECT query_id, part, node_id FROM active WHERE act > 0.4)
        SELECT u.query_id, u.part AS src_part, u.node_id AS src_id, v.part AS dst_part, v.node_id AS dst_id, 0.15::DOUBLE AS weight
        FROM hot u JOIN hot v ON u.query_id = v.query_id AND (u.part <> v.part OR u.node_id <> v.node_id)
        WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src_part = u.part AND src_id = u.node_id AND dst_part = v.part AND dst_id = v.node_id)""",
    "maintenance_plasticity": f"""WITH {SUPPLY}, after AS (SELECT * REPLACE (CASE WHEN co_firings > 0 THEN least(1.0, weight + 0.1 * co_firings) ELSE weight - 0.05 END AS weight) FROM edges)
        SELECT src_part, src_id, dst_part, dst_id, round(weight, 6) AS weight, 0::BIGINT AS co_firings FROM after WHERE weight >= 0.15""",
    "maintenance_counts": f"""WITH {SUPPLY} SELECT count(*) FILTER (co_firings > 0) AS consolidated, count(*) FILTER (co_firings = 0) AS decayed,
        count(*) FILTER (CASE WHEN co_firings > 0 THEN least(1.0, weight + 0.1 * co_firings) ELSE weight - 0.05 END < 0.15) AS pruned FROM edges""",
    "components_strong_edges": """WITH RECURSIVE ends AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
        both_ways AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
        SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a""",
    "document_clusters": f"WITH RECURSIVE {_graph(ONE_PART)}, {CLUSTERS} SELECT cluster, size, new_part FROM renamed",
    "auto_partition_best_tag": f"WITH RECURSIVE {_graph(ITEMS)}, {CLUSTERS} SELECT cluster, size, new_part FROM renamed",
    "repartition_counts": f"""WITH RECURSIVE {_graph(ONE_PART)}, {CLUSTERS} SELECT coalesce(new_part, part) AS part, count(*) AS nodes
        FROM nodes LEFT JOIN found USING (node_id) LEFT JOIN renamed USING (cluster) GROUP BY ALL""",
    "clusters_after_sleep": f"""WITH RECURSIVE {SUPPLY}, slept AS (SELECT *, CASE WHEN co_firings > 0 THEN least(1.0, weight + 0.1 * co_firings) ELSE weight - 0.05 END AS after FROM edges),
        strong AS (SELECT 'p' || l_id AS a, 's' || s_id AS b FROM (SELECT lpad(dst_id::VARCHAR, 12, '0') AS l_id, lpad(src_id::VARCHAR, 12, '0') AS s_id FROM slept WHERE after > {SLEEP_WEIGHT})),
        both_ways AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
        found(node, cluster) USING KEY (node) AS (SELECT a, a FROM both_ways
          UNION (SELECT e.b, min(f.cluster) FROM found f JOIN both_ways e ON e.a = f.node JOIN recurring.found r ON r.node = e.b WHERE f.cluster < r.cluster GROUP BY e.b))
        SELECT CASE left(node, 1) WHEN 'p' THEN 'part' ELSE 'supplier' END AS part, substr(node, 2)::BIGINT AS node_id,
          CASE left(cluster, 1) WHEN 'p' THEN 'part' ELSE 'supplier' END AS cluster_part, substr(cluster, 2)::BIGINT AS cluster_id FROM found""",
    "evict_lowest_part": f"""WITH {SPREAD}, {ROUTING_STEMS}, {ROUTES}, resident AS (SELECT DISTINCT part FROM nodes),
        total AS (SELECT part, coalesce(sum(greatest(act - 0.05, 0)), 0.0) AS act FROM resident LEFT JOIN active USING (part) GROUP BY part)
        SELECT part, round(act, 6) AS act FROM total WHERE part NOT IN (SELECT part FROM routes WHERE query_id = 1) AND (SELECT count(*) FROM resident) > 18 ORDER BY round(act, 9), part LIMIT 1""",
    "language_vote": rf"""WITH bare AS (SELECT lang || '_' || source AS part, list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: {BARE}) AS ws FROM documents),
        votes AS (SELECT part, {_votes(T.ENGLISH_WORDS)} AS english, {_votes(T.TURKISH_WORDS)} AS turkish FROM bare GROUP BY part)
        SELECT *, CASE WHEN english > turkish THEN 'en' ELSE 'tr' END AS lang FROM votes""",
    "answer_mode": rf"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(\[det\]|!)|[-+*/=<>%]|{'|'.join(T.FACT_WORDS + T.TECHNICAL_WORDS)}') THEN 'deterministic' ELSE 'creative' END AS mode FROM conversations",
    "reachable_within_3": f"""WITH {_graph()}, {CHUNK_PAIRS}, starts AS (SELECT DISTINCT src_id AS a FROM pairs),
        h0 AS (SELECT a, a AS b FROM starts), h1 AS (SELECT DISTINCT a, dst_id AS b FROM h0 JOIN edges ON src_id = b), h2 AS (SELECT DISTINCT a, dst_id AS b FROM h1 JOIN edges ON src_id = b),
        h3 AS (SELECT DISTINCT a, dst_id AS b FROM h2 JOIN edges ON src_id = b),
        near AS (SELECT a, b, min(h)::INTEGER AS hops FROM (SELECT *, 0 AS h FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY a, b)
        SELECT src_id, dst_id, hops FROM pairs JOIN near ON a = src_id AND b = dst_id""",
    "tag_overlap_pairs": f"""WITH {_graph()}, {CHUNK_PAIRS}, shared AS (SELECT src_id, dst_id, sum(least(a.weight, b.weight)) AS overlap FROM pairs JOIN tags a ON a.node_id = src_id JOIN tags b ON b.node_id = dst_id AND b.tag = a.tag GROUP BY ALL)
        SELECT src_id, dst_id, coalesce(overlap, 0.0) AS overlap FROM pairs LEFT JOIN shared USING (src_id, dst_id)""",
    "wiki_pages": rf"""WITH clean AS (SELECT page_id, url AS title, CASE WHEN name = '' THEN 'general' ELSE name END AS part, {TRIM.format(PLAIN)} AS text
        FROM (SELECT *, {_title('url')} AS name FROM pages) WHERE NOT contains(upper(html), '#REDIRECT') AND NOT contains(upper(html), '#YÖNLENDİRME'))
        SELECT part, title, text FROM clean WHERE strlen(text) >= 100 QUALIFY row_number() OVER (PARTITION BY part ORDER BY page_id DESC) = 1""",
    "template_nodes": f"""WITH RECURSIVE {_concept_graph()} SELECT part, node_id, content FROM cnodes
        WHERE contains(content, ' + ') OR contains(content, '{T.SUBJECT}') OR contains(content, '{T.OBJECT}') OR contains(content, '{T.VERB}')""",
    "finished_sentences": rf"""WITH {_chunks(DOCS)}, said AS (SELECT DISTINCT chunk AS sentence, list_filter(regexp_split_to_array(chunk, '\s+'), lambda w: w <> '') AS ws FROM chunks),
        lasts AS (SELECT sentence, ws, {BARE.replace('(w,', '(ws[-1],')} AS word FROM said), {_harmony("SELECT DISTINCT word FROM lasts", "h")},
        spoken AS (SELECT sentence, 'en' AS lang, sentence AS full_text FROM said UNION ALL SELECT sentence, 'tr', CASE WHEN word <> '' AND NOT regexp_matches(word, '(d|t)[iıuü]r$') AND word NOT IN ({LISTED(VERB_STEMS)})
          THEN array_to_string(list_append(ws[:-2], word || dental || narrow || 'r'), ' ') ELSE sentence END FROM lasts JOIN h USING (word))
        SELECT sentence, lang, {_CAPITAL.format("full_text")} || CASE WHEN regexp_matches(full_text, '[.!?]$') THEN '' ELSE '.' END AS finished FROM spoken""",
    "template_sentences": rf"""WITH RECURSIVE {_chunks(DOCS)}, {STATS}, {SPOKEN}, {STEMS}, {VERBS}, {CONCEPTS},
        langs AS (SELECT unnest(['tr', 'en']) AS lang),
        word_lists AS (SELECT chunk, template, list_filter(concepts, lambda c: NOT (starts_with(c, '[') AND ends_with(c, ']') AND length(c) > 1)) AS nouns,
          list_transform(list_filter(concepts, lambda c: starts_with(c, '[') AND ends_with(c, ']') AND length(c) > 1), lambda c: c[2:-2]) AS verbs, string_split(template, '+') AS ps FROM split WHERE template <> ''),
        said_parts AS (SELECT chunk, template, nouns, verbs, trim(unnest(ps)) AS part, unnest(range(len(ps))) AS k FROM word_lists),
        slots_of AS (SELECT *, regexp_extract(part, '^\[(Özne|Nesne|Eylem)\]', 1) AS slot, regexp_extract(part, '-(.*)$', 0) AS ending FROM said_parts),
        counted AS (SELECT *, count(*) OVER (PARTITION BY chunk, slot ORDER BY k) - 1 AS j, len(nouns) AS n FROM slots_of),
        chosen AS (SELECT *, CASE slot WHEN 'Özne' THEN nouns[1] WHEN 'Nesne' THEN CASE WHEN j < n THEN nouns[n - j] WHEN j - n + 1 < n THEN nouns[j - n + 2] ELSE 'veri' END
          WHEN 'Eylem' THEN coalesce(verbs[j + 1], 'sağla') ELSE part END AS word FROM counted), {_harmony("SELECT DISTINCT word FROM chosen", "h")},
        worded AS (SELECT chunk, template, lang, k, CASE WHEN slot IN ('Özne', 'Nesne') AND lang = 'tr' AND ending <> '' THEN {_cased("ending")}
          WHEN slot = 'Eylem' AND lang = 'tr' THEN {_tensed("CASE ending WHEN '' THEN '-r' ELSE ending END")} ELSE h.word END AS word FROM chosen JOIN h USING (word), langs),
        joined AS (SELECT chunk, template, lang, string_agg(word, ' ' ORDER BY k) AS s FROM worded GROUP BY ALL)
        SELECT chunk, template, lang, CASE WHEN s = '' THEN '' ELSE {_CAPITAL.format("s")} || '.' END AS sentence FROM joined""",
    "sequence_heads": f"""WITH RECURSIVE {_graph()}, before AS (SELECT dst_part AS part, dst_id AS v, min(src_id) AS u FROM edges WHERE src_id <> dst_id GROUP BY ALL),
        reach AS (SELECT v AS s, u AS n FROM before UNION SELECT s, u FROM reach JOIN before ON n = v),
        round_again AS (SELECT s FROM reach WHERE s = n), cut AS (SELECT s FROM reach WHERE s IN (SELECT s FROM round_again) GROUP BY s HAVING min(n) = s),
        ends AS (SELECT src_part AS part, src_id AS id FROM edges UNION SELECT dst_part, dst_id FROM edges),
        way AS (SELECT part, id AS s, id AS n, 0::BIGINT AS steps FROM ends UNION ALL SELECT way.part, s, u, steps + 1 FROM way JOIN before ON n = v WHERE n NOT IN (SELECT s FROM cut))
        SELECT part, s AS node_id, part AS head_part, arg_max(n, steps) AS head_id, max(steps) AS steps FROM way GROUP BY part, s""",
    "bare_words": rf"""SELECT word, count(*) AS n FROM (SELECT {BARE_WORD} AS word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)) WHERE word <> '' GROUP BY word""",
    "loaded_parts": f"WITH {_chunks(DOCS)}, {NODES} SELECT part, node_id, content, {KIND.replace('text', 'content')} AS node_type FROM nodes WHERE part IN {LOADED}",
    "store_in_two_steps": f"""WITH {_chunks(DOCS)}, both_steps AS (SELECT part, chunk AS content, coalesce(min(place) FILTER (doc_id % 2 = 0), min(place)) AS node_id FROM chunks GROUP BY ALL)
        SELECT part, node_id, content, {KIND.replace('text', 'content')} AS node_type FROM both_steps""",
    "routed_chunks": rf"""WITH RECURSIVE {_chunks(DOCS)}, {NO_STATS}, {PART_NAMES}, {PART_INDEX},
        asked AS (SELECT DISTINCT place, {FOLD.format('word')} AS word FROM (SELECT place, unnest(list_filter(regexp_split_to_array(lower(chunk), '[\s?!.,]'), lambda w: strlen(w) > 1)) AS word FROM chunks)),
        tokens AS (SELECT DISTINCT word FROM asked), {STEMS}, stems AS (SELECT DISTINCT place, {FOLD.format('stem')} AS stem FROM asked JOIN nouns USING (word) WHERE stem <> ''),
        counts AS (SELECT stem, count(DISTINCT part) AS n FROM (SELECT DISTINCT stem FROM stems) LEFT JOIN part_index ON key = stem GROUP BY stem),
        scored AS (SELECT place, part, sum({RARITY}) AS score FROM stems JOIN counts USING (stem) JOIN part_index ON key = stem GROUP BY ALL),
        best AS (SELECT place, part FROM scored QUALIFY row_number() OVER (PARTITION BY place ORDER BY round(score, 9) DESC, part) = 1)
        SELECT doc_id, pos, coalesce(b.part, 'general') AS part FROM chunks LEFT JOIN best b USING (place)""",
    "running_lines": f"WITH {HEADED}, {RUNNING} SELECT path, line, n_pages FROM running",
    "running_page_text": f"""WITH {HEADED}, {RUNNING}, good AS (SELECT path, page_no, line_no, {_capped('line')} AS line FROM lines
        WHERE NOT {IS_NUMBER} AND NOT {IS_CONTENTS} AND NOT {IS_COLLAPSED} AND (path, line) NOT IN (SELECT (path, line) FROM running)),
        texts AS (SELECT path, page_no, string_agg(line || ' ', '' ORDER BY line_no) AS text FROM good WHERE {TRIM.format('line')} <> '' GROUP BY ALL)
        SELECT path, page_no, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest FROM split LEFT JOIN texts USING (path, page_no)""",
    "cap_symbol_runs": f"SELECT doc_id, {_capped('text')} AS text FROM documents",
    "stem_tokens": f"WITH RECURSIVE {STATS}, {TOKENS}, {STEMS} SELECT word, stem, suffix FROM nouns",
    "stem_tokens_without_stats": f"WITH RECURSIVE {NO_STATS}, {TOKENS}, {STEMS} SELECT word, stem, suffix FROM nouns",
    "detect_verbs": f"WITH {STATS}, {TOKENS}, {VERBS} SELECT word, verb, tense FROM verbs",
    "concept_templates": f"WITH RECURSIVE {_chunks(DOCS)}, {STATS}, {SPOKEN}, {STEMS}, {VERBS}, {CONCEPTS} SELECT chunk, array_to_string(concepts, '|') AS concepts, template FROM split",
    "concept_graph": f"WITH RECURSIVE {_concept_graph()} SELECT * FROM cedges",
    "concept_graph_of_pages": f"WITH RECURSIVE {_concept_graph('wiki')} SELECT * FROM cedges",
    "concept_nodes": f"WITH RECURSIVE {_concept_graph()} SELECT part, node_id, content, {KIND.replace('text', 'content')} AS node_type FROM cnodes",
    "concept_tags": f"""WITH RECURSIVE {_concept_graph()}, tagged AS (SELECT part, node_id, unnest({WORDS.format('content')}) AS tag FROM cnodes WHERE kind = 'chunk'
        UNION ALL SELECT part, node_id, lower(regexp_replace(content, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')) FROM cnodes WHERE kind = 'concept'
        UNION ALL SELECT part, node_id, unnest(['template', 'şablon']) FROM cnodes WHERE kind = 'template'),
        counted AS (SELECT part, node_id, tag, count(*)::DOUBLE AS weight FROM tagged GROUP BY ALL) SELECT part, tag, sum(weight) AS weight, count(*) AS nodes FROM counted GROUP BY ALL""",
    "verb_roles": f"""WITH RECURSIVE {_concept_graph()}, verbs_of AS (SELECT part, node_id, content AS verb FROM cnodes WHERE starts_with(content, '[') AND ends_with(content, ']') AND length(content) > 1),
        both_ends AS (SELECT src_part AS part, src_id AS node_id, dst_part AS to_part, dst_id AS to_id, role, weight FROM cedges WHERE role IS NOT NULL
          UNION ALL SELECT dst_part, dst_id, src_part, src_id, role, weight FROM cedges WHERE role IS NOT NULL)
        SELECT verb, role, n.content AS word, round(sum(weight), 6) AS weight, count(*) AS n FROM verbs_of JOIN both_ends USING (part, node_id) JOIN cnodes n ON n.part = to_part AND n.node_id = to_id
        WHERE NOT starts_with(n.content, '[') GROUP BY ALL""",
    "document_path_scores": f"""WITH {_graph()}, {DOC_PATHS}, gains AS (SELECT a.doc_id, CASE WHEN t.weight IS NOT NULL THEN t.weight * 0.2 WHEN b.weight IS NOT NULL THEN b.weight * 0.15 ELSE -0.2 END AS gain
          FROM paths a JOIN paths z ON z.doc_id = a.doc_id AND z.step = a.step + 1
          LEFT JOIN edges t ON t.src_part = a.part AND t.src_id = a.node_id AND t.dst_part = z.part AND t.dst_id = z.node_id
          LEFT JOIN edges b ON b.src_part = z.part AND b.src_id = z.node_id AND b.dst_part = a.part AND b.dst_id = a.node_id)
        SELECT doc_id AS query_id, round(greatest(-1.0, least(1.0, 0.5 + coalesce(sum(gain), 0.0))), 6) AS score FROM (SELECT DISTINCT doc_id FROM paths) LEFT JOIN gains USING (doc_id) GROUP BY doc_id""",
    "document_sentences": rf"""WITH {_graph()}, {DOC_PATHS}, shown AS (SELECT doc_id, step, trim(content, ' ') AS raw, {SHOWN} AS said, {KIND.replace(TRIMMED, 'content')} = 'Code' AS code FROM paths),
        ends AS (SELECT doc_id, min(step) AS first, min(step) FILTER (code) AS stop FROM shown GROUP BY doc_id),
        opened AS (SELECT doc_id, {TRIM.format("coalesce(string_agg(said, ' ' ORDER BY step) FILTER (stop IS NULL OR step < stop), '')")} AS plain,
          CASE WHEN any_value(stop) IS NULL THEN '' ELSE CASE WHEN any_value(stop) = any_value(first) THEN '' ELSE chr(10) END || '```rust' || chr(10) || (any_value(raw) FILTER (step = stop)) || chr(10) || '```' END AS block
          FROM shown JOIN ends USING (doc_id) GROUP BY doc_id)
        SELECT doc_id AS query_id, CASE WHEN plain = '' THEN '' ELSE {_CAPITAL.format("plain")} || CASE WHEN regexp_matches(plain, '[.!?]$') THEN '' ELSE '.' END END || block AS sentence FROM opened""",
    "concept_pair_scores": f"""WITH {_graph()}, known AS (SELECT content, max((part, node_id)) AS node FROM nodes GROUP BY content),
        items AS (SELECT c.doc_id, c.pos, node[1] AS part, node[2] AS node_id FROM chunks c JOIN known ON content = chunk),
        pairs AS (SELECT a.doc_id, a.part AS up, a.node_id AS u, b.part AS vp, b.node_id AS v FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.pos < b.pos),
        h0 AS (SELECT DISTINCT up, u, up AS p, u AS x FROM pairs), h1 AS (SELECT DISTINCT up, u, dst_part AS p, dst_id AS x FROM h0 JOIN edges ON src_part = p AND src_id = x),
        h2 AS (SELECT DISTINCT up, u, dst_part AS p, dst_id AS x FROM h1 JOIN edges ON src_part = p AND src_id = x), h3 AS (SELECT DISTINCT up, u, dst_part AS p, dst_id AS x FROM h2 JOIN edges ON src_part = p AND src_id = x),
        near AS (SELECT * FROM h0 UNION SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3), distinct_pairs AS (SELECT DISTINCT up, u, vp, v FROM pairs),
        shared AS (SELECT up, u, vp, v, sum(least(a.weight, b.weight)) AS overlap FROM distinct_pairs JOIN tags a ON a.part = up AND a.node_id = u JOIN tags b ON b.part = vp AND b.node_id = v AND b.tag = a.tag GROUP BY ALL),
        gains AS (SELECT doc_id, CASE WHEN t.weight IS NOT NULL THEN t.weight * 0.2 WHEN k.weight IS NOT NULL THEN k.weight * 0.15 WHEN n.x IS NOT NULL THEN 0.05 WHEN overlap > 0.1 THEN overlap * 0.05 ELSE -0.2 END AS gain
          FROM pairs LEFT JOIN edges t ON t.src_part = pairs.up AND t.src_id = pairs.u AND t.dst_part = pairs.vp AND t.dst_id = pairs.v LEFT JOIN edges k ON k.src_part = pairs.vp AND k.src_id = pairs.v AND k.dst_part = pairs.up AND k.dst_id = pairs.u
          LEFT JOIN near n ON n.up = pairs.up AND n.u = pairs.u AND n.p = pairs.vp AND n.x = pairs.v LEFT JOIN shared s ON s.up = pairs.up AND s.u = pairs.u AND s.vp = pairs.vp AND s.v = pairs.v)
        SELECT doc_id AS sentence_id, round(greatest(-1.0, least(1.0, 0.5 + coalesce(sum(gain), 0.0))), 6) AS score FROM (SELECT DISTINCT doc_id FROM chunks) LEFT JOIN gains USING (doc_id) GROUP BY doc_id""",
    "active_nodes_shown": f"""WITH {SPREAD}, {ROUTING_STEMS}, {ROUTES},
        wide AS (SELECT query_id, part, node_id, max(act) AS act FROM (SELECT * FROM active UNION ALL SELECT query_id, part, node_id, 1.0 FROM routes JOIN nodes USING (part)) GROUP BY ALL),
        strong AS (SELECT * FROM wide WHERE act > 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(act, 9) DESC, part, node_id) <= 50)
        SELECT query_id, part, node_id, content, round(act, 6) AS act FROM strong JOIN nodes USING (part, node_id)""",
    "status_nodes": f"WITH {_chunks(DOCS)}, {NODES} SELECT part, node_id, content, {KIND.replace('text', 'content')} AS node_type FROM nodes ORDER BY part, node_id LIMIT 50",
    "status_edges": f"""WITH {_graph()} SELECT src_part, src_id, dst_part, dst_id, s.content AS src_content, d.content AS dst_content, weight, edge_type, co_firings FROM edges
        JOIN nodes s ON s.part = src_part AND s.node_id = src_id JOIN nodes d ON d.part = dst_part AND d.node_id = dst_id ORDER BY src_part, src_id, dst_part, dst_id LIMIT 50""",
    "page_line_kinds": f"""WITH {LINES} SELECT path, count(*) AS lines, count(*) FILTER ({IS_NUMBER}) AS numbers, count(*) FILTER ({IS_CONTENTS}) AS contents,
        count(*) FILTER ({IS_COLLAPSED}) AS collapsed FROM lines GROUP BY path""",
    "registry_incremental": """SELECT doc_id::VARCHAR AS path, sha256(text) AS content_hash FROM documents WHERE lang IS DISTINCT FROM 'en'""",
    "catalog_union_distinct": f"SELECT lang || '_' || source AS part FROM documents UNION SELECT {_title('n_name')} FROM nation",
    "cross_part_edges": f"WITH {SUPPLY} SELECT DISTINCT dst_part AS part, dst_id AS node_id FROM edges WHERE dst_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "edges_with_ends": f"WITH {SUPPLY} SELECT src_id, dst_id, s_name AS src_content, p_name AS dst_content, weight FROM edges JOIN supplier ON s_suppkey = src_id JOIN part ON p_partkey = dst_id",
    "status_counts": f"WITH {_graph()} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT part) FROM nodes) AS parts",
    "inflect_words": rf"""WITH {_harmony(rf"SELECT DISTINCT word FROM (SELECT {BARE_WORD} AS word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents)) WHERE word <> ''", "h")},
        cases AS (SELECT unnest([{LISTED(CASES)}]) AS ending), tenses AS (SELECT unnest([{LISTED(TENSES)}]) AS ending)
        SELECT 'case' AS kind, word, ending, {_cased("ending")} AS form FROM h, cases UNION ALL SELECT 'tense', word, ending, {_tensed("ending")} FROM h, tenses
        UNION ALL SELECT 'copula', word, '', word || dental || narrow || 'r' FROM h""",
    "windowed_co_firings": """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, 'user' AS src_part, user_id AS src_id, 'event' AS dst_part, length(event_type)::BIGINT AS dst_id, count(*) AS co_firings FROM events GROUP BY ALL""",
    "changed_versions": """SELECT path, doc_id AS version, sha256(said) AS content_hash FROM (SELECT (doc_id // 2)::VARCHAR AS path, doc_id, coalesce(text, '') AS said FROM documents)
        QUALIFY said IS DISTINCT FROM lag(said) OVER (PARTITION BY path ORDER BY doc_id)""",
    "fed_edges": f"""WITH {SUPPLY}, counts AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
        SELECT 'supplier' AS src_part, s AS src_id, 'part' AS dst_part, p AS dst_id, round(least(1.0, 5 - (5 - weight) * pow(0.98, n)), 6) AS weight, co_firings + n AS co_firings, 'Semantic' AS edge_type
        FROM counts JOIN edges ON s = src_id AND p = dst_id
        UNION ALL SELECT 'part', p, 'supplier', s, round(least(1.0, 5 - 4.85 * pow(0.98, r - 1)), 6), r - 1, 'Semantic' FROM counts WHERE r > 0""",
}
# the same rows by another way: kept by ingests, and found through what they keep
ORACLE |= {"stored_word_stats": ORACLE["word_stats"], "stored_routes": ORACLE["route_parts_topk"], "sql_chunks": ORACLE["chunk_sentences"], "dump_pages": ORACLE["wiki_pages"], "sql_inflections": ORACLE["inflect_words"]}
