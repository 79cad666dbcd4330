"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .quality import RULES, STOP_WORDS

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text with A-Z lower-cased.
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, s, s + n - 1) AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n),
dg AS (SELECT rid, n, s, list_slice(w, s, s + n - 1) AS g FROM dw),
occ AS (SELECT dg.rid, dg.n, dg.s, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS names FROM occ GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

_BLANK = r"\x20\x09-\x0D"
_MEASURED = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[{_BLANK}]*[-*•]')) AS n_bullet_lines,
    count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[{_BLANK}]*$')) AS n_ellipsis_lines, count(*) FILTER (len(regexp_extract_all(line, '[^{_BLANK}]+')) <= 3) AS n_short_lines
  FROM lines WHERE regexp_matches(line, '[^{_BLANK}]') GROUP BY rid),
wd AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
wins AS (SELECT rid, s, lead(word, 7) OVER o AS far, concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, 8))}) AS g FROM wd WINDOW o AS (PARTITION BY rid ORDER BY s)),
seen AS (SELECT rid, s, count(*) OVER (PARTITION BY rid, g) AS n FROM wins WHERE far IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(s, s + 8)) AS p FROM seen WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS bigint) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(text) AS n_chars,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(text, '[^.,;:!?]', '', 'g')) AS n_points, length(regexp_replace(text, '[^{{}}]', '', 'g')) AS n_braces,
  length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS n_beyond_ascii, cast(len(list_distinct(w)) AS bigint) AS n_distinct_words,
  cast(len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, x))) AS bigint) AS n_stop_words, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
  cast(len(list_filter(w, lambda x: length(x) > 20)) AS bigint) AS n_long_words, cast(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bigint) AS n_lettered_words,
  coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(n_short_lines, 0) AS n_short_lines
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT *, cast({" + ".join(f"({condition})::bigint * {1 << bit}" for bit, (_, condition) in enumerate(RULES))} AS bigint) AS mask FROM m)
"""
#: Of the policy that ``kept`` follows, the bits of its rules.
_BASE, _KEPT = 0b11, 0b111111
QUALITY = f"WITH {_MEASURED} SELECT *, mask & {_BASE} <> 0 AS base_failed, mask & {_KEPT} = 0 AS kept FROM r"
ABLATION = f"""
WITH {_MEASURED},
rules(rule, bit) AS (VALUES ('too_short', 1::bigint), ('repeats_itself', 2), ('symbol_noise', 4), ('repeated_lines', 8), ('shouting', 16), ('odd_word_length', 32))
SELECT rule, bit, count(*) FILTER (mask & bit <> 0) AS fails, count(*) FILTER (mask & {_KEPT} = bit) AS fails_alone, count(*) FILTER ((mask & {_KEPT}) - (mask & bit) <> 0) AS rejected_without,
    coalesce(bit_or(mask & {_KEPT}) FILTER (mask & bit <> 0), 0) AS seen_with
FROM r, rules GROUP BY rule, bit
"""

_QUINT = "cast('0x' || substr(h, 5 * i + 1, 5) AS bigint)"
_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(({q} >> {s}) & 31 AS int) + 1, 1)"
_BASE32 = "list_reduce(list_transform(range(0, 8), lambda i: " + " || ".join(_CHAR.format(q=_QUINT, s=s) for s in (15, 10, 5, 0)) + "), lambda a, b: a || b)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, cast(octet_length(encode(html)) AS bigint) AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT h, max(page_id) AS original FROM d GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to, cast(NULL AS varchar) AS error
FROM d JOIN m USING (h)
"""

_FIT = "((host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))"
_PART = r"'(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), {_PART}, 1), '{ASCII_UPPER}', '{ASCII_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), {_PART}, 2)"


def _node(url: str) -> str:
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END || regexp_extract({url}, {_PART}, 3) END"


URLS = rf"""
WITH RECURSIVE r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT row_number() OVER () AS rid, page_id, url, html, {_host("url")} AS host, {_path("url")} AS path, {_node("url")} AS node FROM pages),
best AS (SELECT rid, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS verdict FROM u, r WHERE {_FIT} GROUP BY rid),
tags AS (SELECT url, host, path, node, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"''\s>]+)', 1)))) AS target FROM u WHERE url IS NOT NULL),
whole AS (SELECT node AS src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t END WHEN t[1:2] = '//' THEN 'x:' || t WHEN t[1] = '#' THEN url
    WHEN t[1] = '?' THEN 'x://' || host || path || t WHEN t[1] = '/' THEN 'x://' || host || t ELSE 'x://' || host || '/' || array_to_string(string_split(path, '/')[2:-2] || [t], '/') END AS t
  FROM (SELECT node, url, host, path, replace(target, '&amp;', '&') AS t FROM tags WHERE target <> '')),
parted AS (SELECT src, {_host("t")} AS host, string_split({_path("t")}, '/')[2:] AS steps, regexp_extract(t, {_PART}, 3) AS query FROM whole WHERE t IS NOT NULL),
walked AS (SELECT src, host, query, list_reduce(list_prepend('', steps), lambda done, s: CASE WHEN s = '.' THEN done WHEN s = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END)
    || CASE WHEN steps[-1] IN ('.', '..') THEN '/' ELSE '' END AS path FROM parted),
e AS (SELECT DISTINCT src, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS dst FROM walked),
both_ways AS (SELECT src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
reach(a, b) AS (SELECT src, src FROM both_ways UNION SELECT reach.a, both_ways.dst FROM reach JOIN both_ways ON reach.b = both_ways.src),
member AS (SELECT b, {_host("'http://' || b")} AS host, {_path("'http://' || b")} AS path FROM (SELECT DISTINCT b FROM reach)),
own AS (SELECT b, arg_max(verdict, length(h) + length(p)) AS verdict FROM member, r WHERE {_FIT} GROUP BY b),
taken AS (SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' ELSE 'allow' END AS taken FROM reach LEFT JOIN own USING (b) GROUP BY a)
SELECT page_id, host, path, rule, coalesce(best.verdict, taken.taken, 'allow') AS verdict FROM u LEFT JOIN best USING (rid) LEFT JOIN taken USING (node)
"""

#: Windows are compared as whole lists of words; a word goes if one of the 20 windows that end at or behind it was there before.
SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
dups AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1),
tokens AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
marked AS (
  SELECT t.doc_id, t.i, t.word, max(d.i IS NOT NULL) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM tokens t LEFT JOIN dups d ON d.doc_id = t.doc_id AND d.i = t.i
),
left_over AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over l ON l.doc_id = w.doc_id
"""

#: CRC-32 of a number's decimal digits, bit by bit (3988292384 is the polynomial, reflected).
_CRC = "xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda v, b: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(v, b)), 4294967295::BIGINT), 4294967295)"

PREFIXES = rf"""
WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) - 1 AS place, {{'role': role, 'text': text}} AS said FROM said),
convs AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
rebuilt AS (
  SELECT convs.c, 0 AS part, t.place, t.said FROM convs JOIN t ON t.c = convs.base AND t.place < convs.h
  UNION ALL SELECT convs.c, 1, t.place, t.said FROM convs JOIN t ON t.c = convs.c AND t.place >= convs.h
),
paths AS (SELECT convs.c, coalesce(list(said ORDER BY part, place) FILTER (said IS NOT NULL), []) AS path FROM convs LEFT JOIN rebuilt ON rebuilt.c = convs.c GROUP BY convs.c),
steps AS (SELECT c, path[1:d] AS node, d, len(path) = d AS ends FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended FROM steps GROUP BY node, d),
kids AS (SELECT node[1:d-1] AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
worth AS (SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN nodes.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(nodes.node[-1].text, '[^\x20\x09-\x0D]+')) END AS saved FROM nodes LEFT JOIN kids ON kids.node = nodes.node AND kids.d = nodes.d),
below AS (SELECT node[1:k] AS node, k AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT node, n_children, saved, unnest(range(d + 1)) AS k FROM worth) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, sha256(w.ended) AS ends_sha256
FROM worth w JOIN below ON below.node = w.node AND below.d = w.d LEFT JOIN nodes p ON p.d = w.d - 1 AND p.node = w.node[1:w.d-1]
"""

COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
phrases AS (SELECT lang, 1 AS k, ws[i:i] AS p FROM places UNION ALL SELECT lang, 2, ws[i:i+1] FROM places WHERE i + 1 <= len(ws) UNION ALL SELECT lang, 3, ws[i:i+2] FROM places WHERE i + 2 <= len(ws)),
f AS (SELECT lang, k, p, count(*) AS n FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, n AS a FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM cand),
cut_scores AS (
  SELECT cuts.*, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = cuts.p[1:c] JOIN f y ON y.lang = cuts.lang AND y.p = cuts.p[c+1:cuts.k]
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, c) AS o FROM cut_scores) WHERE o = 1),
inner_parts AS (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, a FROM cand WHERE k = 3),
longer AS (SELECT lang, p, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.p = best.p WHERE best.k = 3 OR longer.most IS NULL OR 100 * longer.most < 50 * best.a),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM kept),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT numbered.lang, rank, phrase, a, l, r, n, score FROM numbered JOIN totals ON totals.lang = numbered.lang WHERE rank <= 2000
"""
