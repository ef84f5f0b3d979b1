"""DuckDB statements for the operators that SQL can express.

Trained models (op3, op7, op8) and the pipeline have none; shards need a crc32 and near-duplicate
classes a transitive closure over all pairs, which whole tables are too large for. Those are
tested against brute force.
"""

from __future__ import annotations

import re

from platwork.llm.repetition import LEAST_WORDS, LINE_LIMIT, NGRAM_LIMITS, WINDOW, WINDOW_LIMIT
from platwork.llm.secrets import BASE, RULES, Rule

_WORD = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _repetition() -> str:
    parts = [
        rf"""d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce((SELECT sum(length(x)) FROM unnest(w) AS t(x)), 0)::BIGINT AS word_chars,
 (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) AS k FROM l WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM lines WHERE k > 1 GROUP BY doc_id)"""
    ]
    for n in NGRAM_LIMITS:
        words = ", ".join(f"lead(word, {j}) OVER v" for j in range(1, n))
        parts.append(
            f"""g{n} AS (SELECT doc_id, word, p, n, CASE WHEN p + {n - 1} <= n THEN concat_ws(' ', word, {words}) END AS g
 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
f{n} AS (SELECT doc_id, word, p, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g{n}),
c{n} AS (SELECT doc_id, count(*) AS hits, sum(length(word)) AS chars FROM (SELECT doc_id, word,
 bool_or(twice) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM f{n}) WHERE hit GROUP BY doc_id)"""
        )
    share = {n: f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1)::DOUBLE" for n in NGRAM_LIMITS}
    over = " OR ".join(f"{s} > {NGRAM_LIMITS[n]}" for n, s in share.items())
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in NGRAM_LIMITS)
    return f"""WITH {", ".join(parts)},
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c{WINDOW}.hits, 0)::BIGINT AS n_repeat_words,
 coalesce(dup.chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_line_share, greatest({", ".join(share.values())}) AS dup_ngram_share, ({over}) AS over
 FROM base LEFT JOIN dup USING (doc_id) {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT over AND dup_line_share <= {LINE_LIMIT} AS kept, dup_line_share, dup_ngram_share
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {WINDOW_LIMIT} * n_words AS base_failed FROM m)"""


_LEAKS = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_PLAIN}'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS p FROM sized)),
own AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (
 SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, item_id, n, p FROM own JOIN windows USING (n, g)),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN words USING (doc_id)"""

_FACTORS = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d)),
later AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS low FROM windows) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def _re2(rule: Rule) -> str:
    """The rule's pattern with either case spelt out, as small letters only stand for themselves there."""
    pattern = rule.pattern
    if rule.any_case:
        pattern = re.sub(r"\\x..|\[[^]]*\]|[a-z]", lambda m: m[0] if len(m[0]) > 1 else f"[{m[0]}{m[0].upper()}]", pattern)
    return pattern.replace("'", "''")


def _secrets() -> str:
    found, spans = [], []
    for k, r in enumerate(RULES):
        p = _re2(r)
        found.append(
            f"regexp_extract_all(text, '{p}') AS m{k}, regexp_extract_all(text, '{p}', {r.group}) AS g{k}, regexp_split_to_array(text, '{p}') AS b{k}"
        )
        start = f"list_sum(list_transform(b{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0)"
        spans.append(
            f"""SELECT doc_id, s AS start, {k} AS place, '{r.kind}' AS kind, s + n AS stop FROM (
 SELECT doc_id, ({start})::BIGINT AS s, length(m{k}[i]) AS n, length(g{k}[i]) AS kept FROM (SELECT *, unnest(generate_series(1, len(m{k}))) AS i FROM f)) WHERE kept >= {r.least}"""
        )
    one = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"coalesce(n{k}, 0)::BIGINT AS n_{r}" for k, r in enumerate(BASE))
    sums = ", ".join(f"count(*) FILTER (place = {k}) AS n{k}" for k in range(len(BASE)))
    return f"""WITH f AS (SELECT doc_id, text, {", ".join(found)} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
spans AS ({" UNION ALL ".join(spans)}),
folded AS (SELECT doc_id, {sums}, string_agg({one}, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
 string_agg({one}, ',' ORDER BY start, place) AS every FROM spans GROUP BY doc_id)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM f LEFT JOIN folded USING (doc_id)"""


_MIX = rf"""WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM s GROUP BY source),
placed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight,
 row_number() OVER (ORDER BY source IS NULL, source) AS place FROM src),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER v, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER v, 0))::DOUBLE AS own_level
 FROM placed WINDOW v AS (ORDER BY source_size / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT *, least((2 * source_size)::DOUBLE, max(own_level) FILTER (own_level * weight <= 2 * source_size) OVER () * weight) AS target FROM levels),
parts AS (SELECT *, floor(coalesce(target / source_size, 0))::BIGINT AS whole FROM goals),
ready AS (SELECT *, target - whole * source_size AS missing, coalesce((target - whole * source_size) / source_size, 0) AS part FROM parts),
u AS (SELECT s.doc_id, s.source, s.size, g.* EXCLUDE (source),
 (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
 FROM s JOIN ready g ON s.source IS NOT DISTINCT FROM g.source),
ranked AS (SELECT *, CASE WHEN size > 0 AND part > 0 THEN (u / (1 - u)) / ((size * n / source_size::DOUBLE) * (part / (1 - part))) END AS rank FROM u),
drawn AS (SELECT *, CASE WHEN rank IS NOT NULL AND sum(size) OVER (PARTITION BY place, rank IS NULL ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= missing THEN 1 ELSE 0 END AS extra FROM ranked),
open AS (SELECT *, missing - sum(size * extra) OVER (PARTITION BY place) AS lacking FROM drawn),
last AS (SELECT *, extra = 0 AND rank IS NOT NULL AND abs(size - lacking) < lacking AND row_number() OVER (
 PARTITION BY place, extra = 0 AND rank IS NOT NULL AND abs(size - lacking) < lacking ORDER BY abs(size - lacking), rank, doc_id) = 1 AS closing FROM open)
SELECT doc_id, size, source_size, target, ((whole + extra + closing::INT) * size)::BIGINT AS taken FROM last"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_RANKED = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
i AS (SELECT item_id, term, count(*)::BIGINT AS times
 FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
 FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
s AS (SELECT item_id, tf.doc_id,
 sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
 FROM tf JOIN i USING (term) JOIN w USING (term) JOIN n ON n.doc_id = tf.doc_id CROSS JOIN g GROUP BY item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_PHRASES = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
 FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
x AS (SELECT lang, w[i:i + k - 1] AS w, k FROM p, unnest([1, 2, 3, 4]) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, array_to_string(w, ' ') AS phrase, k, count(*)::BIGINT AS f FROM x GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, i,
 (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score
 FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
 JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:i], ' ')
 JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[i + 1:], ' ')),
weak AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM cut),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
 FROM c, unnest([2, 3]) AS t(m), unnest(range(1, 5 - m + 1)) AS u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT weak.* FROM weak LEFT JOIN inside USING (lang, phrase) WHERE o = 1 AND (longer IS NULL OR 100 * longer < 80 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE = {
    "op2_repetition_coverage": _repetition(),
    "op5_suffix_arrays": _LEAKS,
    "op6_relative_factors": _FACTORS,
    "op9_trigram_index": _secrets(),
    "op10_pareto_mixing": _MIX,
    "op12_itemset_phrases": _PHRASES,
    "op13_reversed_search": _RANKED,
}
