"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import NOTICES, PHRASES
from .quality import STOP_LANGS, STOP_WORDS
from .secrets import BASE, RULES

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LANGS = ", ".join(f"'{x}'" for x in STOP_LANGS)

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, split_part(replace(lower(lang), '_', '-'), '-', 1) AS base FROM documents),
w AS (SELECT doc_id, t, coalesce(base IN ({_LANGS}), false) AS asked, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i+4]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE c > 1)
      GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, asked, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN ls USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  CASE WHEN base_failed THEN false
       ELSE word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.25
            AND (NOT asked OR n_words < 50 OR n_stop_words >= 2)
            AND (n_dup_lines < 3 OR n_dup_lines / n_lines <= 0.30) END AS kept
FROM b
"""


def _secrets() -> str:
    """Per rule: pieces, matches and groups as lists, offsets as list sums."""
    lists = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least,
            string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits,
            regexp_extract_all(t, '{p}', {r.group}) AS parts FROM d WHERE regexp_matches(t, '{p}')"""
        for i, r in enumerate(RULES) for p in [r.pattern])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS ({lists}),
h AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM l),
s AS (SELECT doc_id, rank, kind, length(parts[k]) >= least AS ok, length(hits[k]) AS n,
        list_sum(list_transform(gaps[1:k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS a FROM h),
f AS (SELECT *, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM s WHERE ok),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
        string_agg(span, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base,
        string_agg(span, ',' ORDER BY a, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SECRETS = _secrets()


AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS p FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, p, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, p),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step::INT, 1)) - 65) AS own,
        coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))), 0)::INT AS done
      FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (p & (own | done) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (p & own <> 0 AND p & done = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (p & own <> 0 AND p & done <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (p = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (p & own <> 0 AND p & done = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (p & own <> 0 AND p & done = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def _licenses() -> str:
    """Every template word joined to the texts' words; places by offset."""
    rows = []
    for t, n in enumerate(PHRASES + NOTICES):
        ws = n.text.split()
        must = {i + k for key in n.keys for i in range(len(ws)) if ws[i:i + len(key.split())] == key.split()
                for k in range(len(key.split()))}
        rows += [f"({t}, '{n.label}', {str(t < len(PHRASES)).lower()}, {q}, '{w}', {int(q in must)}, {len(ws)}, "
                 f"{n.share}, {len(must)})" for q, w in enumerate(ws)]
    return rf"""
WITH t(template, label, base, q, word, must, size, share, musts) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
m AS (SELECT doc_id, template, label, base, i - q AS place, count(*) / size AS part FROM w JOIN t USING (word)
      GROUP BY doc_id, n, template, label, base, i - q, size, share, musts
      HAVING count(*) >= share * size AND sum(must) = musts AND i - q >= 0 AND i - q + size <= n),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
        array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(part) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


LICENSES = _licenses()
