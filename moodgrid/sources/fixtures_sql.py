"""SQL twins of the derived fixtures, for the DuckDB oracle.

Each fixture is a CTE over the pre-registered views (``documents``,
``labels``, ``embeddings`` …).  :func:`sql_with` assembles the CTEs a
query needs, dependencies first, in front of the query body.  Lists in
DuckDB are 1-based; Spark arrays in the twins are 0-based.
"""

from __future__ import annotations

from ..functions import constants as C
from .fixtures import CLUSTER_SENTIMENT, CLUSTER_WORDS, INJECT_RULES, LENGTH_TAGS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _inject_sql() -> str:
    vals = {
        "mention": "'@' || w", "url": "'http://' || w", "hashtag": "'#' || w",
        "exclaim": "w || '!!'", "elongate": "w || 'oooo'", "negator": "'not'",
        "emoticon": "':)'",
    }
    arms = " ".join(f"WHEN (doc_id + j) % {m} = 0 THEN {vals[k]}" for m, k in INJECT_RULES)
    return f"CASE {arms} ELSE w END"


def _tag_sql(w: str = "w") -> str:
    lt = ", ".join(_q(x) for x in LENGTH_TAGS)
    return (f"CASE WHEN starts_with({w}, '#') THEN '#' WHEN starts_with({w}, '@') THEN '@' "
            f"WHEN starts_with({w}, 'http') THEN 'U' WHEN {w} = ':)' THEN 'E' "
            f"WHEN {w} = 'not' THEN 'R' WHEN regexp_full_match({w}, '[0-9]+') THEN '$' "
            f"WHEN regexp_full_match({w}, '[^A-Za-z0-9]+') THEN ',' "
            f"ELSE [{lt}][length({w}) % 5 + 1] END")


def tokens_map_sql(t: str, fn: str) -> str:
    """Rewrite each space-separated token of ``t`` with ``fn`` (a lambda body
    over ``w``)."""
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: {fn}), ' ')"


def url_user_sql(t: str) -> str:
    """T1 then T2 on a text expression."""
    t1 = tokens_map_sql(t, f"CASE WHEN starts_with(w, 'http') THEN {_q(C.URL_TOKEN)} ELSE w END")
    return tokens_map_sql(t1, f"CASE WHEN starts_with(w, '@') THEN {_q(C.USER_TOKEN)} ELSE w END")


def elongation_sql(chars: str) -> str:
    """T3 without back-references, over a character list column: character
    i is dropped when it is not a space and equals the three before it."""
    return (f"array_to_string(list_filter({chars}, lambda c, i: NOT (i > 3 AND c <> ' ' "
            f"AND {chars}[i - 1] = c AND {chars}[i - 2] = c AND {chars}[i - 3] = c)), '')")


_NEG_WORDS = ", ".join(_q(x) for x in C.NEGATION_WORDS)

FIXTURES: dict[str, tuple[str, list[str]]] = {
    "_pr": (f"""SELECT doc_id AS post_id, lang,
  list_transform(string_split(trim(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g')), ' '),
                 lambda w, j: {_inject_sql()}) AS _t
FROM documents""", []),
    "raw_posts": (f"""SELECT post_id, lang, array_to_string(_t, ' ') AS text,
  array_to_string(list_transform(_t, lambda w: {_tag_sql()}), ' ') AS tags
FROM _pr""", ["_pr"]),
    "post_labels": ("""SELECT doc_id AS post_id,
  CAST(CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 4 END AS INTEGER) AS label
FROM labels""", []),
    "posts": ("""SELECT r.post_id, r.lang, r.text, r.tags, l.label
FROM raw_posts r LEFT JOIN post_labels l ON l.post_id = r.post_id""", ["raw_posts", "post_labels"]),
    "_cp0": (f"""SELECT post_id, lang, text AS _raw, tags, label, string_split({url_user_sql('text')}, '') AS _c
FROM posts""", ["posts"]),
    "clean_posts": (f"""SELECT post_id, lang,
  CASE WHEN _raw = {_q(C.NOT_AVAILABLE)} THEN _raw ELSE {elongation_sql('_c')} END AS text, tags, label
FROM _cp0""", ["_cp0"]),
    "_afdf": ("""SELECT word, count(*) AS df
FROM (SELECT unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM raw_posts)
GROUP BY word""", ["raw_posts"]),
    "afinn_df": ("""SELECT word, df FROM _afdf
WHERE regexp_full_match(word, '[a-z]{2,8}') AND df >= 10""", ["_afdf"]),
    "afinn": ("""SELECT word, CAST((length(word) * 7 + ascii(word)) % 11 - 5 AS INTEGER) AS weight
FROM afinn_df""", ["afinn_df"]),
    "word_clusters": ("""SELECT cluster, word FROM (
  SELECT 'c' || CAST(ascii(word) % 6 AS VARCHAR) AS cluster, word,
         row_number() OVER (PARTITION BY 'c' || CAST(ascii(word) % 6 AS VARCHAR) ORDER BY df DESC, word) AS rk
  FROM afinn_df) WHERE rk <= """ + str(CLUSTER_WORDS), ["afinn_df"]),
    "cluster_sentiment": ("SELECT * FROM (VALUES " + ", ".join(
        f"({_q(c)}, {_q(s)}, {CLUSTER_WORDS})" for c, s in CLUSTER_SENTIMENT) +
        ") AS t(cluster, sentiment, size)", []),
    "lemma": ("""SELECT word AS form, pos, substr(word, 1, length(word) - 1) AS lemma
FROM afinn, (VALUES ('n'), ('v')) AS p(pos) WHERE ends_with(word, 's')""", ["afinn"]),
    "similarity": ("""SELECT a.word AS word_a, p.pos, c.word AS word_b, 'path' AS scheme,
  round(1.0 / (1.0 + abs(length(a.word) - length(c.word))), 6) AS score
FROM afinn a JOIN word_clusters c ON substr(a.word, 1, 1) = substr(c.word, 1, 1),
     (VALUES ('n'), ('v'), ('a'), ('r')) AS p(pos)""", ["afinn", "word_clusters"]),
    "_lp": ("""SELECT post_id, label, string_split(text, ' ') AS t FROM clean_posts WHERE label IS NOT NULL""",
            ["clean_posts"]),
    "_lt": ("""SELECT label, 'uni' AS kind, unnest(list_distinct(list_filter(t, lambda w: w <> ''))) AS term FROM _lp
UNION ALL
SELECT label, 'bi' AS kind, unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) FROM _lp
UNION ALL
SELECT label, 'pair' AS kind, unnest(list_distinct(list_concat(
  list_transform(range(1, len(t) - 1), lambda i: t[i] || '---' || t[i + 2]),
  list_transform(range(1, len(t) - 1), lambda i: t[i] || '---' || t[i + 1] || ' ' || t[i + 2]),
  list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || '---' || t[i + 2]),
  list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || '---' || t[i + 2] || ' ' || t[i + 3])))) FROM _lp""",
            ["_lp"]),
    "_nrc": ("""SELECT 'nrc' AS lexicon, kind, term,
  round(ln((1 + n_pos)::DOUBLE / (1 + n_neg)), 6) AS score, n_pos, n_neg
FROM (SELECT kind, term,
        CAST(count(*) FILTER (WHERE label = 1) AS INTEGER) AS n_pos,
        CAST(count(*) FILTER (WHERE label <> 1) AS INTEGER) AS n_neg
      FROM _lt GROUP BY kind, term)
WHERE n_pos + n_neg >= 2""", ["_lt"]),
    "lexicon": ("""SELECT * FROM _nrc
UNION ALL
SELECT 's140' AS lexicon, kind, term, round(score * -0.5, 6) AS score, n_pos, n_neg FROM _nrc""", ["_nrc"]),
    "margins": ("""SELECT vec_id AS post_id, 1 AS label, CAST(embedding[1] AS DOUBLE) AS margin FROM embeddings
UNION ALL SELECT vec_id, 2, CAST(embedding[2] AS DOUBLE) FROM embeddings
UNION ALL SELECT vec_id, 4, CAST(embedding[3] AS DOUBLE) FROM embeddings""", []),
    "predictions": ("""SELECT vec_id AS post_id,
  CAST([1, 2, 4][label % 3 + 1] AS INTEGER) AS truth,
  CAST(CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 1
            WHEN embedding[2] >= embedding[3] THEN 2 ELSE 4 END AS INTEGER) AS pred
FROM embeddings""", []),
    "raw_lines": ("""SELECT post_id,
  CASE WHEN post_id % 50 = 0 THEN _x
       WHEN _n IS NULL THEN _x || chr(9) || tags
       ELSE _n || chr(9) || _x || chr(9) || tags END AS line
FROM (SELECT post_id, tags,
        CASE WHEN post_id % 97 = 0 THEN 'Not Available' ELSE text END AS _x,
        CASE label """ + " ".join(f"WHEN {v} THEN {_q(k)}" for k, v in C.LABEL_NAMES.items()) + """ END AS _n
      FROM posts)""", ["posts"]),
    "responses": ("""SELECT cluster AS keyword,
  '{"relations": [' || string_agg('{"word": "' || word || '", "value": 1}', ', ' ORDER BY rk, word) || ']}' AS body
FROM (SELECT cluster, CAST(rk AS DOUBLE) AS rk, word FROM _rk
      UNION ALL SELECT cluster, 2.5, word || ' pair' FROM _rk WHERE rk = 1
      UNION ALL SELECT cluster, 3.5, word FROM _rk WHERE rk = 1)
GROUP BY cluster""", ["_rk"]),
    "_rk": ("""SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY word) AS rk
FROM word_clusters""", ["word_clusters"]),
    "auto_cluster_index": ("""SELECT cluster,
  ['positive', 'negative', 'neutral', 'unknown'][cluster % 4 + 1] AS sentiment, size
FROM (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label
      UNION ALL SELECT max(label) + 1, 1 FROM embeddings)""", []),
    "tax_nodes": ("""SELECT DISTINCT pos, substr(word, 1, i) AS p
FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM afinn_df),
     (VALUES ('n', 1), ('v', 2)) AS k(pos, m) WHERE length(word) % m = 0""", ["afinn_df"]),
    "tax_edges": ("""SELECT pos, p AS child, substr(p, 1, length(p) - 1) AS parent FROM tax_nodes
UNION SELECT pos, p, substr(p, 3) FROM tax_nodes
WHERE length(p) >= 3 AND (pos, substr(p, 3)) IN (SELECT (pos, p) FROM tax_nodes)""", ["tax_nodes"]),
    "tax_senses": ("""SELECT p AS word, pos, p AS synset FROM tax_nodes
UNION SELECT substr(p, 1, length(p) - 1), pos, p FROM tax_nodes WHERE length(p) >= 3""", ["tax_nodes"]),
    # the top is the empty prefix
    "tax_walks(pos, synset, ancestor, d)": ("""SELECT pos, p, p, 0 FROM tax_nodes
UNION SELECT w.pos, w.synset, e.parent, w.d + 1
FROM "tax_walks" w JOIN tax_edges e ON e.pos = w.pos AND e.child = w.ancestor""", ["tax_nodes", "tax_edges"]),
    "tax_up": ("""SELECT pos, synset, ancestor, min(d) AS d FROM tax_walks GROUP BY pos, synset, ancestor""",
               ["tax_walks(pos, synset, ancestor, d)"]),
    "tax_pairs": ("""SELECT a.word AS word_a, a.pos, b.word AS word_b, min(a.d + b.d + 1) AS l,
  max(2.0::DOUBLE * h.depth / (a.d + b.d + 2 * h.depth)) AS wup
FROM (SELECT s.word, s.pos, u.ancestor, u.d FROM tax_senses s JOIN tax_up u ON u.pos = s.pos AND u.synset = s.synset
      WHERE s.word IN (SELECT word FROM afinn_df)) a
JOIN (SELECT s.word, s.pos, u.ancestor, u.d FROM tax_senses s JOIN tax_up u ON u.pos = s.pos AND u.synset = s.synset
      WHERE s.word IN (SELECT word FROM word_clusters)) b ON b.pos = a.pos AND b.ancestor = a.ancestor
JOIN (SELECT pos, synset AS ancestor, d + 1 AS depth FROM tax_up WHERE ancestor = ''
      UNION ALL SELECT DISTINCT pos, '', 1 FROM tax_nodes) h ON h.pos = a.pos AND h.ancestor = a.ancestor
GROUP BY a.word, a.pos, b.word""", ["tax_senses", "tax_up", "word_clusters", "afinn_df"]),
    "tax_similarity": ("""SELECT word_a, pos, word_b, unnest(['path', 'wup', 'lch']) AS scheme,
  unnest([round(1.0::DOUBLE / l, 6), round(wup, 6), round(ln(2.0::DOUBLE * most / l), 6)]) AS score
FROM tax_pairs JOIN (SELECT pos, max(d) + 1 AS most FROM tax_up WHERE ancestor = '' GROUP BY pos) USING (pos)""",
                       ["tax_pairs", "tax_up"]),
    "tax_exceptions": ("""SELECT word AS form, 'n' AS pos, substr(word, 1, length(word) - 2) AS base
FROM afinn_df WHERE length(word) >= 5 AND ascii(word) % 7 = 0""", ["afinn_df"]),
}


def sql_with(body: str, *names: str) -> str:
    """``WITH`` the named fixtures (and their dependencies) + ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FIXTURES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    # evaluated once each, whatever the number of uses
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{FIXTURES[n][0]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
