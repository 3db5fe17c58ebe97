"""Queries: ingest scans, filters and text normalisers (S1–S2, P1–P11,
T1–T5, T7), plus the flagship word-list slice (U3 + P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import ingest as I
from ..operators import mutators as M
from ..operators.lookup import sized_lookup
from ..sources import fixtures as X
from ..sources.fixtures_sql import _q, elongation_sql, sql_with, url_user_sql
from ..sources.tables import table
from .registry import register

MASK_PNE = C.POS | C.NEG | C.NEU
AF_T, AF_W = C.MUTATOR_SETTINGS["af"]

_LABEL_CASE = "CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in C.LABEL_NAMES.items()) + " END"
_NEG_LIST = ", ".join(_q(x) for x in C.NEGATION_WORDS)


# --------------------------------------------------------------------------
# flagship: word-list score -> range filter -> count per (lang, label)
# --------------------------------------------------------------------------

def flagship(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    af = sized_lookup(X.afinn(spark, sf_dir))
    scores = M.afinn_score(p, af, keep=("lang",))
    lab = M.range_labels(scores, M.symmetric_ranges(spark, AF_T))
    return lab.groupBy("lang", "label").agg(
        F.count(F.lit(1)).alias("n_posts"), F.round(F.avg("score"), 6).alias("mean_score"))


register("u3_afinn_range_counts", sql_with(f"""
SELECT lang, label, count(*) AS n_posts, round(avg(score), 6) AS mean_score
FROM (SELECT t.post_id, t.lang, CAST(coalesce(sum(a.weight), 0) AS DOUBLE) AS score
      FROM (SELECT post_id, lang, unnest(string_split(lower(text), ' ')) AS word FROM clean_posts) t
      LEFT JOIN afinn a ON a.word = t.word
      GROUP BY t.post_id, t.lang) s
JOIN (VALUES (1, {AF_T}::DOUBLE, 'inf'::DOUBLE), (2, '-inf'::DOUBLE, -{AF_T}::DOUBLE),
             (4, -{AF_T}::DOUBLE, {AF_T}::DOUBLE)) AS r(label, lo, hi)
  ON s.score > r.lo AND s.score < r.hi
GROUP BY lang, label""", "clean_posts", "afinn"))(flagship)


# --------------------------------------------------------------------------
# Labelled-post scan over TSV lines
# --------------------------------------------------------------------------

S1_SQL = f"""
SELECT post_id, label, CASE WHEN _x = {_q(C.NOT_AVAILABLE)} THEN _x ELSE {elongation_sql('_c')} END AS text, tags
FROM (SELECT post_id, label, _x, tags, string_split({url_user_sql('_x')}, '') AS _c
      FROM (SELECT post_id, {_LABEL_CASE.format(x='f[1]')} AS label, f[2] AS _x, f[3] AS tags
            FROM (SELECT post_id, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(9)) AS f
                  FROM raw_lines)
            WHERE len(f) = 3)
      WHERE label IS NOT NULL AND (label & {MASK_PNE}) <> 0 AND _x <> {_q(C.NOT_AVAILABLE)})
"""


@register("s1_labelled_scan", sql_with(S1_SQL, "raw_lines"))
def s1_labelled_scan(spark, sf_dir):
    lines = X.raw_lines(spark, sf_dir)
    return I.labelled_scan(lines, MASK_PNE).select("post_id", "label", "text", "tags")


@register("s2_split_fields", sql_with(f"""
SELECT post_id, CAST(len(f) AS INTEGER) AS n_fields,
  CASE WHEN len(f) = 3 THEN f[1] END AS label_name,
  CASE WHEN len(f) = 2 THEN f[1] WHEN len(f) = 3 THEN f[2] END AS text,
  CASE WHEN len(f) = 2 THEN f[2] WHEN len(f) = 3 THEN f[3] END AS tags
FROM (SELECT post_id, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(9)) AS f FROM raw_lines)
""", "raw_lines"))
def s2_split_fields(spark, sf_dir):
    return I.split_fields(X.raw_lines(spark, sf_dir))


@register("a17_malformed_counts", sql_with(f"""
SELECT reason, count(*) AS n_rows FROM (
  SELECT CASE WHEN len(f) NOT IN (2, 3) THEN 'bad_arity'
              WHEN len(f) = 2 THEN 'unlabelled'
              WHEN {_LABEL_CASE.format(x='f[1]')} IS NULL THEN 'unknown_label'
              WHEN f[2] = {_q(C.NOT_AVAILABLE)} THEN 'not_available'
              WHEN ({_LABEL_CASE.format(x='f[1]')} & {MASK_PNE}) = 0 THEN 'masked'
              ELSE 'ok' END AS reason
  FROM (SELECT string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(9)) AS f FROM raw_lines))
GROUP BY reason""", "raw_lines"))
def a17_malformed_counts(spark, sf_dir):
    return I.scan_report(X.raw_lines(spark, sf_dir), MASK_PNE)


@register("p1_data_separator", sql_with("""
SELECT post_id, f[1] AS text, f[2] AS tags
FROM (SELECT post_id, string_split(regexp_replace(
        CASE WHEN post_id % 50 = 0 THEN text ELSE text || chr(9) || tags END, '^\\s+|\\s+$', '', 'g'), chr(9)) AS f
      FROM clean_posts)
WHERE len(f) = 2""", "clean_posts"))
def p1_data_separator(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    inflight = p.select("post_id", I.rejoin(F.col("text"), F.col("tags"), F.col("post_id") % 50 == 0).alias("row"))
    return I.separate(inflight, "row")


@register("p4_label_mask_filter", sql_with("""
SELECT label, count(*) AS n_posts FROM posts
WHERE label IS NOT NULL AND (label & 3) <> 0 AND text <> 'Not Available'
GROUP BY label""", "posts"))
def p4_label_mask_filter(spark, sf_dir):
    p = X.posts(spark, sf_dir)
    mask = I.class_mask("pn")
    return I.mask_filter(p, mask).groupBy("label").agg(F.count(F.lit(1)).alias("n_posts"))


# --------------------------------------------------------------------------
# T1–T5 normalisers
# --------------------------------------------------------------------------

@register("t1_url_normalise", sql_with(f"""
SELECT post_id, array_to_string(list_transform(string_split(text, ' '),
  lambda w: CASE WHEN starts_with(w, 'http') THEN {_q(C.URL_TOKEN)} ELSE w END), ' ') AS text
FROM posts""", "posts"))
def t1_url_normalise(spark, sf_dir):
    return X.posts(spark, sf_dir).select("post_id", T.normalise_urls("text").alias("text"))


@register("t2_user_normalise", sql_with(f"""
SELECT post_id, array_to_string(list_transform(string_split(text, ' '),
  lambda w: CASE WHEN starts_with(w, '@') THEN {_q(C.USER_TOKEN)} ELSE w END), ' ') AS text
FROM posts""", "posts"))
def t2_user_normalise(spark, sf_dir):
    return X.posts(spark, sf_dir).select("post_id", T.normalise_users("text").alias("text"))


@register("t3_elongation_cap", sql_with(f"""
SELECT post_id, {elongation_sql('_c')} AS text
FROM (SELECT post_id, string_split(text, '') AS _c FROM posts)""", "posts"))
def t3_elongation_cap(spark, sf_dir):
    return X.posts(spark, sf_dir).select("post_id", T.cap_elongation("text").alias("text"))


@register("t123_ingest_normalise", sql_with("""
SELECT post_id, text FROM clean_posts""", "clean_posts"))
def t123_ingest_normalise(spark, sf_dir):
    return X.clean_posts(spark, sf_dir).select("post_id", "text")


@register("t4_negation_scope", sql_with(f"""
SELECT post_id, string_agg(CASE WHEN ev IS NULL AND st = 1 THEN w || '_NEG' ELSE w END, ' ' ORDER BY i) AS text
FROM (SELECT post_id, i, w, ev,
        last_value(ev IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st
      FROM (SELECT post_id, i, w,
              CASE WHEN list_contains([{_NEG_LIST}], w) OR contains(w, 'n''t') THEN 1
                   WHEN regexp_matches(w, '[.,:;!?]') THEN 0 END AS ev
            FROM (SELECT post_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i
                  FROM (SELECT post_id, string_split(text, ' ') AS t FROM clean_posts))))
GROUP BY post_id""", "clean_posts"))
def t4_negation_scope(spark, sf_dir):
    return X.clean_posts(spark, sf_dir).select("post_id", T.negation_scope("text").alias("text"))


def _html_sql(col: str) -> str:
    out = col
    for ent, ch in C.HTML_ENTITIES:
        out = f"replace({out}, {_q(ent)}, {_q(ch)})"
    return out


@register("t5_html_decode", f"SELECT page_id, {_html_sql('html')} AS html FROM pages")
def t5_html_decode(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.decode_html("html").alias("html"))


@register("t7_tag_map_counts", sql_with("""
SELECT tag, wn, count(*) AS n_tokens FROM (
  SELECT tag, CASE WHEN starts_with(tag, 'A') THEN 'a' WHEN starts_with(tag, 'V') THEN 'v'
                   WHEN tag IN ('N', 'S', 'Z', 'L', 'M') THEN 'n' WHEN starts_with(tag, 'R') THEN 'r'
                   ELSE '' END AS wn
  FROM (SELECT unnest(string_split(tags, ' ')) AS tag FROM posts))
GROUP BY tag, wn""", "posts"))
def t7_tag_map_counts(spark, sf_dir):
    p = X.posts(spark, sf_dir)
    tags = p.select(F.explode(F.split("tags", " ")).alias("tag"))
    return tags.select("tag", T.wordnet_pos(F.col("tag")).alias("wn")) \
        .groupBy("tag", "wn").agg(F.count(F.lit(1)).alias("n_tokens"))


@register("p11_nonzero_score_counts", sql_with("""
SELECT sign, count(*) AS n_posts FROM (
  SELECT CASE WHEN score > 0 THEN 'pos' ELSE 'neg' END AS sign
  FROM (SELECT t.post_id, CAST(coalesce(sum(a.weight), 0) AS DOUBLE) AS score
        FROM (SELECT post_id, unnest(string_split(lower(text), ' ')) AS word FROM clean_posts) t
        LEFT JOIN afinn a ON a.word = t.word GROUP BY t.post_id)
  WHERE score <> 0)
GROUP BY sign""", "clean_posts", "afinn"))
def p11_nonzero_score_counts(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    s = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    return s.where(F.col("score") != 0).select(
        F.when(F.col("score") > 0, "pos").otherwise("neg").alias("sign")) \
        .groupBy("sign").agg(F.count(F.lit(1)).alias("n_posts"))
