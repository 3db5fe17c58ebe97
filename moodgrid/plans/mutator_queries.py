"""Queries: mutators (U3–U12, J2–J5, P10), their profile (A5) and
filter-as-classifier evaluation (A12, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import etl as E
from ..operators import metrics as MT
from ..operators import mutators as M
from ..operators.lookup import sized_lookup
from ..sources import fixtures as X
from ..sources.fixtures_sql import sql_with
from ..sources.tables import table
from .registry import register

AF_T, AF_W = C.MUTATOR_SETTINGS["af"]
CL_T, CL_W = C.MUTATOR_SETTINGS["cl"]
TD = M.TIE_DIGITS

# ---------------------------------------------------------------------------
# shared SQL fragments
# ---------------------------------------------------------------------------

AF_SCORE = """_af AS (SELECT t.post_id, CAST(coalesce(sum(a.weight), 0) AS DOUBLE) AS score, count(*) AS n_tok
  FROM (SELECT post_id, unnest(string_split(lower(text), ' ')) AS word FROM clean_posts) t
  LEFT JOIN afinn a ON a.word = t.word GROUP BY t.post_id)"""

SIM = ("CASE WHEN length(v.tok) = 0 AND length(c.word) = 0 THEN 1.0 "
       "WHEN length(v.tok) = 0 OR length(c.word) = 0 THEN 0.0 "
       "ELSE 1.0 - levenshtein(regexp_replace(v.tok, '[^\\x00-\\x7F]', '#', 'g'), c.word)::DOUBLE "
       "/ greatest(length(v.tok), length(c.word)) END")

J5 = f"""_occ AS (SELECT post_id, lower(unnest(string_split(text, ' '))) AS tok FROM clean_posts)
, _nt AS (SELECT post_id, count(*) AS n_tok FROM _occ GROUP BY post_id)
, _voc AS (SELECT DISTINCT tok FROM _occ)
, _best AS (SELECT v.tok, c.cluster, max({SIM}) AS sim FROM _voc v, word_clusters c GROUP BY v.tok, c.cluster)
, _j5 AS (SELECT o.post_id, b.cluster, round(sum(b.sim) / n.n_tok, {TD}) AS score
          FROM _occ o JOIN _best b ON b.tok = o.tok JOIN _nt n ON n.post_id = o.post_id
          GROUP BY o.post_id, b.cluster, n.n_tok)"""

U8 = f"""{J5}
, _win AS (SELECT post_id, cluster, score FROM (
     SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, cluster) AS rn
     FROM _j5 WHERE score > 0) WHERE rn = 1)
, _u8 AS (SELECT p.post_id,
     coalesce(CASE WHEN s.sentiment = 'positive' THEN w.score WHEN s.sentiment = 'negative' THEN -w.score
                   ELSE 0.0 END, 0.0) AS score
   FROM clean_posts p LEFT JOIN _win w ON w.post_id = p.post_id
   LEFT JOIN cluster_sentiment s ON s.cluster = w.cluster)"""

_TAGGED = """_tt AS (SELECT post_id, unnest(t) AS tok, unnest(g) AS tag, unnest(range(0, len(t))) AS i
  FROM (SELECT post_id, string_split(text, ' ') AS t,
               list_filter(string_split(tags, ''), lambda c, k: k % 2 = 1) AS g FROM clean_posts))
, _wp AS (SELECT post_id, i, tok,
     CASE WHEN starts_with(tag, 'A') THEN 'a' WHEN starts_with(tag, 'V') THEN 'v'
          WHEN tag IN ('N', 'S', 'Z', 'L', 'M') THEN 'n' WHEN starts_with(tag, 'R') THEN 'r' ELSE '' END AS pos
   FROM _tt WHERE tok IS NOT NULL)"""


def words_sql(lemma: str = "lemma", words: str = "afinn") -> str:
    return f"""{_TAGGED}
, _lm AS (SELECT w.post_id, w.i, w.pos, coalesce(l.lemma, w.tok) AS word
   FROM _wp w LEFT JOIN {lemma} l ON l.form = w.tok AND l.pos = w.pos WHERE w.pos <> '')
, _kw AS (SELECT post_id, word, arg_max(pos, i) AS pos FROM _lm
          WHERE word IN (SELECT word FROM {words}) GROUP BY post_id, word)"""


def u9_scores_sql(similarity: str = "similarity", scheme: str = "path") -> str:
    return f"""_us AS (SELECT k.post_id, c.cluster, sum(s.score) AS s
   FROM _kw k JOIN {similarity} s ON s.word_a = k.word AND s.pos = k.pos AND s.scheme = '{scheme}'
   JOIN word_clusters c ON c.word = s.word_b GROUP BY k.post_id, c.cluster)
, _u9 AS (SELECT u.post_id, u.cluster, round(u.s / len(string_split(p.text, ' ')), {TD}) AS score
   FROM _us u JOIN clean_posts p ON p.post_id = u.post_id)"""


WORDS = words_sql()
U9 = f"""{WORDS}
, {u9_scores_sql()}"""


def _margins_weighted_sql(delta_cte: str) -> str:
    return f"""
SELECT m.post_id, m.label, round(m.margin + coalesce(d.delta, 0), 6) AS margin
FROM margins m LEFT JOIN (SELECT post_id, label, sum(delta) AS delta FROM ({delta_cte}) GROUP BY post_id, label) d
  ON d.post_id = m.post_id AND d.label = m.label"""


def _deltas_sql(src: str, w: float, per_token: bool) -> str:
    s = "(score / n_tok)" if per_token else "score"
    return (f"SELECT post_id, 1 AS label, CASE WHEN {s} > 0 THEN {w}::DOUBLE * {s} ELSE 0.0 END AS delta FROM {src}\n"
            f"UNION ALL SELECT post_id, 2 AS label, CASE WHEN {s} < 0 THEN -{w}::DOUBLE * {s} ELSE 0.0 END FROM {src}")


def _round_margins(df):
    return df.select("post_id", "label", F.round("margin", 6).alias("margin"))


# ---------------------------------------------------------------------------
# U3 / U4 word list
# ---------------------------------------------------------------------------

@register("u3_afinn_scores", sql_with(f", {AF_SCORE}\nSELECT post_id, score, n_tok FROM _af",
                                      "clean_posts", "afinn"))
def u3_afinn_scores(spark, sf_dir):
    return M.afinn_score(X.clean_posts(spark, sf_dir), sized_lookup(X.afinn(spark, sf_dir)))


@register("u4_afinn_weighting", sql_with(f", {AF_SCORE}\n" + _margins_weighted_sql(_deltas_sql("_af", AF_W, True)),
                                         "clean_posts", "afinn", "margins"))
def u4_afinn_weighting(spark, sf_dir):
    s = M.afinn_score(X.clean_posts(spark, sf_dir), sized_lookup(X.afinn(spark, sf_dir)))
    return _round_margins(M.apply_weightings(X.margins(spark, sf_dir), [M.weight_deltas(s, AF_W, per_token=True)]))


# ---------------------------------------------------------------------------
# J5 / U8 / U11 edit-distance clusters
# ---------------------------------------------------------------------------

def _u8(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    return M.edit_cluster_score(p, X.word_clusters(spark, sf_dir), X.cluster_sentiment(spark))


@register("j5_edit_cluster_scores", sql_with(f", {J5}\nSELECT post_id, cluster, round(score, 6) AS score FROM _j5",
                                             "clean_posts", "word_clusters"))
def j5_edit_cluster_scores(spark, sf_dir):
    s = M.edit_cluster_scores(X.clean_posts(spark, sf_dir), X.word_clusters(spark, sf_dir))
    return s.select("post_id", "cluster", F.round("score", 6).alias("score"))


@register("u8_edit_cluster_score", sql_with(f", {U8}\nSELECT post_id, round(score, 6) AS score FROM _u8",
                                            "clean_posts", "word_clusters", "cluster_sentiment"))
def u8_edit_cluster_score(spark, sf_dir):
    return _u8(spark, sf_dir).select("post_id", F.round("score", 6).alias("score"))


@register("u11_cluster_weighting", sql_with(f", {U8}\n" + _margins_weighted_sql(_deltas_sql("_u8", CL_W, False)),
                                            "clean_posts", "word_clusters", "cluster_sentiment", "margins"))
def u11_cluster_weighting(spark, sf_dir):
    s = _u8(spark, sf_dir)
    return _round_margins(M.apply_weightings(X.margins(spark, sf_dir), [M.weight_deltas(s, CL_W)]))


@register("u12_combined_weighting", sql_with(
    f", {AF_SCORE}\n, {U8}\n" + _margins_weighted_sql(
        _deltas_sql("_af", AF_W, True) + "\nUNION ALL\n" + _deltas_sql("_u8", CL_W, False)),
    "clean_posts", "afinn", "word_clusters", "cluster_sentiment", "margins"))
def u12_combined_weighting(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    af = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    u8 = _u8(spark, sf_dir)
    deltas = [M.weight_deltas(af, AF_W, per_token=True), M.weight_deltas(u8, CL_W)]
    return _round_margins(M.apply_weightings(X.margins(spark, sf_dir), deltas))


# ---------------------------------------------------------------------------
# J4 / U9 / U10 similarity-table clusters
# ---------------------------------------------------------------------------

def _kw_inputs(spark, sf_dir):
    return (X.clean_posts(spark, sf_dir), sized_lookup(X.lemma(spark, sf_dir)),
            sized_lookup(X.afinn(spark, sf_dir).select("word")))


@register("j4_wordnet_pairs", sql_with(f"""
, {WORDS}
SELECT k.post_id, c.cluster, count(DISTINCT k.word) AS n_words, count(*) AS n_pairs
FROM _kw k, word_clusters c GROUP BY k.post_id, c.cluster""", "clean_posts", "lemma", "afinn", "word_clusters"))
def j4_wordnet_pairs(spark, sf_dir):
    p, lem, words = _kw_inputs(spark, sf_dir)
    return M.wordnet_pair_counts(p, lem, words, X.word_clusters(spark, sf_dir))


@register("u9_similarity_cluster_scores", sql_with(f", {U9}\nSELECT post_id, cluster, round(score, 6) AS score FROM _u9",
                                                   "clean_posts", "lemma", "afinn", "word_clusters", "similarity"))
def u9_similarity_cluster_scores(spark, sf_dir):
    p, lem, words = _kw_inputs(spark, sf_dir)
    s = M.similarity_cluster_scores(p, lem, words, X.word_clusters(spark, sf_dir),
                                    sized_lookup(X.similarity(spark, sf_dir)))
    return s.select("post_id", "cluster", F.round("score", 6).alias("score"))


@register("u10_similarity_diff", sql_with(f"""
, {U9}
, _j AS (SELECT u.post_id, u.cluster, u.score, s.sentiment FROM _u9 u LEFT JOIN cluster_sentiment s ON s.cluster = u.cluster)
, _w AS (SELECT post_id, score, sentiment FROM (
     SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, cluster) AS rn FROM _j) WHERE rn = 1)
, _d AS (SELECT w.post_id, w.sentiment,
     w.score - coalesce((SELECT sum(j.score) FROM _j j WHERE j.post_id = w.post_id
                          AND j.sentiment IS DISTINCT FROM w.sentiment), 0) AS d FROM _w w)
SELECT p.post_id, round(coalesce(CASE WHEN d.sentiment = 'positive' THEN d.d
                                      WHEN d.sentiment = 'negative' THEN -d.d ELSE 0.0 END, 0.0), 6) AS score
FROM clean_posts p LEFT JOIN _d d ON d.post_id = p.post_id""",
    "clean_posts", "lemma", "afinn", "word_clusters", "similarity", "cluster_sentiment"))
def u10_similarity_diff(spark, sf_dir):
    p, lem, words = _kw_inputs(spark, sf_dir)
    s = M.similarity_cluster_scores(p, lem, words, X.word_clusters(spark, sf_dir),
                                    sized_lookup(X.similarity(spark, sf_dir)))
    d = M.similarity_diff(s, X.cluster_sentiment(spark), p)
    return d.select("post_id", F.round("score", 6).alias("score"))


_U10 = """_uj AS (SELECT u.post_id, u.cluster, u.score, s.sentiment FROM _u9 u
   LEFT JOIN cluster_sentiment s ON s.cluster = u.cluster)
, _uw AS (SELECT post_id, score, sentiment FROM (
     SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, cluster) AS rn FROM _uj) WHERE rn = 1)
, _ud AS (SELECT w.post_id, w.sentiment, w.score - coalesce((SELECT sum(j.score) FROM _uj j
     WHERE j.post_id = w.post_id AND j.sentiment IS DISTINCT FROM w.sentiment), 0) AS d FROM _uw w)
, _u10 AS (SELECT p.post_id, coalesce(CASE WHEN d.sentiment = 'positive' THEN d.d
     WHEN d.sentiment = 'negative' THEN -d.d ELSE 0.0 END, 0.0) AS score
   FROM clean_posts p LEFT JOIN _ud d ON d.post_id = p.post_id)"""


@register("u11_wordnet_weighting", sql_with(
    f", {U9}\n, {_U10}\n" + _margins_weighted_sql(_deltas_sql("_u10", CL_W, False)),
    "clean_posts", "lemma", "afinn", "word_clusters", "similarity", "cluster_sentiment", "margins"))
def u11_wordnet_weighting(spark, sf_dir):
    """U11, second mode: margins weighted by the U10 scores."""
    p, lem, words = _kw_inputs(spark, sf_dir)
    s = M.similarity_cluster_scores(p, lem, words, X.word_clusters(spark, sf_dir),
                                    sized_lookup(X.similarity(spark, sf_dir)))
    d = M.similarity_diff(s, X.cluster_sentiment(spark), p)
    return _round_margins(M.apply_weightings(X.margins(spark, sf_dir), [M.weight_deltas(d, CL_W)]))


KM_T, KM_W = C.MUTATOR_SETTINGS["km"]


@register("u7_cluster_weighting", sql_with("""
, _ix AS (SELECT cluster, sentiment, size::DOUBLE / (SELECT sum(size) FROM auto_cluster_index) AS share
          FROM auto_cluster_index)
, _u7 AS (SELECT e.vec_id AS post_id, CASE i.sentiment WHEN 'positive' THEN i.share WHEN 'negative' THEN -i.share
                                      ELSE 0.0 END AS score
          FROM embeddings e LEFT JOIN _ix i ON i.cluster = e.label)""" +
    _margins_weighted_sql(_deltas_sql("_u7", KM_W, False)), "auto_cluster_index", "margins"))
def u7_cluster_weighting(spark, sf_dir):
    """Margins weighted by labelled-cluster scores, here the share of
    the post's own cluster, signed by the cluster's sentiment."""
    index = E.cluster_index_table(X.auto_cluster_index(spark, sf_dir))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("label").alias("cluster"))
    sign = F.when(F.col("flag") == C.POS, F.col("share")).when(F.col("flag") == C.NEG, -F.col("share")).otherwise(0.0)
    s = e.join(sized_lookup(index), "cluster", "left").select("post_id", sign.alias("score"))
    return _round_margins(M.apply_weightings(X.margins(spark, sf_dir), [M.weight_deltas(s, KM_W)]))


def _in_range(score: str, label: str, t: float) -> str:
    return (f"CASE {label} WHEN 1 THEN {score} > {t} WHEN 2 THEN {score} < -{t} "
            f"ELSE {score} > -{t} AND {score} < {t} END")


@register("u12_two_filters", sql_with(f"""
, {AF_SCORE}
, {U8}
SELECT m.post_id, m.label FROM margins m JOIN _af a ON a.post_id = m.post_id JOIN _u8 u ON u.post_id = m.post_id
WHERE {_in_range("a.score", "m.label", AF_T)} AND {_in_range("u.score", "m.label", CL_T / 10)}""",
    "clean_posts", "afinn", "word_clusters", "cluster_sentiment", "margins"))
def u12_two_filters(spark, sf_dir):
    """A candidate stays only if both mutators' filters accept it."""
    p = X.clean_posts(spark, sf_dir)
    af = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir))).select("post_id", "score")
    cands = X.margins(spark, sf_dir).select("post_id", "label")
    return M.apply_filters(cands, [(af, M.symmetric_ranges(spark, AF_T)),
                                   (_u8(spark, sf_dir), M.symmetric_ranges(spark, CL_T / 10))])


# ---------------------------------------------------------------------------
# P10 / A12 / A13 filters as classifiers, A5 profile
# ---------------------------------------------------------------------------

SWEEP = [round(C.SWEEP_START + i * C.SWEEP_STEP, 10)
         for i in range(int(round((C.SWEEP_STOP - C.SWEEP_START) / C.SWEEP_STEP)) + 1)]


def _sweep_sql(points: list[float], scored_cte: str) -> str:
    pts = ", ".join(repr(p) for p in points)
    mp = C.SWEEP_MIN_PERCENT
    parts = []
    for lab in (C.POS, C.NEG, C.NEU):
        parts.append(f"SELECT threshold, n, {lab} AS label, fire_{lab} AS fired, hit_{lab} AS hits FROM _g")
    return f"""
, _sc AS ({scored_cte})
, _t AS (SELECT unnest([{pts}]::DOUBLE[]) AS threshold)
, _g AS (SELECT threshold, count(*) AS n,
    count(*) FILTER (WHERE s > threshold) AS fire_1, count(*) FILTER (WHERE s > threshold AND y = 1) AS hit_1,
    count(*) FILTER (WHERE s < -threshold) AS fire_2, count(*) FILTER (WHERE s < -threshold AND y = 2) AS hit_2,
    count(*) FILTER (WHERE s > -threshold AND s < threshold) AS fire_4,
    count(*) FILTER (WHERE s > -threshold AND s < threshold AND y = 4) AS hit_4
  FROM _sc, _t GROUP BY threshold)
SELECT threshold, label, fired,
  CASE WHEN fired < {mp}::DOUBLE * n THEN 0.0 WHEN fired = 0 THEN 0.0 ELSE hits::DOUBLE / fired END AS precision
FROM ({' UNION ALL '.join(parts)})"""


@register("a13_threshold_sweep", sql_with(
    f", {U8}" + _sweep_sql(SWEEP, "SELECT p.label AS y, u.score AS s FROM clean_posts p JOIN _u8 u ON u.post_id = p.post_id "
                                  "WHERE p.label IS NOT NULL"),
    "clean_posts", "word_clusters", "cluster_sentiment"))
def a13_threshold_sweep(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    u8 = _u8(spark, sf_dir)
    scored = p.where(F.col("label").isNotNull()).select("post_id", "label").join(u8, "post_id")
    return MT.threshold_sweep(scored)


@register("a12_precision_at_coverage", sql_with(
    f", {AF_SCORE}" + _sweep_sql([AF_T], "SELECT p.label AS y, a.score AS s FROM clean_posts p "
                                         "JOIN _af a ON a.post_id = p.post_id WHERE p.label IS NOT NULL"),
    "clean_posts", "afinn"))
def a12_precision_at_coverage(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    s = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    scored = p.where(F.col("label").isNotNull()).select("post_id", "label").join(s, "post_id")
    return MT.threshold_sweep(scored, points=F.array(F.lit(float(AF_T))))


@register("p10_range_filter_candidates", sql_with(f"""
, {AF_SCORE}
SELECT a.post_id, r.label, a.score
FROM _af a JOIN (VALUES (1, {AF_T}::DOUBLE, 'inf'::DOUBLE), (2, '-inf'::DOUBLE, -{AF_T}::DOUBLE),
                        (4, -{AF_T}::DOUBLE, {AF_T}::DOUBLE)) AS r(label, lo, hi)
  ON a.score > r.lo AND a.score < r.hi""", "clean_posts", "afinn"))
def p10_range_filter_candidates(spark, sf_dir):
    s = M.afinn_score(X.clean_posts(spark, sf_dir), sized_lookup(X.afinn(spark, sf_dir)))
    return M.range_labels(s.select("post_id", "score"), M.symmetric_ranges(spark, AF_T)) \
        .select("post_id", "label", "score")


_A5_DELTAS = f""", {AF_SCORE}
, _dl AS ({_deltas_sql("_af", 1.0, True)})
, _nz AS (SELECT CASE WHEN label = 1 THEN 'pos' ELSE 'neg' END AS side, delta AS v FROM _dl WHERE delta <> 0)"""


def _a5(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    s = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    n_rows = p.select(F.count(F.lit(1))).scalar()
    return MT.mutator_profile(M.weight_deltas(s, 1.0, per_token=True), n_rows)


@register("a5_profile_summary", sql_with(f"""{_A5_DELTAS}
, _fr AS (SELECT side, v, count(*) AS c FROM _nz GROUP BY side, v)
SELECT s.side, s.n, s.min_value, s.max_value, round(s.median, 6) AS median, round(s.mean, 6) AS mean,
       f.min_freq, f.max_freq,
       round((SELECT sum(v) FROM _nz) / (SELECT count(*) FROM clean_posts), 6) AS overall_mean
FROM (SELECT side, count(*) AS n, min(v) AS min_value, max(v) AS max_value,
             quantile_cont(v, 0.5) AS median, avg(v) AS mean FROM _nz GROUP BY side) s
JOIN (SELECT side, min(c) AS min_freq, max(c) AS max_freq FROM _fr GROUP BY side) f ON f.side = s.side""",
    "clean_posts", "afinn"))
def a5_profile_summary(spark, sf_dir):
    summary, _ = _a5(spark, sf_dir)
    return summary.select("side", "n", "min_value", "max_value", F.round("median", 6).alias("median"),
                          F.round("mean", 6).alias("mean"), "min_freq", "max_freq",
                          F.round("overall_mean", 6).alias("overall_mean"))


@register("a5_profile_histogram", sql_with(f"""{_A5_DELTAS}
, _f AS (SELECT side, v, count(*) AS c FROM _nz GROUP BY side, v)
, _st AS (SELECT side, min(v) AS mn, max(v) AS mx FROM _f GROUP BY side)
, _b AS (SELECT _f.side, CASE WHEN mx = mn THEN 0
                     ELSE least({C.PROFILE_BUCKETS}, greatest(0, CAST(ceil((v - mn) / ((mx - mn) / {C.PROFILE_BUCKETS})) AS INTEGER))) END AS bucket,
                sum(c) AS n
         FROM _f JOIN _st ON _st.side = _f.side GROUP BY 1, 2)
, _e AS (SELECT side, CAST(unnest(range(0, CASE WHEN mx = mn THEN 0 ELSE {C.PROFILE_BUCKETS} END + 1)) AS INTEGER) AS bucket,
                mn, mx FROM _st)
SELECT _e.side, _e.bucket, _e.mn + _e.bucket * (_e.mx - _e.mn) / {C.PROFILE_BUCKETS} AS edge,
       CAST(coalesce(_b.n, 0) AS BIGINT) AS n
FROM _e LEFT JOIN _b ON _b.side = _e.side AND _b.bucket = _e.bucket""", "clean_posts", "afinn"))
def a5_profile_histogram(spark, sf_dir):
    _, hist = _a5(spark, sf_dir)
    return hist
