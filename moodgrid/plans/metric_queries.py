"""Queries: cluster statistics, histograms and classification metrics
(A1–A4, A7–A11, A15, A16, J13, T11, K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import metrics as MT
from ..operators import mutators as M
from ..operators.lookup import sized_lookup
from ..sources import fixtures as X
from ..sources.fixtures_sql import sql_with
from ..sources.tables import table
from .registry import register

K = C.PROFILE_BUCKETS


def _clusters(spark, sf_dir):
    """(post_id, cluster, truth, pred): predictions (C10) with the
    embedding label as cluster id; truth and prediction come from two
    tables paired by key (J13)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("label").alias("cluster"))
    p = X.predictions(spark, sf_dir)
    truth = p.select("post_id", "truth")
    pred = p.select("post_id", "pred")
    return e.join(truth, "post_id").join(pred, "post_id")


_CLU_SQL = """_clu AS (SELECT e.vec_id AS post_id, e.label AS cluster, t.truth, q.pred
  FROM embeddings e JOIN (SELECT post_id, truth FROM predictions) t ON t.post_id = e.vec_id
                    JOIN (SELECT post_id, pred FROM predictions) q ON q.post_id = e.vec_id)"""


@register("a1_cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def a1_cluster_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"))
    return MT.cluster_sizes(e)


@register("a2_cluster_prediction_counts", sql_with(f"""
, {_CLU_SQL}
SELECT cluster, pred, count(*) AS n FROM _clu GROUP BY cluster, pred""", "predictions"))
def a2_cluster_prediction_counts(spark, sf_dir):
    return MT.cluster_label_counts(_clusters(spark, sf_dir), "cluster", "pred")


@register("a3_cluster_purity", sql_with(f"""
, {_CLU_SQL}
SELECT sum(top)::DOUBLE / sum(size) AS purity, sum(size) AS n_rows, count(*) AS n_clusters
FROM (SELECT cluster, max(n) AS top, sum(n) AS size
      FROM (SELECT cluster, pred, count(*) AS n FROM _clu GROUP BY cluster, pred) GROUP BY cluster)""",
    "predictions"))
def a3_cluster_purity(spark, sf_dir):
    out = MT.purity(_clusters(spark, sf_dir), "cluster", "pred")
    return out.select("purity", F.col("n_rows").cast("long").alias("n_rows"), "n_clusters")


_SCORE_SQL = """_s AS (SELECT t.post_id, CAST(coalesce(sum(a.weight), 0) AS DOUBLE) AS score
  FROM (SELECT post_id, unnest(string_split(lower(text), ' ')) AS word FROM clean_posts) t
  LEFT JOIN afinn a ON a.word = t.word GROUP BY t.post_id)"""


@register("a4_score_histogram", sql_with(f"""
, {_SCORE_SQL}
, _f AS (SELECT score AS v, count(*) AS c FROM _s GROUP BY score)
, _st AS (SELECT min(v) AS mn, max(v) AS mx FROM _f)
, _b AS (SELECT CASE WHEN mx = mn THEN 0
                     ELSE least({K}, greatest(0, CAST(ceil((v - mn) / ((mx - mn) / {K})) AS INTEGER))) END AS bucket,
                sum(c) AS n
         FROM _f, _st GROUP BY 1)
, _e AS (SELECT CAST(unnest(range(0, CASE WHEN mx = mn THEN 0 ELSE {K} END + 1)) AS INTEGER) AS bucket, mn, mx FROM _st)
SELECT _e.bucket, _e.mn + _e.bucket * (_e.mx - _e.mn) / {K} AS edge, CAST(coalesce(_b.n, 0) AS BIGINT) AS n
FROM _e LEFT JOIN _b ON _b.bucket = _e.bucket""", "clean_posts", "afinn"))
def a4_score_histogram(spark, sf_dir):
    s = M.afinn_score(X.clean_posts(spark, sf_dir), sized_lookup(X.afinn(spark, sf_dir)))
    freq = s.groupBy(F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return MT.linear_histogram(freq, "v", K, weight_col="c")


_LABEL_SCORES_SQL = """
SELECT label, tp, fp, fn, tn,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2::DOUBLE * tp / (2::DOUBLE * tp + fp + fn) END AS f1,
  (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision
FROM (SELECT l.label,
        count(*) FILTER (WHERE pred = l.label AND truth = l.label) AS tp,
        count(*) FILTER (WHERE pred = l.label AND truth <> l.label) AS fp,
        count(*) FILTER (WHERE pred <> l.label AND truth = l.label) AS fn,
        count(*) FILTER (WHERE pred <> l.label AND truth <> l.label) AS tn
      FROM _clu, (VALUES (1), (2), (4)) AS l(label) GROUP BY l.label)"""


@register("a7_label_f1_precision", sql_with(f", {_CLU_SQL}\n{_LABEL_SCORES_SQL}", "predictions"))
def a7_label_f1_precision(spark, sf_dir):
    return MT.label_scores(_clusters(spark, sf_dir))


@register("a10_macro_report", sql_with(f"""
, {_CLU_SQL}
, _ls AS ({_LABEL_SCORES_SQL})
SELECT avg(f1) AS macro_f1, avg(accuracy) AS macro_accuracy,
       (SELECT (count(*) FILTER (WHERE truth = pred))::DOUBLE / count(*) FROM _clu) AS accuracy
FROM _ls""", "predictions"))
def a10_macro_report(spark, sf_dir):
    return MT.macro_report(_clusters(spark, sf_dir), C.POS | C.NEG | C.NEU)


@register("a11_three_class_report", sql_with(f"""
, {_CLU_SQL}
, _ls AS ({_LABEL_SCORES_SQL})
SELECT *, (f1_pos + f1_neg) / 2 AS macro_f1, (accuracy_pos + accuracy_neg) / 2 AS macro_accuracy
FROM (SELECT max(f1) FILTER (WHERE label = 1) AS f1_pos, max(accuracy) FILTER (WHERE label = 1) AS accuracy_pos,
             max(f1) FILTER (WHERE label = 2) AS f1_neg, max(accuracy) FILTER (WHERE label = 2) AS accuracy_neg,
             max(f1) FILTER (WHERE label = 4) AS f1_neu, max(accuracy) FILTER (WHERE label = 4) AS accuracy_neu
      FROM _ls)""", "predictions"))
def a11_three_class_report(spark, sf_dir):
    return MT.three_class_report(_clusters(spark, sf_dir))


@register("a15_cluster_size_shares", sql_with("""
, _cs AS (SELECT cluster, count(*) AS size FROM word_clusters GROUP BY cluster)
SELECT cluster, size, size::DOUBLE / (SELECT sum(size) FROM _cs) AS share FROM _cs""", "word_clusters"))
def a15_cluster_size_shares(spark, sf_dir):
    wc = X.word_clusters(spark, sf_dir)
    return MT.size_shares(wc.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))


@register("a16_last_label_per_text", sql_with("""
SELECT text, tags, arg_max(label, post_id) AS label, count(*) AS n_copies
FROM (SELECT post_id, text, tags, label FROM clean_posts WHERE label IS NOT NULL)
GROUP BY text, tags""", "clean_posts"))
def a16_last_label_per_text(spark, sf_dir):
    """De-duplicate on (text, tags); the last line's label wins."""
    p = X.clean_posts(spark, sf_dir).where(F.col("label").isNotNull())
    return p.groupBy("text", "tags").agg(F.max_by("label", "post_id").alias("label"),
                                         F.count(F.lit(1)).alias("n_copies"))
