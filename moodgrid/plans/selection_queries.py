"""Queries: back-feed selection on a margins table (W5, K1, J9, X1, X5,
S5/K4) — the exactly checkable half of a self-training round."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import mutators as M
from ..operators import selection as SL
from ..operators.lookup import sized_lookup
from ..sources import fixtures as X
from ..sources.fixtures_sql import sql_with
from .mutator_queries import AF_SCORE, _deltas_sql
from .registry import register

AF_T, AF_W = C.MUTATOR_SETTINGS["af"]
NUM = C.BACKFEED_AMOUNT
K = int(NUM / 3)

LEAD_SQL = """_lead AS (SELECT post_id, label, margin,
  (count(*) OVER w * margin - sum(margin) OVER w) / (count(*) OVER w - 1) AS lead
  FROM {src} WINDOW w AS (PARTITION BY post_id))"""


@register("w5_margin_lead", sql_with(", " + LEAD_SQL.format(src="margins") +
                                     "\nSELECT post_id, label, round(lead, 6) AS lead FROM _lead", "margins"))
def w5_margin_lead(spark, sf_dir):
    return SL.margin_lead(X.margins(spark, sf_dir)).select("post_id", "label", F.round("lead", 6).alias("lead"))


@register("k1_topk_per_label", sql_with(", " + LEAD_SQL.format(src="margins") + f"""
SELECT post_id, label, round(lead, 6) AS lead, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY lead DESC, post_id DESC) AS rank FROM _lead)
WHERE rank <= {K}""", "margins"))
def k1_topk_per_label(spark, sf_dir):
    s = SL.select_best(X.margins(spark, sf_dir), NUM)
    return s.select("post_id", "label", F.round("lead", 6).alias("lead"), F.col("rank").cast("long").alias("rank"))


def _weighted_filtered_selection(spark, sf_dir):
    """M10 selection with both mutator modes: weight the margins with the
    word-list mutator, then keep only candidates inside its ranges."""
    p = X.clean_posts(spark, sf_dir)
    af = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    weighted = M.apply_weightings(X.margins(spark, sf_dir), [M.weight_deltas(af, AF_W, per_token=True)])
    cands = M.apply_filters(weighted.select("post_id", "label"),
                            [(af.select("post_id", "score"), M.symmetric_ranges(spark, AF_T))])
    return SL.select_best(weighted, NUM, candidate_filter=cands)


_SEL_SQL = f""", {AF_SCORE}
, _wm AS (SELECT m.post_id, m.label, m.margin + coalesce(d.delta, 0) AS margin
          FROM margins m LEFT JOIN (SELECT post_id, label, sum(delta) AS delta
                                    FROM ({_deltas_sql('_af', AF_W, True)}) GROUP BY post_id, label) d
            ON d.post_id = m.post_id AND d.label = m.label)
, {LEAD_SQL.format(src='_wm')}
, _ok AS (SELECT l.* FROM _lead l JOIN _af a ON a.post_id = l.post_id
          WHERE (l.label = 1 AND a.score > {AF_T}::DOUBLE) OR (l.label = 2 AND a.score < -{AF_T}::DOUBLE)
             OR (l.label = 4 AND a.score > -{AF_T}::DOUBLE AND a.score < {AF_T}::DOUBLE))
, _sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lead DESC, post_id DESC) AS rank
                          FROM _ok) WHERE rank <= {K})"""


@register("m10_backfeed_selection", sql_with(_SEL_SQL + """
SELECT post_id, label, round(lead, 6) AS lead, rank FROM _sel""", "clean_posts", "afinn", "margins"))
def m10_backfeed_selection(spark, sf_dir):
    s = _weighted_filtered_selection(spark, sf_dir)
    return s.select("post_id", "label", F.round("lead", 6).alias("lead"), F.col("rank").cast("long").alias("rank"))


@register("j9_pool_after_removal", sql_with(_SEL_SQL + """
SELECT post_id FROM (SELECT DISTINCT post_id FROM margins) WHERE post_id NOT IN (SELECT post_id FROM _sel)""",
    "clean_posts", "afinn", "margins"))
def j9_pool_after_removal(spark, sf_dir):
    pool = X.margins(spark, sf_dir).select("post_id").distinct()
    return SL.remove_selected(pool, _weighted_filtered_selection(spark, sf_dir))


@register("x1_training_set_append", sql_with(_SEL_SQL + """
SELECT post_id, label, 'train' AS source FROM clean_posts WHERE label IS NOT NULL
UNION ALL
SELECT post_id, label, 'backfeed' AS source FROM _sel""", "clean_posts", "afinn", "margins"))
def x1_training_set_append(spark, sf_dir):
    train = X.clean_posts(spark, sf_dir).where(F.col("label").isNotNull()) \
        .select("post_id", "label", F.lit("train").alias("source"))
    sel = _weighted_filtered_selection(spark, sf_dir).select("post_id", "label", F.lit("backfeed").alias("source"))
    return SL.append_selected(train, sel)


@register("x5_balanced_sample", sql_with("""
SELECT post_id, label FROM (
  SELECT post_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(post_id AS VARCHAR) || ':7'), post_id) AS r
  FROM clean_posts WHERE label IS NOT NULL)
WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM clean_posts WHERE label IS NOT NULL GROUP BY label))""",
    "clean_posts"))
def x5_balanced_sample(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir).where(F.col("label").isNotNull()).select("post_id", "label")
    return SL.balanced_sample(p, seed=7)


@register("s5_corpus_sample", sql_with("""
SELECT post_id, text FROM clean_posts WHERE label IS NULL
ORDER BY md5(CAST(post_id AS VARCHAR) || ':11'), post_id LIMIT 200""", "clean_posts"))
def s5_corpus_sample(spark, sf_dir):
    pool = X.clean_posts(spark, sf_dir).where(F.col("label").isNull()).select("post_id", "text")
    return SL.sample_corpus(pool, 200, seed=11)
