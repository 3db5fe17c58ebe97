"""Queries: learning jobs.  Trained models have no SQL twin; companions
check what holds for any right result (optimality, maintained counts,
draws and assignments that SQL recomputes)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import kmeans as KM
from ..operators import linear as LM
from ..operators import mutators as M
from ..operators.lookup import materialise, sized_lookup
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from ..sources.fixtures_sql import sql_with
from ..sources.tables import table
from . import learn as LR
from .registry import register

AF_T, AF_W = C.MUTATOR_SETTINGS["af"]


def _split(spark, sf_dir, union: LR.Union = LR.Union()):
    """Featurised posts and the train / dev / pool split: labelled posts
    are split 80/20 by a seeded hash of the id, unlabelled posts are the
    back-feed pool."""
    p = materialise(X.clean_posts(spark, sf_dir))
    feats = LR.feature_table(p, X.lexicon(spark, sf_dir), union)
    h = F.conv(F.substring(F.md5(F.col("post_id").cast("string")), 1, 8), 16, 10).cast("long") % 10
    known = feats.where(F.col("label").isNotNull())
    return p, feats, known.where(h < 8), known.where(h >= 8), feats.where(F.col("label").isNull())


@register("m1_svm_predictions")
def m1_svm_predictions(spark, sf_dir):
    _, _, train, dev, _ = _split(spark, sf_dir)
    model = LR.fit_svm(train)
    return LR.predict(model, dev)


@register("m5_class_margins")
def m5_class_margins(spark, sf_dir):
    _, _, train, _, pool = _split(spark, sf_dir)
    return LR.class_margins(LR.fit_svm(train), pool)


def _main_run(spark, sf_dir, mutator: str):
    """One mutator setting as a hard filter, 5 rounds of 300."""
    p, feats, train, dev, pool = _split(spark, sf_dir)
    scores = {
        "cl": lambda: M.edit_cluster_score(p, X.word_clusters(spark, sf_dir), X.cluster_sentiment(spark)),
        "af": lambda: M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir))).select("post_id", "score"),
        "km": lambda: _km_scores(feats),
    }[mutator]()
    return LR.backfeed_run(train, dev, pool, rounds=C.MAIN_ROUNDS, amount=C.BACKFEED_AMOUNT,
                           filters=[(materialise(scores), M.symmetric_ranges(spark, C.MUTATOR_SETTINGS[mutator][0]))])


@register("m11_backfeed_rounds")
def m11_backfeed_rounds(spark, sf_dir):
    return _main_run(spark, sf_dir, "af")


@register("m11_backfeed_rounds_cl")
def m11_backfeed_rounds_cl(spark, sf_dir):
    return _main_run(spark, sf_dir, "cl")


@register("m11_backfeed_rounds_km")
def m11_backfeed_rounds_km(spark, sf_dir):
    return _main_run(spark, sf_dir, "km")


@register("m12_backfeed_weighted_append")
def m12_backfeed_weighted_append(spark, sf_dir):
    """Older run on the older union: load the model or train and save it,
    word-list mutator as weight, picks kept and removed from the pool
    (append mode), 2 rounds.  The model folder of a run is new, so the first
    call trains and the back-feed goes on from the loaded model."""
    p, _, train, dev, pool = _split(spark, sf_dir, LR.OLD_UNION)
    path = f"{ensure_checkpoint_dir(spark)}/old-model-{uuid.uuid4().hex}"
    LM.load_or_train(spark, path, lambda: LR.fit_svm(train, union=LR.OLD_UNION))
    model = LM.load_or_train(spark, path, lambda: None)
    af = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    return LR.backfeed_run(train, dev, pool, rounds=2, amount=C.BACKFEED_AMOUNT,
                           weighters=[(af, AF_W, True)], append=True, first=model, union=LR.OLD_UNION)


@register("m8_kmeans_restarts")
def m8_kmeans_restarts(spark, sf_dir):
    _, _, train, _, pool = _split(spark, sf_dir)
    ref = LR.predict(LR.fit_svm(train), pool)
    sink = f"{ensure_checkpoint_dir(spark)}/kmeans-best-labels-{uuid.uuid4().hex}"
    return LR.kmeans_restart_search(pool, ref, restarts=C.KMEANS_RESTARTS, sink=sink)


@register("m2_grid_search")
def m2_grid_search(spark, sf_dir):
    _, _, train, _, _ = _split(spark, sf_dir, LR.OLD_UNION)
    _, res = LR.grid_search(train)
    return res


def _km_scores(feats):
    """U5 scores of one fitted clustering and its own index."""
    vec, centers = LR.labelled_cluster_fit(feats)
    d = materialise(LR.cluster_distances(feats, vec, centers, ("post_id", "label")))
    near = F.array_position("d", F.array_min("d")).cast("int") - 1
    index = LR.fitted_cluster_index(d.select("post_id", "label", near.alias("cluster")))
    return LR.labelled_cluster_score(d, index)


@register("u5_labelled_cluster_score")
def u5_labelled_cluster_score(spark, sf_dir):
    _, feats, _, _, _ = _split(spark, sf_dir)
    return _km_scores(feats)


def _reloaded(spark, model):
    path = f"{ensure_checkpoint_dir(spark)}/svm-model-{uuid.uuid4().hex}"
    LR.save_model(model, path, spark)
    return LR.load_model(path, spark)


@register("s20_model_roundtrip")
def s20_model_roundtrip(spark, sf_dir):
    _, _, train, dev, _ = _split(spark, sf_dir)
    return LR.predict(_reloaded(spark, LR.fit_svm(train)), dev)


_TRAIN_SQL = """
FROM (SELECT label, CAST(('0x' || substr(md5(CAST(post_id AS VARCHAR)), 1, 8))::UBIGINT % 10 AS BIGINT) AS h
      FROM clean_posts WHERE label IS NOT NULL) WHERE h < 8"""


@register("m1_optimality", sql_with(f"""
SELECT f.flag, (SELECT count(*) {_TRAIN_SQL}) AS n_rows, true AS gap_closed, true AS gradient_small
FROM (VALUES (1), (2), (4)) AS f(flag)""", "clean_posts"))
def m1_optimality(spark, sf_dir):
    """M1's models are at the optimum: the solver's duality gap is below its
    tolerance, and the gradient at the returned weights, computed anew by
    joins over the training rows' features, is below 1 % of the one at zero."""
    _, _, train, _, _ = _split(spark, sf_dir)
    model = LR.fit_svm(train)
    gaps = F.array(*[F.lit(bool(g <= LM.TOLERANCE)) for g in model.gaps])
    return LM.gradient_norms(model, train).select(
        "flag", "n_rows", F.get(gaps, F.col("model")).alias("gap_closed"), (F.col("relative") <= 0.01).alias("gradient_small"))


@register("m11_incremental_idf", """
SELECT r.round::INT AS round, 0::BIGINT AS n_differ, true AS same_rows, true AS gaps_closed FROM range(0, 4) AS r(round)""")
def m11_incremental_idf(spark, sf_dir):
    """After every back-feed round (append mode), the document frequencies
    kept up to date from the picks equal a recount over all training rows,
    and the warm-started fit has closed its duality gap."""
    p, _, train, _, pool = _split(spark, sf_dir)
    af = M.afinn_score(p, sized_lookup(X.afinn(spark, sf_dir)))
    out = []
    for i, r in enumerate(LR.backfeed_rounds(train, pool, 3, C.BACKFEED_AMOUNT, weighters=[(af, AF_W, True)], append=True)):
        again = LR.vectoriser(r.train)
        out.append((i, int((again.df != r.vec.df).sum()), again.n == r.vec.n, bool((r.model.gaps <= LM.TOLERANCE).all())))
    return spark.createDataFrame(out, "round int, n_differ bigint, same_rows boolean, gaps_closed boolean")


_DEV_SQL = """
FROM (SELECT CAST(('0x' || substr(md5(CAST(post_id AS VARCHAR)), 1, 8))::UBIGINT % 10 AS BIGINT) AS h
      FROM clean_posts WHERE label IS NOT NULL) WHERE h >= 8"""


@register("s20_roundtrip_agreement", sql_with(f"""
SELECT count(*) AS n_posts, count(*) AS n_valid, 0::BIGINT AS n_differ, 0::BIGINT AS n_not_largest {_DEV_SQL}""",
    "clean_posts"))
def s20_roundtrip_agreement(spark, sf_dir):
    """Checks of M1, M5, M9 and S20 that hold for any fit: every dev post
    has one prediction in {1, 2, 4}; a saved and reloaded model predicts
    the same; the predicted class has the largest margin."""
    _, _, train, dev, _ = _split(spark, sf_dir)
    model = LR.fit_svm(train)
    first = LR.predict(model, dev)
    again = LR.predict(_reloaded(spark, model), dev).withColumnRenamed("pred", "pred2")
    top = LR.class_margins(model, dev).groupBy("post_id").agg(F.max("margin").alias("top"), F.max_by(
        "label", F.struct("margin", (-F.col("label")).alias("x"))).alias("best"))
    both = first.join(again, "post_id").join(top, "post_id")
    return both.agg(
        F.countDistinct("post_id").alias("n_posts"), F.count(F.when(F.col("pred").isin(*LR.CLASSES), 1)).alias("n_valid"),
        F.count(F.when(F.col("pred") != F.col("pred2"), 1)).alias("n_differ"),
        F.count(F.when(F.col("pred") != F.col("best"), 1)).alias("n_not_largest"))


_GRID = ", ".join(f"({float(c)}::DOUBLE, {f})" for c in C.OLD_SVM_C_GRID for f in range(3))


@register("a14_parameter_shares", f"""
WITH g(c, f) AS (VALUES {_GRID})
SELECT param, value, count(*)::DOUBLE / (SELECT count(*) FROM g) AS share
FROM (SELECT 'C' AS param, c::VARCHAR AS value FROM g UNION ALL SELECT 'fold', f::VARCHAR FROM g) GROUP BY param, value""")
def a14_parameter_shares(spark, sf_dir):
    """A14 over the runs of the grid search (M2)."""
    return LR.parameter_shares(m2_grid_search(spark, sf_dir), ["C", "fold"])


# ---------------------------------------------------------------------------
# M4, M8 on dense vectors
# ---------------------------------------------------------------------------

SEEDS = list(range(10))
LLOYD_ROUNDS = 6


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _seeding_sql(k: int) -> str:
    """k-means++ draws as a chain of steps: the smallest -ln(u) / D."""
    u = lambda t: f"(('0x' || substr(md5(v.id || ':' || s.seed || ':{t}'), 1, 13))::UBIGINT + 0.5) / 4503599627370496.0"
    dist = "pow(list_distance(v.e, c.e), 2)"
    parts = [f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)
, s AS (SELECT unnest(range(0, {len(SEEDS)})) AS seed)
, c0 AS (SELECT seed, arg_min(v.id, {u(0)}) AS id, arg_min(v.e, {u(0)}) AS e FROM v, s GROUP BY seed)
, d0 AS (SELECT s.seed, v.id, v.e, {dist} AS d FROM v, c0 c JOIN s USING (seed))"""]
    for t in range(1, k):
        parts.append(f"""c{t} AS (SELECT s.seed, arg_min(v.id, -ln({u(t)}) / v.d) AS id, arg_min(v.e, -ln({u(t)}) / v.d) AS e
         FROM d{t - 1} v JOIN s ON s.seed = v.seed WHERE v.d > 0 GROUP BY s.seed)
, d{t} AS (SELECT v.seed, v.id, v.e, least(v.d, {dist}) AS d FROM d{t - 1} v JOIN c{t} c ON c.seed = v.seed)""")
    return "\n, ".join(parts)


_CHOSEN = " UNION ALL ".join(f"SELECT seed, {t} AS step, id, e FROM c{t}" for t in range(C.KMEANS_K))


@register("m4_seeding", f"WITH {_seeding_sql(C.KMEANS_K)}\nSELECT seed::INT AS seed, step::INT AS step, id AS vec_id FROM ({_CHOSEN})")
def m4_seeding(spark, sf_dir):
    """M4: k-means++ draws of ten seeds."""
    _, chosen = KM.seed_centers(_vectors(spark, sf_dir), SEEDS, C.KMEANS_K)
    return spark.createDataFrame([(s, t, i) for s, per in zip(SEEDS, chosen) for t, i in enumerate(per)],
                                 "seed int, step int, vec_id bigint")


@register("m4_mini_batch")
def m4_mini_batch(spark, sf_dir):
    """M4: mini-batch k-means, batches of 1,000 rows; cluster of every vector."""
    x = _vectors(spark, sf_dir)
    start, _ = KM.seed_centers(x, [0], C.KMEANS_K)
    found = KM.mini_batch(x, start)
    return KM.assign(x, found.centers).select(F.col("id").alias("vec_id"), F.get("clusters", 0).alias("cluster"))


def _lloyd_sql(k: int, rounds: int) -> str:
    parts = [_seeding_sql(k), f"z0 AS (SELECT seed, step AS j, e FROM ({_CHOSEN}))"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT z.seed, v.id, any_value(v.e) AS e, any_value(v.label) AS label,
         arg_min(z.j, struct_pack(d := list_distance(v.e, z.e), j := z.j)) AS j FROM v, z{r} z GROUP BY z.seed, v.id)""")
        if r < rounds:
            parts.append(f"""z{r + 1} AS (SELECT z.seed, z.j, coalesce(m.e, z.e) AS e FROM z{r} z LEFT JOIN (
         SELECT seed, j, list(x ORDER BY i) AS e FROM (
           SELECT seed, j, i, avg(x) AS x FROM (SELECT seed, j, unnest(e) AS x, unnest(range(0, len(e))) AS i FROM a{r})
           GROUP BY seed, j, i) GROUP BY seed, j) m ON m.seed = z.seed AND m.j = z.j)""")
    return "\n, ".join(parts)


@register("m8_embedding_restarts", f"""WITH {_lloyd_sql(C.KMEANS_K, LLOYD_ROUNDS)}
, p AS (SELECT seed, j, label, count(*) AS n FROM a{LLOYD_ROUNDS} GROUP BY seed, j, label)
, q AS (SELECT seed, max(n) AS top, sum(n) AS size FROM p GROUP BY seed, j)
SELECT seed::INT AS seed, round((sum(top) / sum(size))::DOUBLE, 9) AS purity, count(*) AS n_clusters FROM q GROUP BY seed""")
def m8_embedding_restarts(spark, sf_dir):
    """M8 / K6 on the vectors: ten restarts, six Lloyd rounds each, all in
    the same passes; purity of every restart against the vectors' labels."""
    x = materialise(_vectors(spark, sf_dir))
    start, _ = KM.seed_centers(x, SEEDS, C.KMEANS_K)
    found = KM.lloyd(x, start, LLOYD_ROUNDS)
    return KM.restart_purity(KM.assign(x, found.centers, ("id", "label"))) \
        .select("seed", F.round("purity", 9).alias("purity"), "n_clusters")
