"""Linear models, k-means, edit matching and term shards on small inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodgrid.operators import editmatch as EM
from moodgrid.operators import kmeans as KM
from moodgrid.operators import linear as LM
from moodgrid.operators import termshards as TS
from moodgrid.operators import tfidf as TF
from moodgrid.plans import learn as LR

SLOTS = 64


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(90):
        label = (1, 2, 4)[i % 3]
        slots = sorted({int(x) for x in rng.integers(0, 2 * SLOTS, 14)} | {label * 5})
        data.append((i, label, slots, [float(rng.integers(1, 4)) for _ in slots], [float(rng.normal()), 3.0]))
    return spark.createDataFrame(data, "post_id bigint, label int, idx array<int>, tf array<float>, dense array<double>")


def dense(rows, vec):
    x = {r["post_id"]: r for r in LM.feature_rows(rows, vec).collect()}
    ids = sorted(x)
    out = np.zeros((len(ids), vec.size))
    for k, i in enumerate(ids):
        out[k, x[i]["feature"]] = x[i]["value"]
    return np.array(ids), np.array([x[i]["label"] for i in ids]), out


def gradient(x, label, w, spec):
    y = np.where(label == spec.flag, 1.0, -1.0)
    return w - 2 * spec.c * (x.T @ (y * np.maximum(0.0, 1 - y * (x @ w))))


def test_features_follow_the_vectoriser(rows):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    data = rows.collect()
    df = np.zeros(2 * SLOTS)
    for r in data:
        df[r["idx"]] += 1
    assert (vec.df == df).all() and vec.n == len(data) and vec.top[1] == 3.0
    assert vec.top[0] == pytest.approx(max(abs(r["dense"][0]) for r in data))
    half = vec.plus(vec)
    assert half.n == 2 * vec.n and (half.df == 2 * vec.df).all()
    ids, _, x = dense(rows, vec)
    assert np.abs(np.linalg.norm(x[:, :SLOTS], axis=1) - 1).max() < 1e-9 and (x[:, -1] == 1).all()
    r = data[0]
    w = np.array([t * (np.log((1 + vec.n) / (1 + df[s])) + 1) * (df[s] <= .75 * vec.n) for s, t in zip(r["idx"], r["tf"])])
    word = np.array(r["idx"]) < SLOTS
    assert x[0, np.array(r["idx"])[word]] == pytest.approx(w[word] / np.linalg.norm(w[word]))


# several blocks close the gap slowly, the more so the larger C is (README)
@pytest.mark.parametrize("nnz,tol,grid", [(10**6, 1e-5, (0.5, 3.0)), (500, LM.TOLERANCE, (0.5,))])
def test_models_reach_the_optimum(rows, nnz, tol, grid):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    specs = [LM.Spec(f, c) for f in (1, 2, 4) for c in grid]
    got = LM.fit_models(rows, vec, specs, tol=tol, nnz_per_block=nnz)
    assert (got.gaps <= tol).all()
    ids, label, x = dense(rows, vec)
    for k, s in enumerate(specs):
        g = gradient(x, label, got.weights[:, k], s)
        assert np.linalg.norm(g) <= (0.02 if tol < 1e-4 else 0.1) * np.linalg.norm(gradient(x, label, np.zeros(vec.size), s))
    margins = {r["post_id"]: r["margins"] for r in LM.model_margins(got, rows).collect()}
    assert np.array([margins[i] for i in ids]) == pytest.approx(x @ got.weights)
    norms = {r["model"]: r for r in LM.gradient_norms(got, rows).collect()}
    for k, s in enumerate(specs):
        want = np.linalg.norm(gradient(x, label, got.weights[:, k], s)) / np.linalg.norm(gradient(x, label, 0 * got.weights[:, k], s))
        assert norms[k]["relative"] == pytest.approx(want, rel=1e-3, abs=1e-9) and norms[k]["n_rows"] == len(ids)


def test_many_blocks_close_the_gap_for_large_c(rows):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    specs = [LM.Spec(f, c) for f in (1, 2, 4) for c in (3.0, 9.0)]
    got = LM.fit_models(rows, vec, specs, nnz_per_block=500, max_rounds=15)
    assert (got.gaps <= LM.TOLERANCE).all()
    whole = LM.fit_models(rows, vec, specs, tol=1e-6)
    margins = [np.array([r["margins"] for r in LM.model_margins(m, rows).orderBy("post_id").collect()]) for m in (got, whole)]
    assert margins[0] == pytest.approx(margins[1], abs=0.1)


def test_both_solvers_agree_and_warm_start(rows):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    specs = [LM.Spec(f, 0.5) for f in (1, 2, 4)]
    a = LM.fit_models(rows, vec, specs, tol=1e-7)  # 90 rows < 64 * 3: by inner products
    b = LM.fit_models(rows, vec, specs[:1], tol=1e-7)  # 90 rows > 64: by the rows' entries
    assert a.weights[:, 0] == pytest.approx(b.weights[:, 0], abs=1e-3)
    part = rows.where("post_id < 60")
    first = LM.fit_models(part, vec, specs, tol=1e-7)
    assert first.alpha.count() == 60
    for nnz, tol, near in ((10**6, 1e-6, 5e-3), (500, LM.TOLERANCE, 0.1)):
        warm = LM.fit_models(rows, vec, specs, start=first.alpha, tol=tol, nnz_per_block=nnz)
        assert (warm.gaps <= tol).all() and warm.weights == pytest.approx(a.weights, abs=near)


def test_packed_rows_equal_the_features(rows):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))._replace(blocks=(0.3, 0.7))
    ids, _, x = dense(rows, vec)
    lines = np.random.default_rng(2).normal(size=(3, vec.size))
    seen = {}
    for batch in LM.packed_rows(rows, vec, ("post_id",)).toArrow().to_batches():
        for i in range(batch.num_rows):
            piece, total = LM.Piece(batch, i, SLOTS), np.zeros(vec.size)
            got = piece.dots(LM.slot_weights(lines, vec.idf()))
            mine = np.searchsorted(ids, batch.column("post_id")[i].values.to_numpy())
            assert got == pytest.approx(x[mine] @ lines.T, rel=1e-5, abs=1e-5)
            piece.add_rows(total, got[:, 0])
            total[:2 * SLOTS] *= vec.idf()
            assert total == pytest.approx(x[mine].T @ got[:, 0], abs=1e-5)
            seen.update(dict.fromkeys(mine.tolist()))
    assert len(seen) == len(ids)


def test_few_passes_close_the_gap(rows, monkeypatch):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    calls, one = [], LM._pass
    monkeypatch.setattr(LM, "_pass", lambda *a, **k: calls.append(1) or one(*a, **k))
    got = LM.fit_models(rows, vec, [LM.Spec(f, 9.0) for f in (1, 2, 4)], nnz_per_block=500)
    assert (got.gaps <= LM.TOLERANCE).all() and len(calls) <= 25


def test_a_grid_goes_on_from_the_last_c(rows, monkeypatch):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    firsts, one = [], LM._pass
    monkeypatch.setattr(LM, "MODELS_AT_ONCE", 2)
    monkeypatch.setattr(LM, "_pass", lambda x, v, specs, kind, w=None, d=None: firsts.append(np.abs(w).max()) or one(x, v, specs, kind, w, d))
    specs = [LM.Spec(f, c) for c in (8.0, 9.0) for f in (1, 2)]
    got = LM.fit_models(rows, vec, specs, nnz_per_block=500)
    assert (got.gaps <= LM.TOLERANCE).all() and got.specs == specs
    assert firsts[0] == 0 and firsts.count(0.0) < len(firsts) / 2 and firsts[len(firsts) // 2:].count(0.0) == 0
    alone = LM.fit_models(rows, vec, specs[2:], tol=1e-7)
    assert got.weights[:, 2:] == pytest.approx(alone.weights, abs=0.1)


def test_clusters_are_fitted_on_all_posts(spark):
    union = LR.Union(bits=4)
    width = len(LR.dense_feature_columns())
    last = 10_030  # more than the 10,000 rows the fit was once cut to
    data = spark.range(last).select(
        F.col("id").alias("post_id"), F.array(F.when(F.col("id") < 10_000, F.col("id") % 8).otherwise(12).cast("int")).alias("idx"),
        F.array(F.lit(1.0).cast("float")).alias("tf"), F.array_repeat(F.lit(0.0), width).alias("dense"))
    vec, centers = LR.labelled_cluster_fit(data, k=3, union=union)
    assert vec.n == last and vec.df[12] == last - 10_000 and np.abs(centers[12]).max() > 0


def test_feature_table_stores_packed_terms(spark):
    rng = np.random.default_rng(6)
    idx = [np.sort(rng.choice(1 << 19, n, replace=False)).astype(np.int32) for n in (0, 1, 3000, 7)]
    tf = [rng.integers(1, 400, len(x)).astype(np.float32) for x in idx]
    packed = [LR._packed_terms(i, t) for i, t in zip(idx, tf)]
    got = LR.unpacked_terms(pa.array(packed, pa.binary())).to_pylist()
    assert [r["idx"] for r in got] == [x.tolist() for x in idx] and [r["tf"] for r in got] == [x.tolist() for x in tf]
    assert len(packed[2]) < 3 * 3000  # 8 bytes an entry as two arrays
    lexicon = spark.createDataFrame([("nrc", "uni", "ab", 1.0)], "lexicon string, kind string, term string, score double")
    posts = spark.createDataFrame([(1, 1, "ab cd ab", "N V N"), (2, None, "", "N")], "post_id bigint, label int, text string, tags string")
    feats = LR.feature_table(posts, lexicon)
    rows = {r["post_id"]: r for r in feats.collect()}
    assert rows[1]["idx"] == sorted(rows[1]["idx"]) and max(rows[1]["tf"]) == 2.0 and rows[2]["idx"] == []
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    assert "terms" in plan  # what is stored; arrays are made where they are read


def test_folds_groups_and_saving(spark, rows, scratch, monkeypatch):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    monkeypatch.setattr(LM, "MODELS_AT_ONCE", 2)
    specs = [LM.Spec(f, 1.0, fold) for fold in (0, 1) for f in (1, 2)]
    got = LM.fit_models(rows, vec, specs, folds=2, tol=1e-6)
    fold = {r[0]: r[1] for r in rows.select("post_id", F.pmod(F.xxhash64("post_id", F.lit(7)), F.lit(2))).collect()}
    ids, label, x = dense(rows, vec)
    for k, s in enumerate(specs):
        mine = np.array([fold[i] != s.fold for i in ids])
        g = gradient(x[mine], label[mine], got.weights[:, k], s)
        assert np.linalg.norm(g) <= 0.01 * np.linalg.norm(gradient(x[mine], label[mine], np.zeros(vec.size), s))
    calls = []
    train = lambda: calls.append(1) or got
    LM.load_or_train(spark, f"{scratch}/model", train)
    again = LM.load_or_train(spark, f"{scratch}/model", train)
    assert len(calls) == 1 and (again.weights == got.weights).all() and again.specs == got.specs
    assert (again.vec.df == vec.df).all() and (again.vec.top == vec.top).all()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (80, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0), (0, 0, 5))])
    return x, spark.createDataFrame([(i, [float(v) for v in p], i // 80) for i, p in enumerate(x)],
                                    "id bigint, vec array<double>, label int").repartition(5)


def test_seeding_draws_by_distance(points):
    x, df = points
    centers, chosen = KM.seed_centers(df, [0, 1, 2], 4)
    for s, per in enumerate(chosen):
        d = np.full(len(x), np.inf)
        for t, got in enumerate(per):
            u = np.array([KM._uniform(i, s, t) for i in range(len(x))])
            with np.errstate(divide="ignore"):
                key = -np.log(u) / d if t else u
            assert got == int(np.argmin(key)) and (centers[s, t] == x[got]).all()
            d = np.minimum(d, ((x - x[got]) ** 2).sum(1))
    few, ids = KM.seed_centers(df.where("id < 2"), [0], 4)  # fewer rows than centres
    assert sorted(set(ids[0])) == [0, 1] and len(ids[0]) == 4


def test_lloyd_and_mini_batch(points):
    x, df = points
    start, _ = KM.seed_centers(df, [0, 1], 4)
    first = KM._sums(df, start)[2]
    full = KM.lloyd(df, start)
    assert full.settled.all() and (full.inertia <= first + 1e-9).all()
    for s in range(2):
        c = start[s]
        for _ in range(full.rounds):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(4)])
        assert full.centers[s] == pytest.approx(c)
    small = KM.mini_batch(df, start, batch=50)
    assert (KM._sums(df, small.centers)[2] <= first).all()
    purity = {r["seed"]: r["purity"] for r in KM.restart_purity(KM.assign(df, full.centers, ("id", "label"))).collect()}
    at = KM.nearest(x, full.centers)[0]
    for s in range(2):
        want = sum(np.bincount(np.arange(len(x))[at[:, s] == j] // 80).max() for j in set(at[:, s])) / len(x)
        assert purity[s] == pytest.approx(want)


def test_sparse_rows_equal_dense_ones(rows, spark):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    ids, _, x = dense(rows, vec)
    feats = LM.feature_rows(rows, vec, ("post_id",))
    start = x[:3].T.copy()
    got = {r["post_id"]: r["d"] for r in KM.sparse_distances(feats, start).collect()}
    want = np.sqrt(((x[:, None] - start.T[None]) ** 2).sum(2))
    assert np.array([got[i] for i in ids]) == pytest.approx(want, abs=1e-7)
    centers, rounds, settled = KM.sparse_lloyd(feats, start, tol=1e-9)
    c = start.T
    for _ in range(rounds):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(3)])
    assert settled and centers.T == pytest.approx(c)


def test_clusters_of_packed_rows_equal_those_of_sparse_ones(rows):
    vec = LM.fit_vectoriser(rows, SLOTS, np.array([0.2, 0.5]))
    start = dense(rows, vec)[2][:3].T.copy()
    centers, rounds, _ = KM.sparse_lloyd(LM.feature_rows(rows, vec, ("post_id",)), start, tol=1e-9)
    packed, again, settled = KM.packed_lloyd(LM.packed_rows(rows, vec, ("post_id",)), vec, start, tol=1e-9)
    assert settled and again == rounds and packed == pytest.approx(centers, abs=1e-6)


def test_edit_distances_and_best_cluster(spark):
    rng = random.Random(2)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    word = lambda lo, hi: "".join(rng.choice("abéz") for _ in range(rng.randint(lo, hi)))
    words = [(f"c{i % 3}", word(1, 8)) for i in range(40)]
    tokens = sorted({word(0, 12) for _ in range(150)} | {"", "a" * 300})
    best = EM.ClusterWords(words).best(tokens)
    for t, got in zip(tokens, best):
        for k in range(3):
            want = max(1 - lev(t, w) / max(len(t), len(w)) if t else 0.0 for c, w in words if c == f"c{k}")
            assert got[k] == pytest.approx(want), (t, k)
    df = spark.createDataFrame([(t,) for t in tokens], "tok string")
    wc = spark.createDataFrame(words, "cluster string, word string")
    spark.conf.set("moodgrid.broadcast.maxRows", "15")
    many = {r["tok"]: {s["cluster"]: s["sim"] for s in r["sims"]} for r in EM.best_cluster_similarity(df, wc).collect()}
    spark.conf.unset("moodgrid.broadcast.maxRows")
    assert all(many[t][f"c{k}"] == pytest.approx(best[i][k]) for i, t in enumerate(tokens) for k in range(3))


def test_ngrams_are_cut_per_text():
    texts = ["a bc d", "", "é bc", None, "d"]
    t = next(TS.text_shards(pa.array(texts)))
    code, a, b, row = TS.ngram_codes(t, TS.word_units, 1, 2)
    got = sorted(zip(row.tolist(), TS.strings(t, a, b).to_pylist()))
    assert got == sorted([(0, "a"), (0, "bc"), (0, "d"), (0, "a bc"), (0, "bc d"), (2, "é"), (2, "bc"), (2, "é bc"), (4, "d")])
    code, a, b, row = TS.ngram_codes(t, TS.char_units, 1, 3)
    want = [(i, (x or "")[k:k + n]) for i, x in enumerate(texts) for n in (1, 2, 3) for k in range(len(x or "") - n + 1)]
    assert sorted(zip(row.tolist(), TS.strings(t, a, b).to_pylist())) == sorted(want)
    assert len(set(code.tolist())) == len({w for _, w in want})


def test_tfidf_does_not_depend_on_the_shards(spark):
    rng = random.Random(1)
    posts = spark.createDataFrame([(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "é1"]) for _ in range(rng.randint(0, 9))))
                                   for i in range(60)], "post_id bigint, text string").repartition(3)
    one = {(r[0], r[1]): r[2] for r in TF.tfidf(posts, TF.word_text("text"), TS.word_units, (1, 2)).collect()}
    many = {(r[0], r[1]): r[2] for r in TF.tfidf(posts, TF.word_text("text"), TS.word_units, (1, 2), shard_bytes=30).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k]) for k in one)
    length = {}
    for (p, _), w in one.items():
        length[p] = length.get(p, 0) + w * w
    assert all(v == pytest.approx(1.0) for v in length.values())


def test_shards_store_texts_and_return_only_codes_of_several_posts(spark):
    posts = spark.createDataFrame([(1, "ab cd ab"), (2, "cd ef"), (3, None), (None, "gh")], "post_id bigint, text string").repartition(2)
    shards, rows, size = TS.term_shards(posts, shard_bytes=5)
    assert (rows, size) == (4, 15) and shards.columns == ["shard", "post_id", "text"] and shards.count() == 4
    found = TS.corpus_frequencies(shards, size, TS.word_units, 1, 2).collect()
    df = [n for r in found for n in np.frombuffer(r["df"], np.int64).tolist()]
    codes = {c for r in found for c in np.frombuffer(r["codes"], np.uint64).tolist()}
    t = next(TS.text_shards(pa.array(["cd"])))
    assert codes == set(TS.ngram_codes(t, TS.word_units, 1, 1)[0].tolist()) and set(df) == {2}


def test_rounding_in_tasks_is_that_of_spark(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random(20_000), (rng.integers(0, 10 ** 6, 5_000) * 10 + 5) / 1e7, [0.0, 1.0, 5e-7, 0.0000015]])
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    want = [r[0] for r in frame.select("i", F.round("x", 6).alias("r")).orderBy("i").select("r").collect()]
    assert TF.rounded(x, 6).tolist() == want
