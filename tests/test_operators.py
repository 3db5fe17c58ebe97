"""Operator properties and brute-force checks on small fixtures."""


from pyspark.sql import functions as F

from moodgrid.functions import constants as C
from moodgrid.operators import distance as D
from moodgrid.operators import etl as E
from moodgrid.operators import lexicon as L
from moodgrid.operators import metrics as MT
from moodgrid.operators import mutators as M
from moodgrid.operators import selection as SL
from moodgrid.sources import fixtures as X
from tests.conftest import SF_SMALL


def _brute_lex(tokens, lex):
    """Reference semantics of the lexicon features, pairs enumerated."""
    uni = tokens
    bi = [tokens[i] + " " + tokens[i + 1] for i in range(len(tokens) - 1)]
    pairs = [uni[i] + "---" + uni[j] for i in range(len(uni)) for j in range(len(uni)) if i != j]
    pairs += [bi[i] + "---" + bi[j] for i in range(len(bi)) for j in range(len(bi)) if i != j]
    pairs += [u + "---" + b for u in uni for b in bi]
    pairs += [b + "---" + u for b in bi for u in uni]

    def score(d, toks):
        n = s = mx = last = 0
        for t in toks:
            v = d.get(t)
            if v is not None:
                n += v > 0
                s += v
                mx = v if v > mx else mx
                last = v if v > 0 else last
        return [n, s, mx, last]
    return score(lex["uni"], uni) + score(lex["bi"], bi) + score(lex["pair"], pairs)


def test_lexicon_features_match_pair_enumeration(spark):
    posts = [(1, "a b a c"), (2, "b b"), (3, "c a b c a"), (4, ""), (5, "x a---b y"), (6, "a- b a -b a---b x"), (7, "a---b a---b")]
    lex_rows = [("t", "uni", "a", 0.5), ("t", "uni", "b", -0.25), ("t", "bi", "a b", 1.0),
                ("t", "bi", "b b", -1.0), ("t", "pair", "a---c", 0.75), ("t", "pair", "a---a", 0.3),
                ("t", "pair", "b---b", 0.2), ("t", "pair", "a b---c", 0.6), ("t", "pair", "c---a b", -0.4),
                ("t", "pair", "a b---c a", 0.9), ("t", "pair", "c a---a b", 0.1), ("t", "pair", "x---y", 0.8),
                ("t", "pair", "x---a---b", 0.7), ("t", "pair", "a----b", 0.15), ("t", "pair", "a---b---a---b", 0.35),
                ("t", "pair", "nothing", 5.0), ("t", "pair", "---", 3.0)]
    df = spark.createDataFrame(posts, "post_id long, text string")
    lex = spark.createDataFrame(lex_rows, "lexicon string, kind string, term string, score double")
    got = {r["post_id"]: list(r)[1:] for r in L.lexicon_features(df, lex, "t").collect()}
    spark.conf.set("moodgrid.broadcast.maxRows", "4")  # several slices of the lexicon
    sliced = {r["post_id"]: list(r)[1:] for r in L.lexicon_features(df, lex, "t").collect()}
    spark.conf.unset("moodgrid.broadcast.maxRows")
    assert {k: [round(x, 9) for x in v] for k, v in got.items()} == {k: [round(x, 9) for x in v] for k, v in sliced.items()}
    d = {"uni": {}, "bi": {}, "pair": {}}
    for _, k, t, s in lex_rows:
        d[k][t] = s
    for pid, text in posts:
        want = _brute_lex(text.split(" "), d)
        assert [round(x, 9) for x in got[pid]] == [round(float(x), 9) for x in want], (pid, got[pid], want)


def test_lexicon_features_of_any_lexicon_prepare_a_post_once(spark, monkeypatch):
    """Posts are prepared once however many rows the lexicon has; shards of
    posts give what one shard gives (duplicate and null rows included)."""
    texts = ["a b a c", "b  b", "", " a ", "c a b c a", "x a---b y", None, "a b a c", "é ñ é"]
    seen = spark.sparkContext.accumulator(0)

    def count(t):
        seen.add(1)
        return t

    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)] + [(None, "a c")], "post_id long, text string") \
        .select("post_id", F.udf(count, "string")("text").alias("text"))
    lex = spark.createDataFrame([
        ("t", "uni", "a", 0.5, 3, 1), ("t", "uni", "", 0.4, 1, 1), ("t", "uni", "é", -0.5, 1, 1), ("t", "bi", "b ", 0.3, 1, 1),
        ("t", "bi", "a b", 1.0, 1, 1), ("t", "pair", "a---c", 0.75, 1, 1), ("t", "pair", "c---a b", -0.4, 1, 1),
        ("t", "pair", "é---é", 0.2, 1, 1), ("t", "pair", "---a", 0.1, 1, 1)],
        "lexicon string, kind string, term string, score double, n_pos int, n_neg int")
    read = lambda: sorted(L.lexicon_features(df, lex, "t").collect(), key=str)
    spark.conf.set("moodgrid.broadcast.maxRows", "2")
    got = read()
    spark.conf.unset("moodgrid.broadcast.maxRows")
    assert seen.value == len(texts) + 1
    monkeypatch.setattr(L, "SHARD_BYTES", 4)
    assert read() == got
    d = {"uni": {"a": 0.5, "": 0.4, "é": -0.5}, "bi": {"b ": 0.3, "a b": 1.0},
         "pair": {"a---c": 0.75, "c---a b": -0.4, "é---é": 0.2, "---a": 0.1}}
    want = sorted([(i % 7, *(_brute_lex(t.split(" "), d) if t is not None else [0] * 12)) for i, t in enumerate(texts)]
                  + [(None, *_brute_lex(["a", "c"], d))], key=str)
    flat = lambda rows: sorted([[str(r[0]), *[round(float(x), 9) for x in r[1:]]] for r in rows])
    assert flat(got) == flat(want)


def test_lexicon_terms_are_counted_where_the_posts_lie(spark):
    """A stretch of posts gives one row per distinct term, however many
    posts hold it, with the counts of the terms listed post by post."""
    texts = ["a b c d", "a b c d", "a  b", "", "x---y z w", "x y---z w", "é ñ é ñ é", "a", " a b c", None]
    rows = [(i, C.POS if i % 2 else C.NEG, t) for i, t in enumerate(texts)]
    want = {}
    for _, label, t in rows:
        w = t.split(" ") if t is not None else []
        n = range(len(w))
        bi = [" ".join(w[i:i + 2]) for i in n[:-1]]
        terms = {("uni", x) for x in w if x} | {("bi", x) for x in bi}
        terms |= {("pair", x) for i in n[:-2] for x in (f"{w[i]}---{w[i + 2]}", f"{w[i]}---{bi[i + 1]}", f"{bi[i]}---{w[i + 2]}")}
        terms |= {("pair", f"{bi[i]}---{bi[i + 2]}") for i in n[:-3]}
        for key in terms:
            at = want.setdefault(key, [0, 0])
            at[label != C.POS] += 1
    df = spark.createDataFrame(rows, "post_id long, label int, text string").coalesce(1)
    got = X._lex_counts(df).collect()
    assert len(got) == len(want)
    assert {(r["kind"], r["term"]): [r["n_pos"], r["n_neg"]] for r in got} == want


def test_histogram_counts_sum_and_single_bucket(spark):
    vals = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 10]], "v double")
    h = MT.linear_histogram(vals, "v", 4).orderBy("bucket").collect()
    assert sum(r["n"] for r in h) == 5 and len(h) == 5
    assert h[0]["n"] == 1  # edge 0 holds only the minimum
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    h1 = MT.linear_histogram(same, "v", 4).collect()
    assert len(h1) == 1 and h1[0]["n"] == 2


def test_f1_perfect_classifier_is_one(spark):
    pairs = spark.createDataFrame([(i, lab, lab) for i, lab in enumerate([1, 2, 4, 1])], "post_id long, truth int, pred int")
    s = {r["label"]: r for r in MT.label_scores(pairs).collect()}
    assert s[1]["f1"] == 1.0 and s[2]["precision"] == 1.0
    none = spark.createDataFrame([(0, 1, 2)], "post_id long, truth int, pred int")
    s2 = {r["label"]: r for r in MT.label_scores(none).collect()}
    assert s2[4]["precision"] == 0.0 and s2[1]["f1"] == 0.0


def test_purity_bounds(spark):
    df = spark.createDataFrame([(c, p) for c in range(3) for p in (1, 1, 2)], "cluster int, prediction int")
    pur = MT.purity(df).first()["purity"]
    assert 1 / 2 <= pur <= 1.0 and abs(pur - 2 / 3) < 1e-12


def test_topk_per_label_and_removal(spark):
    m = X.margins(spark, SF_SMALL)
    sel = SL.select_best(m, 30)
    per = {r["label"]: r["count"] for r in sel.groupBy("label").count().collect()}
    assert all(v <= 10 for v in per.values())
    pool = m.select("post_id").distinct()
    rest = SL.remove_selected(pool, sel)
    assert rest.join(sel, "post_id").count() == 0
    assert rest.count() + sel.select("post_id").distinct().count() == pool.count()


def test_exclusive_selection_one_label_per_post(spark):
    m = X.margins(spark, SF_SMALL)
    sel = SL.select_best(m, 30, exclusive=True)
    assert sel.groupBy("post_id").count().where("count > 1").count() == 0


def test_batches_partition_rows(spark):
    df = spark.range(0, 1037).withColumnRenamed("id", "post_id")
    b = E.batch_assign(df, "post_id", 100)
    rows = b.collect()
    assert sorted(r["idx"] for r in rows) == list(range(1037))
    assert all(r["idx"] == r["post_id"] for r in rows)
    assert max(r["batch"] for r in rows) == 10


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 else 2) for i in range(30)], "post_id long, label int")
    out = SL.balanced_sample(df, seed=1)
    c = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert c == {1: 10, 2: 10}


def _union_find_clusters(ids, vecs, eps, min_pts):
    import numpy as np
    V = np.array(vecs, dtype=float)
    V = V / np.linalg.norm(V, axis=1, keepdims=True)
    d = 1 - V @ V.T
    n = len(ids)
    nb = [[j for j in range(n) if j != i and d[i, j] <= eps] for i in range(n)]
    core = [len(nb[i]) + 1 >= min_pts for i in range(n)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(n):
        for j in nb[i]:
            if core[i] and core[j]:
                parent[find(i)] = find(j)
    comps = {find(i) for i in range(n) if core[i]}
    noise = sum(1 for i in range(n) if not core[i] and not any(core[j] for j in nb[i]))
    return len(comps), noise, sum(core)


def test_density_clusters_match_union_find(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        c = i % 3
        base = [1.0 if k == c else 0.0 for k in range(6)]
        rows.append((i, [b + rnd.uniform(-0.3, 0.3) for b in base]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for eps in (0.05, 0.2, 0.5):
        r = D.density_sweep(df, "vec_id", "embedding", [eps], min_pts=3).first()
        want = _union_find_clusters([x[0] for x in rows], [x[1] for x in rows], eps, 3)
        assert (r["n_clusters"], r["n_noise"], r["n_core"]) == want, (eps, r, want)


def test_distance_histogram_counts_all_ordered_pairs(spark):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    h = D.distance_histogram(df, "vec_id", "embedding", block_size=7)
    assert h.agg(F.sum("n")).first()[0] == 40 * 39


def test_blocks_and_tiles_cover_every_pair_once(spark):
    from collections import Counter
    for same, rows, cols in ((True, 23, 23), (False, 23, 9), (False, 0, 9), (True, 5, 5)):
        seen = Counter()
        for s, t in D.tiles(same, rows, cols, 5):
            for x in range(rows)[s]:
                for y in range(cols)[t]:
                    seen[min(x, y) if same and s == t else x, max(x, y) if same and s == t else y] += 1
        for (x, y), n in seen.items():  # a tile against itself holds both directions
            assert n == (2 if same and x // 5 == y // 5 and x != y else 1)
        assert len(seen) == (rows * (rows + 1) // 2 if same else rows * cols)
    # copies of a vector: no more blocks than the bytes or the tasks ask for
    assert D.block_count(10 ** 9, 64, 2048, 8) == -(-10 ** 9 // 32768)
    assert D.block_count(100_000, 64, 2048, 8) == 4 and D.block_count(1000, 64, 2048, 8) == 1
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small, large = (D.distance_histogram(df, "vec_id", "embedding", block_size=b).select("distance", "n", "bar").orderBy("distance").collect()
                    for b in (3, 64))
    assert small == large
    none = D.distance_histogram(df.limit(0), "vec_id", "embedding")
    assert none.count() == 0


def test_class_mask_letters():
    from moodgrid.operators.ingest import class_mask
    assert class_mask("pne") == C.POS | C.NEG | C.NEU
    assert class_mask("or") == C.OBJ | C.OON
    assert class_mask("") == 0


def test_row_index_above_the_sample(spark):
    from moodgrid.operators import etl as E
    n = 200_000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 40).alias("payload"), "id")
    d = E.with_row_index(df, "k")
    r = d.agg(F.countDistinct("idx").alias("c"), F.min("idx").alias("lo"), F.max("idx").alias("hi")).first()
    assert (r["c"], r["lo"], r["hi"]) == (n, 0, n - 1)
    sizes = [x["count"] for x in E.batch_assign(df, "k", 30_000).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [30_000] * 6 + [20_000]


def test_components_of_a_long_chain(spark):
    from moodgrid.operators.components import component_labels
    edges = spark.range(999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")) \
        .union(spark.createDataFrame([(5000, 5001), (5002, 5001), (7, 7)], "src bigint, dst bigint"))
    got = component_labels(edges).groupBy("comp").count().orderBy("comp").collect()
    assert [tuple(r) for r in got] == [(0, 1000), (5000, 3)]


def test_last_tag_wins_without_sorting_tokens(spark):
    posts = spark.createDataFrame([(1, "cats run cats dog", "N V A N"), (2, "dog dog", "N R"), (3, None, None)],
                                  "post_id bigint, text string, tags string")
    lemma = spark.createDataFrame([("cats", "n", "cat"), ("cats", "a", "cat")], "form string, pos string, lemma string")
    words = spark.createDataFrame([("cat",), ("dog",)], "word string")
    out = M.lemmatised_words(posts, F.broadcast(lemma), F.broadcast(words))
    assert sorted(map(tuple, out.select("post_id", "word", "pos").collect())) == [(1, "cat", "a"), (1, "dog", "n"), (2, "dog", "r")]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
