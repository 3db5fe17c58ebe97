"""The Arrow kernels of the derived posts: rewriting, tags, normalisers."""

import pyarrow as pa
from pyspark.sql import functions as F

from moodgrid.functions import text as T
from moodgrid.sources import fixtures as X

ODD = ["a  b 123 #x @ http :) not 12\u0085 éé ... ABC", "", None, "aaaa bb ééééé😀😀😀😀 yyy zzzz", "zzzz", "zz",
       "@@a httphttp xhttp @a@b", "Not Available", " a ", "x         !!!!"]


def test_rewrite_tokens_by_rule():
    line = pa.array(["a b", "c", "d", None, "e", "x x y"])
    ids = pa.array([36, 40, 52, 1, None, 37 * 43 - 3], pa.int64())
    want = ["@a b", "http://c", "doooo", None, "e", "x xoooo @y"]
    assert X.rewrite_tokens(line, ids).to_pylist() == want


def test_rewrite_tokens_walks_all_tokens():
    got = X.rewrite_tokens(pa.array(["w " * 400 + "w"]), pa.array([0], pa.int64()))[0].as_py().split(" ")
    for i, token in enumerate(got, 1):
        kind = next((k for m, k in X.INJECT_RULES if i % m == 0), None)
        assert token == {"mention": "@w", "url": "http://w", "hashtag": "#w", "exclaim": "w!!", "elongate": "woooo",
                         "negator": "not", "emoticon": ":)", None: "w"}[kind]


def test_token_tags():
    got = X.token_tags(pa.array(ODD[:3])).to_pylist()
    assert got == ["D A D $ # @ U E R $ , , V", "A", None]


def test_normaliser_kernel_equals_columns(spark):
    got = X.normalise_texts(pa.array(ODD)).to_pylist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    want = [r[0] for r in df.orderBy("i").select(T.cap_elongation(T.normalise_users(T.normalise_urls("t")))).collect()]
    assert got == want
    assert [r[0] for r in df.orderBy("i").select(T.normalise(F.col("t"))).collect()] == want


def test_word_freq_counts_posts(spark):
    df = spark.createDataFrame([("a b a",), ("b",), (None,)], "text string")
    assert {tuple(r) for r in X.word_freq(df).collect()} == {("a", 1), ("b", 2)}
