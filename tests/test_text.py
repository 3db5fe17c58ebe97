"""Unit goldens for the text operators (edge cases the synthetic data lacks)."""

from pyspark.sql import functions as F

from moodgrid.functions import text as T
from moodgrid.operators import surface as S


def _one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


def test_url_and_user_normalisers(spark):
    assert _one(spark, T.normalise_urls("t"), "see http://a.b/c and https://x now") == \
        "see http://url and http://url now"
    assert _one(spark, T.normalise_users("t"), "@bob hi @ alice@") == "@ref hi @ref alice@"


def test_elongation_cap(spark):
    assert _one(spark, T.cap_elongation("t"), "sooooo goooood!!!! aa") == "sooo goood!!! aa"
    # spaces are separators, never part of a run
    assert _one(spark, T.cap_elongation("t"), "a     b") == "a     b"


def test_normalise_keeps_placeholder(spark):
    assert _one(spark, T.normalise("t"), "Not Available") == "Not Available"


def test_negation_scope(spark):
    got = _one(spark, T.negation_scope("t"), "I don't like this movie , but not bad at all !")
    assert got == "I don't like_NEG this_NEG movie_NEG , but not bad_NEG at_NEG all_NEG !"
    # cue test comes first: a cue holding punctuation still opens a scope
    assert _one(spark, T.negation_scope("t"), "don't. good") == "don't. good_NEG"
    # a whole-word cue with punctuation attached is not a cue, it ends the scope
    assert _one(spark, T.negation_scope("t"), "not never. good") == "not never. good"
    # case-sensitive cue list
    assert _one(spark, T.negation_scope("t"), "Never good") == "Never good"
    assert _one(spark, T.negation_scope("t"), "") == ""


def test_html_decode_single_pass(spark):
    assert _one(spark, T.decode_html("t"), "&amp;lt; &lt; &euro; &middot;") == "&lt; < € &middot;"


def test_edit_similarity_edges(spark):
    df = spark.createDataFrame([("", ""), ("", "abc"), ("abc", "abc"), ("Abc", "abd"), ("é", "e")], "a string, b string")
    got = [r[0] for r in df.select(T.edit_similarity("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 1.0
    assert abs(got[3] - (1 - 1 / 3)) < 1e-12
    assert got[4] == 0.0  # one code point differs


def test_stepped_range_inclusive(spark):
    pts = spark.range(1).select(T.stepped_range(0.1, 0.9, 0.05).alias("p")).first()["p"]
    assert len(pts) == 17 and pts[0] == 0.1 and pts[-1] == 0.9


def test_surface_counters(spark):
    df = spark.createDataFrame([(1, "I LOVE it SO much #fun :-) ?? !! ?! sooo wow!", "N V O")],
                               "post_id long, text string, tags string")
    r = S.surface_features(df).first()
    assert r["n_tokens"] == 12
    assert r["n_all_caps"] == 2          # LOVE, SO (not I)
    assert r["n_hashtags"] == 1
    assert r["n_emoticons"] == 1 and r["last_emoticon"] == 0
    assert r["n_question_runs"] == 1 and r["n_exclaim_runs"] == 1 and r["n_mixed_runs"] == 3
    assert r["last_mark"] == 1
    assert r["n_elongated"] == 1
    assert r["pos_00"] == 1 and r["pos_05"] == 1 and r["pos_01"] == 1


def test_pos_counts_unknown_tag(spark):
    df = spark.createDataFrame([(1, "a b", "N Q")], "post_id long, text string, tags string")
    r = df.select(*S.pos_counts("tags")).first()
    assert r["pos_00"] == 1 and r["pos_unknown"] == 1
    assert sum(r[c] for c in r.asDict() if c != "pos_unknown") == 1


def test_normalisers_idempotent(spark):
    from tests.conftest import SF_SMALL
    from moodgrid.sources import fixtures as X
    p = X.clean_posts(spark, SF_SMALL)
    again = p.select(T.normalise("text").alias("t2"), "text").where(F.col("t2") != F.col("text"))
    assert again.count() == 0
