"""Sentiment scorers and margin re-weighting ("mutators", U1–U12).

A mutator is anything that yields ``(post_id, score)``; the generic
range filter (P10) and margin weighting (U4/U7/U11) work on that shape,
and several mutators fold together (U12): weights add, filters AND.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .editmatch import best_cluster_similarity
from .lookup import constant_table, sized_lookup, spread

INF = float("inf")
# Per-cluster mean scores are sums in engine-dependent order; they are
# rounded to this many digits before the arg-max so that ties are ties.
TIE_DIGITS = 12


# --------------------------------------------------------------------------
# ranges and filters (P10)
# --------------------------------------------------------------------------

def symmetric_ranges(spark: SparkSession, threshold: float) -> DataFrame:
    """(label, lo, hi): POS (t, inf), NEG (-inf, -t), NEU (-t, t)."""
    t = float(threshold)
    return constant_table(spark, [(C.POS, t, INF), (C.NEG, -INF, -t), (C.NEU, -t, t)],
                          "label int, lo double, hi double")


def range_filter(scored: DataFrame, ranges: DataFrame, label_col: str = "label",
                 score_col: str = "score") -> DataFrame:
    """P10: keep a (row, candidate label) iff ``lo < score < hi`` (strict).
    ``ranges`` is a tiny constant table joined on the label."""
    r = ranges.withColumnRenamed("label", "_rl")
    j = scored.join(r, F.col(label_col) == F.col("_rl"))
    return j.where((F.col(score_col) > F.col("lo")) & (F.col(score_col) < F.col("hi"))) \
        .drop("_rl", "lo", "hi")


def range_labels(scored: DataFrame, ranges: DataFrame, score_col: str = "score") -> DataFrame:
    """Every candidate label whose range holds the score (join against the
    constant ranges table on the range condition)."""
    return scored.join(ranges, (F.col(score_col) > F.col("lo")) & (F.col(score_col) < F.col("hi"))) \
        .drop("lo", "hi")


# --------------------------------------------------------------------------
# U3 word-list score
# --------------------------------------------------------------------------

def afinn_score(posts: DataFrame, afinn: DataFrame, text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(post_id, score, n_tok): sum of the weights of the lower-cased
    tokens, 0 when none is listed; n_tok = token count.

    Tokens are exploded once and probe the (size-checked, broadcast) word
    list; the per-post sum is combined map-side before the shuffle, so the
    shuffle carries about one row per post."""
    toks = posts.select("post_id", *keep, F.explode(T.lower_tokens(text_col)).alias("word"))
    hits = toks.join(afinn, "word", "left")
    return hits.groupBy("post_id", *keep).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("score"),
        F.count(F.lit(1)).alias("n_tok"))


# --------------------------------------------------------------------------
# J5 / U8 edit-distance cluster score
# --------------------------------------------------------------------------

def edit_cluster_scores(posts: DataFrame, word_clusters: DataFrame, text_col: str = "text") -> DataFrame:
    """(post_id, cluster, score) = mean over the post's tokens of the
    best edit similarity (T8) to any word of the cluster.

    Similarities are computed once per distinct token and carried as one
    row per token; occurrences are folded per post and token before they
    meet them."""
    occ = posts.select("post_id", F.explode(T.lower_tokens(text_col)).alias("tok")) \
        .groupBy("post_id", "tok").agg(F.count(F.lit(1)).alias("n"))
    best = sized_lookup(best_cluster_similarity(spread(occ.select("tok").distinct(), "tok"), word_clusters))
    # every token has an entry per cluster, so the entries of a cluster
    # count the post's tokens
    agg = occ.join(best, "tok").select("post_id", "n", F.explode("sims").alias("c")) \
        .groupBy("post_id", F.col("c.cluster").alias("cluster")) \
        .agg(F.sum(F.col("n") * F.col("c.sim")).alias("s"), F.sum("n").alias("n_tok"))
    return agg.select("post_id", "cluster", F.round(F.col("s") / F.col("n_tok"), TIE_DIGITS).alias("score"))


def pick_best_cluster(scores: DataFrame) -> DataFrame:
    """K5: per post the cluster with the highest score, strictly above 0,
    ties to the lowest cluster name -> (post_id, cluster, score); cluster
    NULL when no cluster scores above 0."""
    pos = F.col("score") > 0
    key = F.when(pos, F.struct((-F.col("score")).alias("k"), F.col("cluster").alias("c")))
    return scores.groupBy("post_id").agg(
        F.min_by(F.when(pos, F.col("cluster")), key).alias("cluster"),
        F.max(F.when(pos, F.col("score"))).alias("score"))


def edit_cluster_score(posts: DataFrame, word_clusters: DataFrame, sentiment: DataFrame,
                       text_col: str = "text") -> DataFrame:
    """U8: (post_id, score): the winning cluster's mean similarity, negated
    for a negative cluster, 0 for a neutral winner or no winner."""
    best = pick_best_cluster(edit_cluster_scores(posts, word_clusters, text_col))
    sent = sized_lookup(sentiment.select("cluster", "sentiment"))
    return best.join(sent, "cluster", "left").select(
        "post_id",
        F.when(F.col("sentiment") == "positive", F.col("score"))
        .when(F.col("sentiment") == "negative", -F.col("score"))
        .otherwise(F.lit(0.0)).alias("score"))


# --------------------------------------------------------------------------
# J4 / U9 / U10 similarity-table cluster score
# --------------------------------------------------------------------------

def tagged_tokens(posts: DataFrame, text_col: str = "text", tags_col: str = "tags") -> DataFrame:
    """(post_id, i, tok, tag): token i zipped with tag i."""
    z = F.arrays_zip(T.tokens(text_col).alias("tok"), T.tag_chars(tags_col).alias("tag"))
    return posts.select("post_id", F.posexplode(z).alias("i", "z")) \
        .select("post_id", "i", F.col("z.tok").alias("tok"), F.col("z.tag").alias("tag"))


def lemmatised_words(posts: DataFrame, lemma: DataFrame, wordlist: DataFrame) -> DataFrame:
    """(post_id, word, pos): tagged tokens with a lemma part of speech,
    lemmatised (T6), de-duplicated per post with the last tag winning, and
    kept only when the lemma is in the word set (J3)."""
    tt = tagged_tokens(posts).select("post_id", "i", "tok", T.wordnet_pos(F.col("tag")).alias("pos")) \
        .where((F.col("pos") != "") & F.col("tok").isNotNull())
    lem = tt.join(lemma.withColumnRenamed("form", "tok"), ["tok", "pos"], "left") \
        .select("post_id", "i", "pos", F.coalesce("lemma", "tok").alias("word"))
    # place and part of speech as one number, so that the last tag is a plain maximum
    kinds = F.array(*[F.lit(x) for x in (C.WN_NOUN, C.WN_VERB, C.WN_ADJ, C.WN_ADV)])
    last = F.max(F.col("i").cast("long") * 8 + F.array_position(kinds, F.col("pos")))
    known = lem.join(wordlist.select("word"), "word", "left_semi")
    return known.groupBy("post_id", "word").agg(last.alias("last")) \
        .select("word", "post_id", F.get(kinds, (F.col("last") % 8 - 1).cast("int")).alias("pos"))


def wordnet_pair_counts(posts: DataFrame, lemma: DataFrame, wordlist: DataFrame,
                        word_clusters: DataFrame) -> DataFrame:
    """(post_id, cluster, n_words, n_pairs): how many (post word,
    cluster word) pairs each post forms with each cluster.

    The pairs themselves are never listed: a post's pairs with a cluster
    are its kept words times the cluster's words, so two counts give them.
    (Scores need only pairs of the similarity table; U9 forms those by an
    equi-join on the post word.)"""
    words = lemmatised_words(posts, lemma, wordlist).groupBy("post_id").agg(F.count(F.lit(1)).alias("n_words"))
    sizes = word_clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    # a scalar of one entry per cluster: a post meets clusters, not words
    per = sizes.agg(F.collect_list(F.struct("cluster", "n"))).scalar()
    return words.select("post_id", "n_words", F.explode(per).alias("c")).select(
        "post_id", F.col("c.cluster").alias("cluster"), "n_words", (F.col("n_words") * F.col("c.n")).alias("n_pairs"))


def similarity_cluster_scores(posts: DataFrame, lemma: DataFrame, wordlist: DataFrame,
                              word_clusters: DataFrame, similarity: DataFrame,
                              scheme: str = "path") -> DataFrame:
    """(post_id, cluster, score) = sum of the similarity of every
    (post word, cluster word) pair found in the similarity table, divided
    by the post's token count (Q16).

    A word's scores are summed per cluster before posts meet them, so a post's
    word brings an entry per cluster and not one per cluster word."""
    if scheme not in C.SIMILARITY_SCHEMES:
        raise ValueError(f"unknown similarity scheme {scheme}")
    words = lemmatised_words(posts, lemma, wordlist)
    sim = similarity.where(F.col("scheme") == scheme) \
        .select(F.col("word_a").alias("word"), "pos", F.col("word_b").alias("cword"), "score")
    per = sized_lookup(sim.join(word_clusters.withColumnRenamed("word", "cword"), "cword")
                       .groupBy("word", "pos", "cluster").agg(F.sum("score").alias("s"))
                       .groupBy("word", "pos").agg(F.collect_list(F.struct("cluster", "s")).alias("sims")))
    hits = words.join(per, ["word", "pos"]).select("post_id", F.explode("sims").alias("c"))
    sums = hits.groupBy("post_id", F.col("c.cluster").alias("cluster")).agg(F.sum("c.s").alias("s"))
    n_tok = posts.select("post_id", F.size(T.tokens("text")).alias("n_tok"))
    return sums.join(n_tok, "post_id").select(
        "post_id", "cluster", F.round(F.col("s") / F.col("n_tok"), TIE_DIGITS).alias("score"))


def similarity_diff(scores: DataFrame, sentiment: DataFrame, posts: DataFrame) -> DataFrame:
    """(post_id, score): winner's score minus the scores of every
    cluster whose sentiment differs from the winner's; sign by the
    winner's sentiment, neutral -> 0; posts without pairs -> 0."""
    s = scores.join(sized_lookup(sentiment.select("cluster", "sentiment")), "cluster", "left")
    key = F.struct((-F.col("score")).alias("k"), F.col("cluster").alias("c"))
    per = s.groupBy("post_id").agg(
        F.min_by(F.struct("score", "sentiment"), key).alias("w"),
        F.collect_list(F.struct("score", "sentiment")).alias("all"))
    diff = F.col("w.score") - F.aggregate(
        F.filter("all", lambda x: ~F.equal_null(x["sentiment"], F.col("w.sentiment"))),
        F.lit(0.0), lambda acc, x: acc + x["score"])
    val = (F.when(F.col("w.sentiment") == "positive", diff)
           .when(F.col("w.sentiment") == "negative", -diff).otherwise(F.lit(0.0)))
    out = per.select("post_id", val.alias("score"))
    return posts.select("post_id").join(out, "post_id", "left").select(
        "post_id", F.coalesce("score", F.lit(0.0)).alias("score"))


# --------------------------------------------------------------------------
# weighting (U4, U7, U11) and folding
# --------------------------------------------------------------------------

def weight_deltas(scores: DataFrame, weight: float, per_token: bool = False) -> DataFrame:
    """(post_id, label, delta): a positive score adds ``w*s`` to POS, a
    negative one adds ``w*|s|`` to NEG; with ``per_token`` the score is
    divided by the token count first (word-list mutator)."""
    s = F.col("score") / F.col("n_tok") if per_token else F.col("score")
    w = F.lit(float(weight))
    return scores.select("post_id", F.explode(F.array(
        F.struct(F.lit(C.POS).alias("label"), F.when(s > 0, w * s).otherwise(F.lit(0.0)).alias("delta")),
        F.struct(F.lit(C.NEG).alias("label"), F.when(s < 0, -w * s).otherwise(F.lit(0.0)).alias("delta")),
    )).alias("d")).select("post_id", "d.label", "d.delta")


def apply_weightings(margins: DataFrame, deltas: list[DataFrame]) -> DataFrame:
    """U12 (weights): margins (post_id, label, margin) plus the sum of all
    mutators' deltas for the same (post, label)."""
    if not deltas:
        return margins
    d = reduce(lambda a, b: a.unionByName(b), deltas) \
        .groupBy("post_id", "label").agg(F.sum("delta").alias("delta"))
    return margins.join(d, ["post_id", "label"], "left").select(
        "post_id", "label", (F.col("margin") + F.coalesce("delta", F.lit(0.0))).alias("margin"))


def apply_filters(candidates: DataFrame, filters: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """U12 (filters): keep a (post_id, label) candidate only if every
    mutator's score lies in that mutator's range for the label."""
    out = candidates
    for scores, ranges in filters:
        ok = range_filter(_scores_by_label(scores), ranges)
        out = out.join(ok.select("post_id", "label"), ["post_id", "label"], "left_semi")
    return out


def _scores_by_label(scores: DataFrame) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in (C.POS, C.NEG, C.NEU)])
    return scores.select("post_id", "score", F.explode(labels).alias("label"))
