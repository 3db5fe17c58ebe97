"""Queries: dictionary files with pointers (S12), taxonomy similarities
(S19, U9) and the rule lemmatiser (T6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import mutators as M
from ..operators import taxonomy as X
from ..operators.lookup import materialise, sized_lookup
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as S
from ..sources.fixtures_sql import sql_with
from .mutator_queries import _TAGGED, u9_scores_sql, words_sql
from .registry import register


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _synsets(spark, sf_dir):
    return materialise(X.parse_synsets(S.synset_lines(spark, sf_dir)))


def _forms(posts):
    return M.tagged_tokens(posts).where(F.col("tok").isNotNull()) \
        .select(F.col("tok").alias("form"), T.wordnet_pos(F.col("tag")).alias("pos")).where("pos <> ''")


_RULES = ", ".join(f"('{p}', {i + 2}, '{suffix}', '{ending}')"
                   for p, rules in C.DETACHMENT_RULES.items() for i, (suffix, ending) in enumerate(rules))

# every accepted candidate of every distinct form; the shortest wins
LEMMAS = f"""{_TAGGED}
, _fm AS (SELECT tok AS form, pos, count(*) AS n FROM _wp WHERE pos <> '' GROUP BY tok, pos)
, _cd AS (SELECT form, pos, 0 AS rank, form AS base FROM _fm
  UNION ALL SELECT f.form, f.pos, r.rank, left(f.form, length(f.form) - length(r.suffix)) || r.ending
  FROM _fm f JOIN (VALUES {_RULES}) AS r(pos, rank, suffix, ending)
    ON r.pos = f.pos AND suffix(f.form, r.suffix))
, _ok AS (SELECT * FROM _cd WHERE base <> '' AND (base, pos) IN (SELECT (word, pos) FROM tax_senses)
  UNION ALL SELECT e.form, e.pos, 1, e.base FROM tax_exceptions e)
, _bl AS (SELECT form, pos, base FROM _ok
  QUALIFY row_number() OVER (PARTITION BY form, pos ORDER BY length(base), rank, base) = 1)
, tax_lemma AS MATERIALIZED (SELECT f.form, f.pos, coalesce(b.base, f.form) AS lemma, f.n
  FROM _fm f LEFT JOIN _bl b ON b.form = f.form AND b.pos = f.pos)"""


def _lemmas(spark, sf_dir, posts, synsets):
    dictionary = X.senses(synsets).select("word", "pos")
    return X.rule_lemmas(_forms(posts), dictionary, S.lemma_exceptions(spark, sf_dir))


@register("t6_rule_lemmas", sql_with(f", {LEMMAS}\nSELECT form, pos, lemma, n FROM tax_lemma",
                                     "clean_posts", "tax_senses", "tax_exceptions"))
def t6_rule_lemmas(spark, sf_dir):
    """The lemma of every token form, with its number of uses."""
    forms = materialise(_forms(S.clean_posts(spark, sf_dir)).groupBy("form", "pos").agg(F.count(F.lit(1)).alias("n")))
    dictionary = X.senses(_synsets(spark, sf_dir)).select("word", "pos")
    return X.rule_lemmas(forms, dictionary, S.lemma_exceptions(spark, sf_dir)) \
        .join(forms, ["form", "pos"]).select("form", "pos", "lemma", "n")


@register("s12_synset_files", sql_with("""
SELECT n.pos, left(n.p, 1) AS letter, count(*) AS synsets,
  CAST(sum(CASE WHEN length(n.p) >= 3 THEN 2 ELSE 1 END) AS BIGINT) AS words,
  CAST(coalesce(sum(e.k), 0) AS BIGINT) AS pointers, min(n.p) AS first_word, max(n.p) AS last_word,
  CAST(sum(length(n.p)) AS BIGINT) AS letters, CAST(sum(ascii(right(n.p, 1))) AS BIGINT) AS endings
FROM tax_nodes n LEFT JOIN (SELECT pos, child, count(*) AS k FROM tax_edges WHERE parent <> '' GROUP BY pos, child) e
  ON e.pos = n.pos AND e.child = n.p
GROUP BY n.pos, left(n.p, 1)""", "tax_nodes", "tax_edges"))
def s12_synset_files(spark, sf_dir):
    """Dictionary files written and read with words and pointers."""
    root = f"{ensure_checkpoint_dir(spark)}/synsets-{uuid.uuid4().hex}"
    # one folder per part of speech, as in a dictionary distribution
    S.synset_lines(spark, sf_dir).withColumn("part", F.concat(F.lit("data."), "pos")) \
        .select("part", "value").write.partitionBy("part").text(root)
    t = X.read_synsets(spark, f"{root}/part=data.*")
    w = F.get("words", 0)
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return t.groupBy("pos", F.left(w, F.lit(1)).alias("letter")).agg(
        F.count(F.lit(1)).alias("synsets"), total(F.size("words"), "words"), total(F.size("parents"), "pointers"),
        F.min(w).alias("first_word"), F.max(w).alias("last_word"), total(F.length(w), "letters"),
        total(F.ascii(F.right(w, F.lit(1))), "endings"))


def _similarity(spark, sf_dir, synsets, scheme):
    return X.word_similarity(synsets, S.afinn(spark, sf_dir), S.word_clusters(spark, sf_dir), [scheme])


def _table_sql(scheme: str) -> str:
    return _recursive(sql_with(f"""
SELECT word_b, pos, count(*) AS n, round(sum(score), 6) AS total,
  max(CASE WHEN word_a <> word_b THEN score END) AS best,
  min(score) AS worst
FROM tax_similarity WHERE scheme = '{scheme}' GROUP BY word_b, pos""", "tax_similarity"))


def _register_table(scheme: str) -> None:
    @register(f"s19_taxonomy_{scheme}", _table_sql(scheme))
    def table_query(spark, sf_dir):
        """The similarity table of one measure, folded by cluster word."""
        s = _similarity(spark, sf_dir, _synsets(spark, sf_dir), scheme)
        return s.groupBy("word_b", "pos").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"),
            F.max(F.when(F.col("word_a") != F.col("word_b"), F.col("score"))).alias("best"),
            F.min("score").alias("worst"))


def _register_scores(scheme: str) -> None:
    @register(f"u9_taxonomy_{scheme}", _recursive(sql_with(
        f", {LEMMAS}\n, tax_words AS (SELECT DISTINCT word FROM tax_senses)\n"
        f", {words_sql('tax_lemma', 'tax_words').removeprefix(_TAGGED).lstrip(', \n')}\n"
        f", {u9_scores_sql('tax_similarity', scheme)}\nSELECT post_id, cluster, round(score, 6) AS score FROM _u9",
        "clean_posts", "tax_senses", "tax_exceptions", "tax_similarity")))
    def score_query(spark, sf_dir):
        """U9 with rule lemmas (T6), the dictionary's words (J3) and the
        taxonomy measure."""
        posts, synsets = S.clean_posts(spark, sf_dir), _synsets(spark, sf_dir)
        words = sized_lookup(X.senses(synsets).select("word").distinct())
        # a form without a row is its own lemma
        lemmas = sized_lookup(_lemmas(spark, sf_dir, posts, synsets).where("lemma <> form"))
        sim = _similarity(spark, sf_dir, synsets, scheme)
        s = M.similarity_cluster_scores(posts, lemmas, words,
                                        S.word_clusters(spark, sf_dir), sim, scheme)
        return s.select("post_id", "cluster", F.round("score", 6).alias("score"))


for _scheme in X.SCHEMES:
    _register_table(_scheme)
for _scheme in ("path", "wup"):
    _register_scores(_scheme)
