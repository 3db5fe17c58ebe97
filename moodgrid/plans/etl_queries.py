"""Queries: ETL operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import etl as E
from ..operators import mutators as M
from ..operators.lookup import sized_lookup
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as X
from ..sources.fixtures_sql import sql_with
from ..sources.tables import table
from .mutator_queries import U9
from .text_queries import S1_SQL
from .registry import register

BATCH = 100


@register("s14_column_projection", """
SELECT conv_id, turn, f[4] AS c0, f[3] AS c1
FROM (SELECT conv_id, turn,
        string_split(regexp_replace(concat_ws('|', conv_id, turn, role,
          trim(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g'))), '^\\s+|\\s+$', '', 'g'), '|') AS f
      FROM conversations)
WHERE len(f) = 4""")
def s14_column_projection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", "turn", F.concat_ws("|", F.col("conv_id").cast("string"),
                                                    F.col("turn").cast("string"), "role",
                                                    T.one_line(F.col("text"))).alias("line"))
    return E.project_columns(lines, [3, 2], "|", only_if=4)


@register("s15_batch_assignment", sql_with(f"""
SELECT post_id, row_number() OVER (ORDER BY post_id) - 1 AS idx,
       (row_number() OVER (ORDER BY post_id) - 1) // {BATCH} AS batch
FROM raw_posts""", "raw_posts"))
def s15_batch_assignment(spark, sf_dir):
    p = X.raw_posts(spark, sf_dir).select("post_id")
    return E.batch_assign(p, "post_id", BATCH).select("post_id", "idx", "batch")


@register("s18_related_words", sql_with("""
, _l AS (SELECT keyword, regexp_extract_all(body, '"word": "(.*?)",', 1) AS l FROM responses)
, _m AS (SELECT keyword, unnest(l) AS match, unnest(range(0, len(l))) AS pos FROM _l)
, _s AS (SELECT * FROM _m WHERE NOT contains(match, ' '))
, _c AS (SELECT keyword, pos, row_number() OVER (PARTITION BY keyword ORDER BY pos) AS rank FROM _s)
, _x AS (SELECT s.keyword, s.pos, o.o, lower(coalesce(lm.lemma, s.match)) AS word
         FROM _s s CROSS JOIN (VALUES (0, 'n'), (1, 'v'), (2, 'a'), (3, 'r')) AS o(o, p)
         LEFT JOIN lemma lm ON lm.form = s.match AND lm.pos = o.p)
, _f AS (SELECT keyword, word, min(pos * 10 + o) AS k FROM _x GROUP BY keyword, word)
, _r AS (SELECT keyword, word, k // 10 AS pos FROM (
           SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY k) AS n FROM _f) WHERE n <= 100)
SELECT r.keyword, r.word, c.rank FROM _r r JOIN _c c ON c.keyword = r.keyword AND c.pos = r.pos""",
    "responses", "lemma"))
def s18_related_words(spark, sf_dir):
    return E.ranked_related_words(X.responses(spark, sf_dir), 100, sized_lookup(X.lemma(spark, sf_dir)))


@register("s10_cluster_index_table", sql_with("""
SELECT cluster, sentiment,
  CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN 2 WHEN 'neutral' THEN 4 END AS flag,
  size, size::DOUBLE / (SELECT sum(size) FROM auto_cluster_index) AS share
FROM auto_cluster_index""", "auto_cluster_index"))
def s10_cluster_index_table(spark, sf_dir):
    return E.cluster_index_table(X.auto_cluster_index(spark, sf_dir))


@register("j10_invalid_sentiments", sql_with("""
SELECT cluster, sentiment FROM auto_cluster_index
WHERE sentiment NOT IN ('positive', 'negative', 'neutral')""", "auto_cluster_index"))
def j10_invalid_sentiments(spark, sf_dir):
    t = X.auto_cluster_index(spark, sf_dir)
    allowed = spark.createDataFrame([("positive",), ("negative",), ("neutral",)], "sentiment string")
    return t.join(F.broadcast(allowed), "sentiment", "left_anti").select("cluster", "sentiment")


@register("j11_cluster_set_mismatch", sql_with("""
SELECT coalesce(d.cluster, t.cluster) AS cluster, d.cluster IS NOT NULL AS in_data, t.cluster IS NOT NULL AS in_table
FROM (SELECT DISTINCT label AS cluster FROM embeddings) d
FULL OUTER JOIN (SELECT cluster FROM auto_cluster_index) t ON t.cluster = d.cluster
WHERE d.cluster IS NULL OR t.cluster IS NULL""", "auto_cluster_index"))
def j11_cluster_set_mismatch(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster")).distinct() \
        .withColumn("in_data", F.lit(True))
    t = X.auto_cluster_index(spark, sf_dir).select("cluster").withColumn("in_table", F.lit(True))
    j = d.join(t, "cluster", "full_outer")
    return j.where(F.col("in_data").isNull() | F.col("in_table").isNull()).select(
        "cluster", F.col("in_data").isNotNull().alias("in_data"), F.col("in_table").isNotNull().alias("in_table"))


@register("k3_ranked_clusters", sql_with(f"""
, {U9}
SELECT post_id, cluster, round(score, 6) AS score,
       row_number() OVER (PARTITION BY post_id ORDER BY score DESC, cluster) AS rank
FROM _u9""", "clean_posts", "lemma", "afinn", "word_clusters", "similarity"))
def k3_ranked_clusters(spark, sf_dir):
    p = X.clean_posts(spark, sf_dir)
    s = M.similarity_cluster_scores(p, sized_lookup(X.lemma(spark, sf_dir)),
                                    sized_lookup(X.afinn(spark, sf_dir).select("word")),
                                    X.word_clusters(spark, sf_dir), sized_lookup(X.similarity(spark, sf_dir)))
    w = Window.partitionBy("post_id").orderBy(F.desc("score"), "cluster")
    return s.select("post_id", "cluster", F.round("score", 6).alias("score"),
                    F.row_number().over(w).cast("long").alias("rank"))


@register("s3_positional_merge", sql_with("""
, _t AS (SELECT post_id, text, tags, row_number() OVER (ORDER BY post_id) - 1 AS idx
         FROM clean_posts WHERE label IS NOT NULL)
, _m AS (SELECT post_id, label, row_number() OVER (ORDER BY post_id) - 1 AS idx
         FROM clean_posts WHERE label IS NOT NULL)
SELECT _t.text, _t.tags, arg_max(_m.label, _t.idx) AS label
FROM _t JOIN _m ON _m.idx = _t.idx
GROUP BY _t.text, _t.tags""", "clean_posts"))
def s3_positional_merge(spark, sf_dir):
    """S3 + J8: a text file and a meta file aligned line by line (global
    row index on each side, equi-joined), de-duplicated on (text, tags)
    with the last line's label winning."""
    lab = X.clean_posts(spark, sf_dir).where(F.col("label").isNotNull())
    texts = E.with_row_index(lab.select("post_id", "text", "tags"), "post_id")
    meta = E.with_row_index(lab.select("post_id", "label"), "post_id").select("idx", "label")
    return texts.join(meta, "idx").groupBy("text", "tags").agg(F.max_by("label", "idx").alias("label"))


def _split_col(id_col: str = "post_id"):
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(h < 6, "train").when(h < 8, "dev").otherwise("test")


@register("s4_split_loader", sql_with(f"""
SELECT split, label, count(*) AS n_posts FROM (
  SELECT CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'dev' ELSE 'test' END AS split, label
  FROM (SELECT label, CAST(('0x' || substr(md5(CAST(post_id AS VARCHAR)), 1, 8))::UBIGINT % 10 AS BIGINT) AS h
        FROM ({S1_SQL})))
GROUP BY split, label""", "raw_lines"))
def s4_split_loader(spark, sf_dir):
    """The labelled scan with a train / dev / test split column
    (seeded hash of the id); redundancy across splits is kept."""
    from .text_queries import MASK_PNE
    from ..operators import ingest as I
    s = I.labelled_scan(X.raw_lines(spark, sf_dir), MASK_PNE).withColumn("split", _split_col())
    return s.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_posts"))


# ---------------------------------------------------------------------------
# file scans and sinks: written to a folder of the run, read back
# ---------------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("s15_batch_sizes", sql_with(f"""
SELECT batch, count(*) AS n_lines, sum(length(text)) AS n_chars
FROM (SELECT text, (row_number() OVER (ORDER BY post_id) - 1) // {BATCH} AS batch FROM raw_posts) GROUP BY batch""",
    "raw_posts"))
def s15_batch_sizes(spark, sf_dir):
    """The batch writer's folders, read back."""
    path = _folder(spark, "batches")
    E.write_batches(X.raw_posts(spark, sf_dir).select("post_id", F.col("text").alias("line")), path, "post_id", BATCH)
    return spark.read.text(path).groupBy(F.col("batch").cast("long").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@register("s6_lexicon_files", sql_with("""
SELECT lexicon, kind, count(*) AS n_terms, round(sum(score), 3) AS score, sum(n_pos) AS n_pos, sum(n_neg) AS n_neg
FROM lexicon WHERE lexicon = 'nrc' GROUP BY lexicon, kind""", "lexicon"))
def s6_lexicon_files(spark, sf_dir):
    """Gzipped TSV files of one lexicon, one folder name per kind."""
    path = _folder(spark, "lexicon")
    lex = X.lexicon(spark, sf_dir).where(F.col("lexicon") == "nrc")
    name = F.concat(F.when(F.col("kind") == "uni", "unigrams").when(F.col("kind") == "bi", "bigrams").otherwise("pairs"),
                    F.lit("-pmilexicon"))
    line = F.concat_ws("\t", "term", F.col("score").cast("string"), F.col("n_pos").cast("string"),
                       F.col("n_neg").cast("string"))
    lex.select(name.alias("file"), line.alias("value")).write.partitionBy("file") \
        .option("compression", "gzip").text(path)
    read = E.read_lexicon_dir(spark, f"{path}/*", "nrc")
    return read.groupBy("lexicon", "kind").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("score"), 3).alias("score"),
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


@register("s7_word_weight_file", sql_with("SELECT word, weight FROM afinn", "afinn"))
def s7_word_weight_file(spark, sf_dir):
    path = _folder(spark, "weights")
    E.write_tsv(X.afinn(spark, sf_dir).select(F.upper("word").alias("word"), F.col("weight").cast("string").alias("w")),
                path, ["word", "w"])
    return E.read_word_weights(spark, path)


@register("s8_word_cluster_files", sql_with("SELECT cluster, word FROM word_clusters", "word_clusters"))
def s8_word_cluster_files(spark, sf_dir):
    """Clusters written as a folder each and read by their names."""
    path = _folder(spark, "clusters")
    E.write_word_clusters(X.word_clusters(spark, sf_dir), path)
    return E.read_word_cluster_dir(spark, path)


@register("s9_cluster_sentiment_file", sql_with("SELECT cluster::VARCHAR AS cluster, sentiment FROM auto_cluster_index",
                                                "auto_cluster_index"))
def s9_cluster_sentiment_file(spark, sf_dir):
    """The sentiments of the vectors' clusters as lines, read back."""
    path = _folder(spark, "sentiment")
    X.auto_cluster_index(spark, sf_dir).select(F.concat_ws(" ", F.col("cluster").cast("string"), "sentiment").alias("value")) \
        .write.text(path)
    return E.read_cluster_sentiment(spark, path)


@register("s10_cluster_index_file", sql_with("""
SELECT CAST(row_number() OVER (ORDER BY cluster) - 1 AS INTEGER) AS cluster, sentiment,
  CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN 2 WHEN 'neutral' THEN 4 END AS flag, size,
  round(size::DOUBLE / sum(size) OVER (), 9) AS share FROM auto_cluster_index""", "auto_cluster_index"))
def s10_cluster_index_file(spark, sf_dir):
    """``sentiment size`` lines in the order of the clusters; the line
    number is the cluster's id."""
    path = _folder(spark, "index")
    index = X.auto_cluster_index(spark, sf_dir)  # a line per cluster
    index.orderBy("cluster").coalesce(1).select(F.concat_ws(" ", "sentiment", F.col("size").cast("string")).alias("value")).write.text(path)
    return E.read_cluster_index(spark, path).withColumn("share", F.round("share", 9))


@register("s11_s17_cluster_labels", """
SELECT label AS cluster, count(*) AS n_posts, sum(vec_id) AS ids FROM embeddings GROUP BY label""")
def s11_s17_cluster_labels(spark, sf_dir):
    """S17 sink and S11 scan: labels saved by key, read back and joined."""
    path = _folder(spark, "labels")
    e = table(spark, sf_dir, "embeddings")
    E.write_cluster_labels(e.select(F.col("vec_id").alias("post_id"), F.col("label").alias("cluster")), path)
    back = E.read_cluster_labels(spark, path, e.select(F.col("vec_id").alias("post_id")))
    return back.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("post_id").alias("ids"))


@register("s12_wordnet_lemma_file", sql_with("""
SELECT DISTINCT coalesce(l.lemma, a.word) AS word
FROM afinn a CROSS JOIN (VALUES ('n'), ('v'), ('a'), ('r')) AS p(pos)
LEFT JOIN lemma l ON l.form = a.word AND l.pos = p.pos""", "afinn", "lemma"))
def s12_wordnet_lemma_file(spark, sf_dir):
    path = _folder(spark, "wordnet")
    words = X.afinn(spark, sf_dir).select("word")
    words.select(F.concat(F.lit("00001740 03 n 01 "), F.upper("word"), F.lit(" 0 001 @")).alias("value")) \
        .union(words.limit(1).select(F.lit("  1 a licence line").alias("value"))).write.text(path)
    return E.read_wordnet_lemmas(spark, path, X.lemma(spark, sf_dir))


@register("s13_word_set_file", sql_with("SELECT word FROM afinn", "afinn"))
def s13_word_set_file(spark, sf_dir):
    path = _folder(spark, "words")
    w = X.afinn(spark, sf_dir).select("word")
    w.union(w).write.text(path)  # a set: repeated lines count once
    return E.read_word_set(spark, path)


@register("s16_entity_rewrite", sql_with("SELECT post_id, text FROM clean_posts", "clean_posts"))
def s16_entity_rewrite(spark, sf_dir):
    """A copy with entities decoded, read back: encoding all listed
    entities first and decoding by the rewrite gives the texts again."""
    src, dst = _folder(spark, "encoded"), _folder(spark, "decoded")
    p = X.clean_posts(spark, sf_dir).select("post_id", "text")
    coded = F.replace("text", F.lit("&"), F.lit("&amp;"))
    for entity, char in C.HTML_ENTITIES:
        if char != "&":
            coded = F.replace(coded, F.lit(char), F.lit(entity))
    p.select(F.concat_ws("\t", F.col("post_id").cast("string"), coded).alias("value")).write.text(src)
    E.rewrite_html(spark, src, dst)
    f = F.split("value", "\t", 2)
    return spark.read.text(dst).select(F.get(f, 0).cast("long").alias("post_id"), F.get(f, 1).alias("text"))


@register("s19_similarity_output", sql_with("""
SELECT word_a, pos, word_b, scheme, score FROM similarity""", "similarity"))
def s19_similarity_output(spark, sf_dir):
    path = _folder(spark, "similarity")
    s = X.similarity(spark, sf_dir)
    s.select(F.concat(F.col("word_a"), F.lit("#"), "pos", F.lit(" "), "word_b", F.lit("#"), "pos", F.lit(" "),
                      F.col("score").cast("string")).alias("value")).write.text(path)
    return E.read_similarity_output(spark, path, "path")
