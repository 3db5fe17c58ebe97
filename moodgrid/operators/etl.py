"""Offline ETL operators and file scans/sinks.

Scans read plain files with Spark's readers (gzip is decompressed
transparently; dot- and underscore-files are skipped by Spark itself)
and return keyed DataFrames.  Sinks always write to a new path, never in
place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .ingest import label_flag, strip
from .lookup import materialise, sized_lookup

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | local index


# --------------------------------------------------------------------------
# global row index without a single-partition window
# --------------------------------------------------------------------------

def with_row_index(df: DataFrame, order_col: str, index_col: str = "idx") -> DataFrame:
    """0-based position of each row in ``order_col`` order.

    Rows are range-partitioned and sorted on the key and tagged with
    (partition, local position).  The tagged frame is checkpointed once:
    range bounds come from a sample, so counting one evaluation and
    numbering another could disagree.  Per-partition counts (one tiny row
    per partition) of that frame give each partition's offset.  No window
    over the whole table, no collect."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col) \
        .withColumn("_m", F.monotonically_increasing_id())
    d = materialise(d.withColumn("_p", F.shiftrightunsigned("_m", _LOCAL_BITS))
                    .withColumn("_l", F.col("_m").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))).drop("_m"))
    counts = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_p", F.coalesce(F.sum("_c").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    # at most one row per partition of the range exchange: a proven bound
    return d.join(F.broadcast(offs), "_p").withColumn(index_col, F.col("_o") + F.col("_l")) \
        .drop("_p", "_l", "_o")


def batch_assign(df: DataFrame, order_col: str, batch_size: int = C.BATCH_SIZE) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows; every row kept (Q6)."""
    return with_row_index(df, order_col).withColumn(
        "batch", F.floor(F.col("idx") / batch_size).cast("long"))


def write_batches(df: DataFrame, path: str, order_col: str, batch_size: int = C.BATCH_SIZE,
                  value_col: str = "line") -> None:
    """S15 sink: one folder per batch (``batch=<n>``)."""
    batch_assign(df, order_col, batch_size).select("batch", value_col) \
        .write.mode("errorifexists").partitionBy("batch").text(path)


# --------------------------------------------------------------------------
# S14 column projection, S16 entity rewrite
# --------------------------------------------------------------------------

def read_cluster_labels(spark: SparkSession, path: str, posts: DataFrame) -> DataFrame:
    """Saved (post_id, cluster) labels read back and joined to their
    posts by key, so the order of either side does not matter."""
    return posts.join(spark.read.parquet(path).select("post_id", "cluster"), "post_id")


def write_cluster_labels(labels: DataFrame, path: str) -> None:
    """S17 sink: (post_id, cluster), one new folder per labelling."""
    labels.select("post_id", "cluster").write.mode("errorifexists").parquet(path)


def project_columns(lines: DataFrame, columns: list[int], delim: str, only_if: int = -1,
                    line_col: str = "line") -> DataFrame:
    """S14 (+P6): split each line on ``delim``; with ``only_if >= 0`` keep
    lines with exactly that many fields; select the given columns."""
    f = F.split(strip(F.col(line_col)), _regex_literal(delim))
    d = lines.where(F.size(f) == only_if) if only_if >= 0 else lines
    return d.select(*[c for c in d.columns if c != line_col],
                    *[F.get(f, i).alias(f"c{k}") for k, i in enumerate(columns)])


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


def write_tsv(df: DataFrame, path: str, cols: list[str]) -> None:
    """TSV sink: the columns joined by tabs, one line per row."""
    df.select(F.concat_ws("\t", *cols).alias("value")).write.mode("errorifexists").text(path)


def rewrite_html(spark: SparkSession, src: str, dst: str) -> None:
    """Entity-decoded copy of a text file (new path, never in place)."""
    spark.read.text(src).select(T.decode_html("value").alias("value")).write.mode("errorifexists").text(dst)


# --------------------------------------------------------------------------
# S6–S13, S19 file scans
# --------------------------------------------------------------------------

def read_lexicon_dir(spark: SparkSession, path: str, lexicon: str) -> DataFrame:
    """``unigrams|bigrams|pairs-pmilexicon.txt.gz`` TSV files of one
    lexicon -> (lexicon, kind, term, score, n_pos, n_neg)."""
    df = spark.read.csv(path, sep="\t", quote="", schema="term string, score double, n_pos int, n_neg int")
    kind = F.regexp_extract(F.input_file_name(), r"(unigrams|bigrams|pairs)-pmilexicon", 1)
    k = F.when(kind == "unigrams", "uni").when(kind == "bigrams", "bi").otherwise("pair")
    return df.select(F.lit(lexicon).alias("lexicon"), k.alias("kind"), "term", "score", "n_pos", "n_neg")


def read_word_weights(spark: SparkSession, path: str) -> DataFrame:
    """``word \\t weight`` -> (word lower-cased, weight int)."""
    df = spark.read.csv(path, sep="\t", quote="", schema="word string, weight string")
    return df.select(F.lower(F.trim("word")).alias("word"), F.trim("weight").cast("int").alias("weight"))


def read_word_cluster_dir(spark: SparkSession, path: str) -> DataFrame:
    """One file per cluster, or one folder of part files as Spark writes
    them, one word per line -> (cluster, word); the cluster is the file's or
    folder's name."""
    df = spark.read.option("recursiveFileLookup", "true").text(path)
    return df.select(cluster_name(F.input_file_name()).alias("cluster"), F.trim("value").alias("word"))


def write_word_clusters(clusters: DataFrame, path: str) -> None:
    """(cluster, word) as one folder of part files per cluster."""
    clusters.select("cluster", "word").write.mode("errorifexists").partitionBy("cluster").text(path)


def cluster_name(file: Column) -> Column:
    """File name without folders and extension; of a part file the name of
    its folder, without the column that a partitioned writer puts first."""
    own = F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)
    folder = F.regexp_extract(file, r"(?:[^/=]+=)?([^/]+?)(\.[^./]*)?/[^/]*$", 1)
    return F.when(own.startswith("part-"), folder).otherwise(own)


def read_cluster_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """``cluster sentiment`` lines -> (cluster, sentiment)."""
    df = spark.read.text(path)
    f = F.split(F.trim("value"), " ")
    return df.select(F.get(f, 0).alias("cluster"), F.get(f, 1).alias("sentiment"))


def read_cluster_index(spark: SparkSession, path: str) -> DataFrame:
    """``sentiment size`` lines, line number = cluster id ->
    (cluster, sentiment, flag, size, share)."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    idx = with_row_index(lines.withColumn("_k", F.monotonically_increasing_id()), "_k", "cluster").drop("_k")
    f = F.split(F.trim("line"), " ")
    t = idx.select(F.col("cluster").cast("int").alias("cluster"), F.get(f, 0).alias("sentiment"),
                   F.get(f, 1).cast("long").alias("size"))
    return cluster_index_table(t)


def cluster_index_table(t: DataFrame) -> DataFrame:
    """(cluster, sentiment, size) -> + flag (P3 of positive/negative/neutral
    only) and size share (A15)."""
    flag = F.when(F.col("sentiment").isin("positive", "negative", "neutral"), label_flag(F.col("sentiment")))
    total = t.agg(F.sum("size")).scalar()
    return t.select("cluster", "sentiment", flag.alias("flag"), "size", (F.col("size") / total).alias("share"))


def read_wordnet_lemmas(spark: SparkSession, path: str, lemma: DataFrame | None = None) -> DataFrame:
    """``data.*`` lines not starting with a space, field 4 lower-cased,
    lemmatised for n/v/a/r (T6), distinct -> (word)."""
    df = spark.read.text(path).where(~F.col("value").startswith(" "))
    w = df.select(F.lower(F.get(F.split("value", " "), 4)).alias("form"))
    pos = F.explode(F.array(*[F.lit(p) for p in (C.WN_NOUN, C.WN_VERB, C.WN_ADJ, C.WN_ADV)])).alias("pos")
    w = w.select("form", pos)
    if lemma is not None:
        w = w.join(sized_lookup(lemma), ["form", "pos"], "left") \
            .select(F.coalesce("lemma", "form").alias("word"))
    else:
        w = w.select(F.col("form").alias("word"))
    return w.distinct()


def read_word_set(spark: SparkSession, path: str) -> DataFrame:
    """One word per line -> distinct (word)."""
    return spark.read.text(path).select(F.trim("value").alias("word")).distinct()


def read_similarity_output(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    """``a#p b#p score`` lines with exactly three fields ->
    (word_a, pos, word_b, scheme, score)."""
    f = F.split(F.trim("value"), " +")
    df = spark.read.text(path).where(F.size(f) == 3)
    a, b = F.get(f, 0), F.get(f, 1)
    return df.select(F.substring_index(a, "#", 1).alias("word_a"), F.substring_index(a, "#", -1).alias("pos"),
                     F.substring_index(b, "#", 1).alias("word_b"), F.lit(scheme).alias("scheme"),
                     F.get(f, 2).cast("double").alias("score"))


# --------------------------------------------------------------------------
# S18 / W4 / K2 related-word responses -> ranked word list
# --------------------------------------------------------------------------

WORD_FIELD_RE = r'"word": "(.*?)",'


def ranked_related_words(responses: DataFrame, top_n: int = 100,
                         lemma: DataFrame | None = None) -> DataFrame:
    """(keyword, body) -> (keyword, word, rank).

    Every ``"word": "…",`` value of the response in order; multi-word
    values are skipped but still advance the counter; each value is
    lemmatised for noun, verb, adjective, adverb in that order and
    lower-cased; a word keeps its first rank (W4); at most ``top_n``
    words per keyword, in rank order (K2)."""
    m = responses.select("keyword", F.posexplode(F.regexp_extract_all("body", F.lit(WORD_FIELD_RE), 1))
                         .alias("pos", "match"))
    m = m.where(~F.col("match").contains(" "))
    pos_order = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(p).alias("p"))
                          for i, p in enumerate((C.WN_NOUN, C.WN_VERB, C.WN_ADJ, C.WN_ADV))])
    m = m.select("keyword", "pos", "match", F.explode(pos_order).alias("x")) \
        .select("keyword", "pos", "match", F.col("x.o").alias("o"), F.col("x.p").alias("p"))
    if lemma is not None:
        m = m.join(sized_lookup(lemma.withColumnRenamed("form", "match").withColumnRenamed("pos", "p")),
                   ["match", "p"], "left").withColumn("word", F.lower(F.coalesce("lemma", "match")))
    else:
        m = m.withColumn("word", F.lower("match"))
    first = m.groupBy("keyword", "word").agg(F.min(F.struct("pos", "o")).alias("k"))
    w = Window.partitionBy("keyword").orderBy("k")
    ranked = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.lit(int(top_n)))
    # the counter counts single-word matches (1-based) in response order
    single = responses.select("keyword", F.posexplode(F.regexp_extract_all("body", F.lit(WORD_FIELD_RE), 1))
                              .alias("pos", "match")).where(~F.col("match").contains(" "))
    cnt = single.select("keyword", "pos", F.row_number().over(
        Window.partitionBy("keyword").orderBy("pos")).alias("rank"))
    return ranked.select("keyword", "word", F.col("k.pos").alias("pos")) \
        .join(cnt, ["keyword", "pos"]).select("keyword", "word", F.col("rank").cast("long").alias("rank"))
