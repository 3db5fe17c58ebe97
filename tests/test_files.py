"""File scans and sinks: write small inputs to a fresh scratch folder,
read them back with the engine's readers."""

import gzip
import os

from pyspark.sql import functions as F

from moodgrid.operators import etl as E
from moodgrid.operators import ingest as I


def _write(path, lines, gz=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = "".join(line + "\n" for line in lines).encode("utf-8")
    with (gzip.open(path, "wb") if gz else open(path, "wb")) as f:
        f.write(data)


def test_labelled_tsv_scan(spark, scratch):
    p = os.path.join(scratch, "train.tsv")
    _write(p, ["positive\tI loooove http://x.y @bob\tO V U @",
               "negative\tNot Available\tN",
               "neutral\tjust text\tN N",
               "text only\tN N",
               "weird\ta\tb\tc",
               "objective\tobj text\tN N"])
    rows = I.read_labelled_tsv(spark, p, I.class_mask("pne")).orderBy("post_id").collect()
    assert [(r["label"], r["text"]) for r in rows] == [(1, "I looove http://url @ref"), (4, "just text")]


def test_lexicon_dir_scan(spark, scratch):
    d = os.path.join(scratch, "nrc")
    _write(os.path.join(d, "unigrams-pmilexicon.txt.gz"), ["good\t1.5\t10\t2"], gz=True)
    _write(os.path.join(d, "bigrams-pmilexicon.txt.gz"), ["very good\t2.0\t5\t1"], gz=True)
    _write(os.path.join(d, "pairs-pmilexicon.txt.gz"), ["not---good\t-1.0\t1\t4"], gz=True)
    lex = E.read_lexicon_dir(spark, d, "nrc")
    got = sorted((r["kind"], r["term"], r["score"]) for r in lex.collect())
    assert got == [("bi", "very good", 2.0), ("pair", "not---good", -1.0), ("uni", "good", 1.5)]


def test_word_lists_and_clusters(spark, scratch):
    _write(os.path.join(scratch, "afinn.txt"), ["Good\t3", "bad\t-3"])
    w = {r["word"]: r["weight"] for r in E.read_word_weights(spark, os.path.join(scratch, "afinn.txt")).collect()}
    assert w == {"good": 3, "bad": -3}
    cdir = os.path.join(scratch, "clusters")
    _write(os.path.join(cdir, "happy.scf"), ["joy", "glad"])
    _write(os.path.join(cdir, "sad.scf"), ["gloom"])
    _write(os.path.join(cdir, ".hidden"), ["x"])
    c = sorted((r["cluster"], r["word"]) for r in E.read_word_cluster_dir(spark, cdir).collect())
    assert c == [("happy", "glad"), ("happy", "joy"), ("sad", "gloom")]
    _write(os.path.join(scratch, "sent.txt"), ["happy positive", "sad negative"])
    s = sorted(tuple(r) for r in E.read_cluster_sentiment(spark, os.path.join(scratch, "sent.txt")).collect())
    assert s == [("happy", "positive"), ("sad", "negative")]


def test_cluster_index_scan(spark, scratch):
    _write(os.path.join(scratch, "idx.txt"), ["positive 30", "negative 10", "bogus 60"])
    t = E.read_cluster_index(spark, os.path.join(scratch, "idx.txt")).orderBy("cluster").collect()
    assert [(r["cluster"], r["flag"], r["share"]) for r in t] == [(0, 1, 0.3), (1, 2, 0.1), (2, None, 0.6)]


def test_wordnet_and_similarity_scans(spark, scratch):
    _write(os.path.join(scratch, "wn", "data.noun"), ["  comment line", "0001 03 n 01 Dogs 0 x", "0002 03 n 01 cat 0 x"])
    lemma = spark.createDataFrame([("dogs", "n", "dog")], "form string, pos string, lemma string")
    words = sorted(r["word"] for r in E.read_wordnet_lemmas(spark, os.path.join(scratch, "wn", "data.*"), lemma).collect())
    assert words == ["cat", "dog", "dogs"]
    _write(os.path.join(scratch, "sim.out"), ["dog#n  cat#n 0.5", "bad line", "a#v b#v 0.25"])
    sim = sorted(tuple(r) for r in E.read_similarity_output(spark, os.path.join(scratch, "sim.out"), "path").collect())
    assert sim == [("a", "v", "b", "path", 0.25), ("dog", "n", "cat", "path", 0.5)]
    _write(os.path.join(scratch, "wl.txt"), ["dog", "dog ", "cat"])
    assert E.read_word_set(spark, os.path.join(scratch, "wl.txt")).count() == 2


def test_batch_writer_and_html_rewrite(spark, scratch):
    df = spark.range(25).select(F.col("id").alias("post_id"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    out = os.path.join(scratch, "batches")
    E.write_batches(df, out, "post_id", 10)
    back = spark.read.text(out)
    assert back.count() == 25
    assert sorted(r["batch"] for r in back.select("batch").distinct().collect()) == [0, 1, 2]
    src = os.path.join(scratch, "page.txt")
    _write(src, ["a &amp;lt; b &quot;c&quot;"])
    dst = os.path.join(scratch, "page_fixed")
    E.rewrite_html(spark, src, dst)
    assert spark.read.text(dst).first()[0] == 'a &lt; b "c"'


def test_column_projection_arity(spark):
    lines = spark.createDataFrame([(1, "a|b|c"), (2, "a|b"), (3, " x|y|z ")], "post_id long, line string")
    out = E.project_columns(lines, [2, 0], "|", only_if=3).orderBy("post_id").collect()
    assert [(r["c0"], r["c1"]) for r in out] == [("c", "a"), ("z", "x")]
