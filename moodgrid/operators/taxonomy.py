"""Taxonomy similarity (S12, S19, J4, U9, U11) and the rule lemmatiser.

A taxonomy is read from the ``data.*`` lines of a dictionary distribution:
every line is a synset with its words and the offsets of its hypernyms.
Its ancestor closure holds the shortest distance of every synset to each of
its ancestors, found by breadth-first rounds of joins.  Two words are
compared through their common ancestors; the scores fill the similarity
table (word_a, pos, word_b, scheme, score) that U9 sums.

Each part of speech gets one virtual top above all synsets without a
hypernym, so any two words of it are related.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from .lookup import materialise, max_rows, sized_lookup, spread

TOP = -1
SCHEMES = ("path", "wup", "lch")


# --------------------------------------------------------------------------
# data.* lines
# --------------------------------------------------------------------------

def parse_synsets(lines: DataFrame, line: str = "value") -> DataFrame:
    """(pos, synset, words, parents) of every ``data.*`` line.

    Fields: offset, file number, type, word count (two hex digits), then
    word and lexical id in turn, pointer count, then symbol, offset, part of
    speech and source/target of each pointer.  Lines that start with a space
    are comments.  Satellite adjectives (``s``) count as adjectives.
    Parents are the targets of ``@`` and ``@i`` pointers of the same part of
    speech.  A line with too few fields, or whose numbers are none, is left
    out; null and empty lines too."""
    f = F.split(F.regexp_replace(F.col(line), r" \|.*$", ""), " ")
    t = lines.where(~F.col(line).startswith(" ")).select(f.alias("f"))
    n = F.expr("try_cast(conv(get(f, 3), 16, 10) as int)")
    t = t.select("f", F.expr("try_cast(get(f, 0) as bigint)").alias("synset"),
                 F.when(F.get("f", 2) == "s", C.WN_ADJ).otherwise(F.get("f", 2)).alias("pos"), n.alias("n"))
    t = t.select("*", F.expr("try_cast(get(f, 4 + 2 * n) as int)").alias("p"))
    t = t.where(F.col("synset").isNotNull() & (F.col("n") > 0) & F.col("p").isNotNull()
                & (F.size("f") >= 5 + 2 * F.col("n") + 4 * F.col("p")))
    words = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lower(F.get("f", 4 + 2 * i)))
    at = lambda i, k: F.get("f", 5 + 2 * F.col("n") + 4 * i + k)
    pointers = F.when(F.col("p") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("p") - 1, F.lit(0))),
        lambda i: F.struct(at(i, 0).alias("symbol"), at(i, 1).cast("bigint").alias("to"), at(i, 2).alias("pos")))
    ).otherwise(F.array())
    up = F.filter(pointers, lambda x: x["symbol"].isin("@", "@i") & (x["pos"] == F.get("f", 2)))
    return t.select("pos", "synset", F.array_distinct(words).alias("words"),
                    F.array_distinct(F.transform(up, lambda x: x["to"])).alias("parents"))


def read_synsets(spark: SparkSession, path: str) -> DataFrame:
    """S12's files with their pointers: ``parse_synsets`` of ``path``."""
    return parse_synsets(spark.read.text(path))


def senses(synsets: DataFrame) -> DataFrame:
    """(word, pos, synset)."""
    return synsets.select(F.explode("words").alias("word"), "pos", "synset").distinct()


# --------------------------------------------------------------------------
# ancestor closure
# --------------------------------------------------------------------------

def ancestors(synsets: DataFrame) -> DataFrame:
    """(pos, synset, ancestor, d): the shortest distance of every synset to
    each of its ancestors, itself (0) and the virtual top included.

    Round d extends the pairs found at distance d - 1 by one hypernym and
    keeps those not seen before, so rounds end at the deepest shortest path
    (also when pointers form a cycle).  A pointer to a synset that has no
    line leads to the top."""
    known = materialise(synsets.select("pos", "synset", "parents").groupBy("pos", "synset").agg(
        F.array_distinct(F.flatten(F.collect_list("parents"))).alias("parents")))  # one row per repeated line
    links = known.select("pos", F.col("synset").alias("child"), F.explode("parents").alias("parent"))
    real = links.join(known.select("pos", F.col("synset").alias("parent")), ["pos", "parent"], "left_semi")
    tops = known.select("pos", F.col("synset").alias("child")).join(real, ["pos", "child"], "left_anti")
    edges = sized_lookup(real.select("pos", "child", "parent")
                         .unionByName(tops.select("pos", "child", F.lit(TOP).cast("long").alias("parent"))))
    step = known.select("pos", "synset", F.col("synset").alias("ancestor"), F.lit(0).alias("d"))
    found, rounds = step, 0
    while True:
        rounds += 1
        step = materialise(
            step.join(edges, (step["pos"] == edges["pos"]) & (step["ancestor"] == edges["child"]))
            .select(step["pos"], "synset", F.col("parent").alias("ancestor"), F.lit(rounds).alias("d")).distinct()
            .join(found.select("pos", "synset", "ancestor"), ["pos", "synset", "ancestor"], "left_anti"))
        if step.isEmpty():
            return _with_top(found)
        found = found.unionByName(step)


def _with_top(found: DataFrame) -> DataFrame:
    """A synset that only a cycle reaches gets the top one above its
    farthest ancestor."""
    lost = found.groupBy("pos", "synset").agg(F.max("d").alias("d"), F.min("ancestor").alias("low")) \
        .where(F.col("low") != TOP)
    return found.unionByName(lost.select("pos", "synset", F.lit(TOP).cast("long").alias("ancestor"),
                                         (F.col("d") + 1).alias("d")))


# --------------------------------------------------------------------------
# similarity table
# --------------------------------------------------------------------------

def word_similarity(synsets: DataFrame, words: DataFrame, targets: DataFrame,
                    schemes=SCHEMES) -> DataFrame:
    """(word_a, pos, word_b, scheme, score) of every word of ``words``
    with every word of ``targets`` (each a frame with a column ``word``)
    that both have a sense of that part of speech.

    With d(w, c) the shortest distance of a sense of w to a common ancestor
    c, and depth(c) the nodes from the top to c:

    * path: 1 / l, where l = min over c of d(a, c) + d(b, c) + 1;
    * lch: ln(2 * D / l), D the greatest depth of the part of speech;
    * wup: max over c of 2 * depth(c) / (d(a, c) + d(b, c) + 2 * depth(c)).

    ``targets`` is the query set (cluster words): its ancestors are the
    broadcast side within the bounds of ``sized_lookup``, and a word's
    scores are formed where its own ancestors lie, with partial
    aggregation, before anything is moved.  Word pairs are what is asked
    for, so the result has up to |words| x |targets| rows."""
    bad = [s for s in schemes if s not in SCHEMES]
    if bad:
        raise ValueError(f"no taxonomy measure {bad}")
    up = materialise(ancestors(synsets))
    height = up.where(F.col("ancestor") == TOP)
    # at most one row per part of speech
    most = {r["pos"]: r["m"] + 1 for r in height.groupBy("pos").agg(F.max("d").alias("m")).collect()}
    depth = height.select("pos", F.col("synset").alias("ancestor"), (F.col("d") + 1).alias("depth"))
    named = senses(synsets)

    def of(side: DataFrame, word: str, d: str) -> DataFrame:
        mine = named.join(side.select("word").distinct(), "word", "left_semi")
        return mine.join(up, ["pos", "synset"]).groupBy("word", "pos", "ancestor").agg(F.min("d").alias(d)) \
            .withColumnRenamed("word", word)

    b = materialise(of(targets, "word_b", "db").join(depth, ["pos", "ancestor"], "left")
                    .withColumn("depth", F.coalesce("depth", F.lit(1))))  # the top itself
    # one shuffle by (word, pos) serves both aggregations of a word's rows; few bytes, but
    # much work per row, so the number of parts is fixed
    a = spread(of(words, "word_a", "da"), "word_a", "pos")
    best = _best_paths(a, b) if b.count() <= max_rows(b) else _joined_paths(a, b)
    longest = F.coalesce(*[F.when(F.col("pos") == p, F.lit(m)) for p, m in sorted(most.items())], F.lit(1))
    score = {"path": 1.0 / F.col("l"), "lch": F.log(2.0 * longest / F.col("l")), "wup": F.col("wup")}
    return best.select("word_a", "pos", "word_b", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scheme"), F.round(score[s], 6).alias("score")) for s in schemes])).alias("x")) \
        .select("word_a", "pos", "word_b", "x.scheme", "x.score")


def _joined_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word_a, pos, word_b, l, wup) of words and targets that share an ancestor."""
    far = F.col("da") + F.col("db")
    return a.join(b, ["pos", "ancestor"]).groupBy("word_a", "pos", "word_b").agg(
        F.min(far + 1).alias("l"),
        F.max(2.0 * F.col("depth") / (far + 2 * F.col("depth"))).alias("wup"))


_CELLS = 1 << 20  # words x targets of one step


def _best_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """``_joined_paths`` of targets within the broadcast bound: tasks lay the
    targets below each ancestor of a word over one row of a matrix."""
    rows = b.select("pos", "ancestor", "word_b", "db", "depth").toArrow().sort_by([("pos", "ascending"), ("ancestor", "ascending")])
    # at most one entry per part of speech
    parts = {p: rows.filter(pc.equal(rows["pos"], p)) for p in rows["pos"].unique().to_pylist() if p is not None}
    shared = b.sparkSession.sparkContext.broadcast({p: _below(t) for p, t in parts.items()})
    lists = a.groupBy("pos", "word_a").agg(F.collect_list(F.struct("ancestor", "da")).alias("up"))

    def task(batches):
        for batch in batches:
            for p in batch.column("pos").unique().to_pylist():
                if p in shared.value:
                    mine = batch.filter(pc.equal(batch.column("pos"), p))
                    step = max(1, _CELLS // len(shared.value[p][0]))
                    for i in range(0, mine.num_rows, step):
                        yield _matrix(p, mine.slice(i, step), *shared.value[p])

    return lists.mapInArrow(task, "word_a string, pos string, word_b string, l int, wup double")


def _below(t: pa.Table) -> tuple:
    """Targets, ancestors, their first entries, and the entries' targets,
    distances and depths, of rows in order of ancestors."""
    words = t["word_b"].combine_chunks().dictionary_encode()
    up, first = np.unique(t["ancestor"].to_numpy(), return_index=True)
    return (words.dictionary, up, np.append(first, t.num_rows), words.indices.to_numpy(),
            t["db"].to_numpy().astype(np.int64), t["depth"].to_numpy().astype(np.int64))


def _matrix(pos: str, words: pa.RecordBatch, targets, up, first, target, db, depth) -> pa.RecordBatch:
    lists = words.column("up")
    row = np.repeat(np.arange(words.num_rows), lists.value_lengths().to_numpy())
    flat = lists.flatten()
    ancestor, da = flat.field("ancestor").to_numpy(), flat.field("da").to_numpy().astype(np.int64)
    at = np.minimum(np.searchsorted(up, ancestor), len(up) - 1)
    known = up[at] == ancestor
    at, row, da = at[known], row[known], da[known]
    size = first[at + 1] - first[at]
    entry = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
    far = np.repeat(da, size) + db[entry]
    cell = np.repeat(row, size) * len(targets) + target[entry]
    length = np.full(words.num_rows * len(targets), np.iinfo(np.int32).max, np.int64)
    wup = np.zeros(len(length))
    np.minimum.at(length, cell, far + 1)
    np.maximum.at(wup, cell, 2.0 * depth[entry] / (far + 2 * depth[entry]))
    met = np.flatnonzero(length < np.iinfo(np.int32).max)
    return pa.record_batch({
        "word_a": words.column("word_a").take(pa.array(met // len(targets))), "pos": pa.repeat(pos, len(met)),
        "word_b": targets.take(pa.array(met % len(targets))), "l": pa.array(length[met].astype(np.int32)), "wup": pa.array(wup[met])})


# --------------------------------------------------------------------------
# T6 rule lemmatiser
# --------------------------------------------------------------------------

def read_exceptions(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """(form, pos, base) of an exception file: a form and its base forms."""
    f = F.split(F.trim(F.lower("value")), " +")
    return spark.read.text(path).where(F.size(f) > 1).select(
        F.get(f, 0).alias("form"), F.lit(pos).alias("pos"), F.explode(F.slice(f, 2, F.size(f) - 1)).alias("base"))


def _detached(form: Column, pos: Column) -> Column:
    """Candidates (rank, base) of a form: itself first, then one per suffix
    rule of its part of speech that applies, in rule order."""
    out = [F.struct(F.lit(0).alias("rank"), form.alias("base"))]
    for p, rules in C.DETACHMENT_RULES.items():
        for i, (suffix, ending) in enumerate(rules):
            base = F.concat(F.substring(form, F.lit(1), F.length(form) - len(suffix)), F.lit(ending))
            out.append(F.when((pos == p) & form.endswith(suffix) & (F.length(base) > 0),
                              F.struct(F.lit(i + 2).alias("rank"), base.alias("base"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def rule_lemmas(forms: DataFrame, dictionary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(form, pos, lemma) of every distinct (form, pos) of ``forms``, a
    lemma table for J3, J4, S12 and S18.

    Candidates are the form itself, the base forms its exceptions name
    (which ``dictionary`` need not hold) and one suffix detached by each
    rule; of those that ``dictionary`` (word, pos) accepts the shortest
    wins, ties by rule order, then by spelling.  A form without an accepted
    candidate is its own lemma.  Rows with a null form or part of speech
    are left out.  Only distinct forms are looked up, so a token that holds
    a third of all rows is one row here."""
    f = forms.select("form", "pos").where(F.col("form").isNotNull() & F.col("pos").isNotNull()).distinct()
    tried = f.select("form", "pos", F.explode(_detached(F.col("form"), F.col("pos"))).alias("c")) \
        .select("form", "pos", F.col("c.rank").alias("rank"), F.col("c.base").alias("base"))
    words = sized_lookup(dictionary.select(F.col("word").alias("base"), "pos").distinct())
    taken = tried.join(words, ["base", "pos"], "left_semi").select("form", "pos", "rank", "base")
    if exceptions is not None:
        named = exceptions.select("form", "pos", "base").join(f, ["form", "pos"], "left_semi")
        taken = taken.unionByName(named.select("form", "pos", F.lit(1).alias("rank"), "base"))
    best = taken.groupBy("form", "pos").agg(F.min(F.struct(F.length("base").alias("n"), "rank", "base")).alias("b"))
    return f.join(best, ["form", "pos"], "left").select("form", "pos", F.coalesce("b.base", "form").alias("lemma"))
