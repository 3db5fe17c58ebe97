"""Benchmark decontamination: SimHash of item-sized windows.

Only DataFrame functions.  Texts become runs of letters and digits in
lower case and 5-word shingles (64-bit hashes; an item of fewer than five
words is one shingle, so it matches only a text of just those words).  A window without a shingle of an item has similarity 0 to it,
so windows are laid only where a shingle is shared: shingle p of the text
equal to shingle o of an item puts an item-sized window at p - o.

Each window and item has a 64-bit SimHash.  Four 16-bit blocks index the
items: two fingerprints within RADIUS = 15 agree in one block up to 3
bits, so joining on every 3-bit neighbour of the items' blocks guarantees
all pairs within the radius.  Candidates are verified by exact weighted
Jaccard similarity of their shingle sets; a shingle of the item weighs
1 + ln(items / items that hold it), any other as one held by one item.

Defined cases: null or empty texts and items match nothing; texts are
compared once however often they are copied, and every row that carries
one is reported; equal items are reported one by one; among equally
similar windows the first counts; empty tables give an empty result;
only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import materialise, sized_lookup
from .columns import bind, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
BITS, BLOCKS, BLOCK_RADIUS = 64, 4, 3
BLOCK_BITS = BITS // BLOCKS
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
GAPS = r"[^\p{L}\p{N}]+"


def _tokens(text: Column) -> Column:
    parts = F.split(F.lower(text_or_empty(text)), GAPS)
    return F.array_remove(parts, "")


def shingle_hashes(text: Column) -> Column:
    """Hash of every shingle in order; fewer words make one shingle."""
    def cut(w: Column) -> Column:
        n = F.size(w)
        return F.when(n == 0, F.array().cast("array<bigint>")) \
            .when(n < SHINGLE, F.array(F.xxhash64(F.concat_ws(" ", w)))) \
            .otherwise(F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(
                *[F.get(w, i + k) for k in range(SHINGLE)])))
    return bind(_tokens(text), cut)


def simhash(hashes: Column) -> Column:
    """Bit b is set if more of the hashes have it set than not."""
    zero = F.lit(0).cast("long")

    def bit(mask: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(h.bitwiseAND(mask) != 0, 1).otherwise(0))
        return F.when(2 * ones > F.size(hashes), mask).otherwise(zero)
    masks = F.array(*[F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0)).cast("long") for b in range(BITS)])
    return F.aggregate(F.transform(masks, bit), zero, lambda a, x: a.bitwiseOR(x))


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def item_table(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, size, hashes, fingerprint, weights, other): ``weights`` pairs
    the distinct shingles with their weights, ``other`` is the weight of a
    shingle outside the item."""
    items = materialise(benchmark.select(F.col(key).alias("item"), shingle_hashes(F.col(text)).alias("hashes"))
                        .where(F.size("hashes") > 0).withColumn("row", F.monotonically_increasing_id()))
    n = max(1, items.count())
    pairs = items.select("row", F.explode(F.array_distinct("hashes")).alias("h"))
    held = pairs.groupBy("h").agg(F.count("*").alias("df"))
    weighed = pairs.join(held, "h").groupBy("row").agg(F.collect_list(
        F.struct("h", (1 + F.log(F.lit(float(n)) / F.col("df"))).alias("w"))).alias("weights"))
    return materialise(items.join(weighed, "row").select(
        "row", "item", F.size("hashes").alias("size"), "hashes", simhash(F.col("hashes")).alias("print"),
        "weights", F.lit(1.0 + math.log(n)).alias("other")))


def _windows(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(uid, windows: distinct (start, size)) where a shingle is shared."""
    at = items.select("size", F.posexplode("hashes").alias("o", "h")).distinct()
    hits = texts.select("uid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("p", "h")) \
        .join(sized_lookup(at), "h")
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("o"), F.col("n") - F.col("size")))
    return hits.select("uid", F.struct(start.alias("start"), "size").alias("w")).distinct() \
        .groupBy("uid").agg(F.collect_list("w").alias("windows"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, similarity, start_word, n_shingles, distance): the most
    similar window of every row for every item it leaks."""
    leaks = leaking_texts(docs, benchmark, text, item_key, item_text, threshold)
    rows = docs.select(F.col(key).alias("key"), _uid(F.col(text)).alias("uid"))
    return rows.join(leaks, "uid").select(
        F.col("key").alias(key), F.col("item").alias(item_key), "similarity", "start_word", "n_shingles", "distance")


def _uid(text: Column) -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(uid, item, ...) of every distinct text that leaks an item."""
    items = item_table(benchmark, item_key, item_text)
    texts = docs.select(_uid(F.col(text)).alias("uid"), F.col(text).alias("text"))
    found = materialise(_windows(texts.select("uid", shingle_hashes(F.col("text")).alias("hashes")), items))
    # only texts with a window are cut again; copies fold into one
    cut = texts.join(sized_lookup(found.select("uid", "windows")), "uid") \
        .select("uid", "windows", shingle_hashes(F.col("text")).alias("hashes")) \
        .select("uid", F.explode("windows").alias("w"), "hashes") \
        .select("uid", "w.start", "w.size", F.expr("slice(hashes, w.start + 1, w.size)").alias("part")) \
        .dropDuplicates(["uid", "start", "size"])
    windows = materialise(cut.withColumn("print", simhash(F.col("part"))))
    masks = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]
    near = F.array(*[F.lit(m) for m in masks])
    index = items.select("row", "size", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("key")) for k in range(BLOCKS)])).alias("b")) \
        .select("row", "size", "b.block", F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("b.key")))).alias("key"))
    probes = windows.select("uid", "start", "size", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("key")) for k in range(BLOCKS)])).alias("b")) \
        .select("uid", "start", "size", "b.block", "b.key")
    pairs = probes.join(index, ["size", "block", "key"]).select("uid", "start", "size", "row").distinct()
    full = pairs.join(windows, ["uid", "start", "size"]).join(
        sized_lookup(items.select("row", "item", F.col("print").alias("item_print"), "weights", "other")), "row")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    own = F.array_distinct("part")
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x["w"])
    both = bind(own, lambda p: F.struct(
        F.aggregate(F.filter("weights", lambda x: F.array_contains(p, x["h"])), F.lit(0.0), lambda a, x: a + x["w"]).alias("w"),
        F.size(F.array_except(p, F.transform("weights", lambda x: x["h"]))).alias("out")))
    scored = full.where(distance <= RADIUS).withColumn("distance", distance).withColumn("both", both) \
        .withColumn("similarity", F.col("both.w") / (total + F.col("both.out") * F.col("other"))) \
        .where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "size", "distance", "item")).alias("m")
    return scored.groupBy("uid", "row").agg(best).select(
        "uid", "m.item", "m.similarity", (-F.col("m.s")).alias("start_word"), F.col("m.size").alias("n_shingles"), "m.distance")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text leaks no item, with the input's own columns."""
    bad = sized_lookup(leaking_texts(docs, benchmark, text).select("uid").distinct())
    return docs.withColumn("__uid", _uid(F.col(text))).join(
        bad.withColumnRenamed("uid", "__uid"), "__uid", "left_anti").select(*docs.columns)
