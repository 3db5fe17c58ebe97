"""Packing into length buckets whose boundaries minimise padding.

A global histogram of token counts (fixed resolution, so its size has a
bound that does not depend on the corpus) goes through a dynamic program
that chooses ``n_buckets`` boundaries of least total padding.  Rows of a
bucket are numbered without gathering it anywhere: hash shards of bounded
size are numbered on their own and shifted by the counts of the shards
before them; runs of ``budget // boundary`` rows form the batches.

Defined cases: a null or empty text has no token and goes to the first
bucket; a text longer than the budget forms a batch of its own; repeated
rows and equal ids are packed row by row; an empty table gives an empty
result; input columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lookup import materialise
from .columns import text_or_empty

N_BUCKETS = 16
BUDGET = 65_536
EXACT = 256        # lengths up to here have a bin each
STEPS = 128        # bins in every doubling above
SHARD_ROWS = 8192  # rows that one shard of a bucket is meant to hold


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def bin_edge(n: Column) -> Column:
    """Upper end of the histogram bin of a length: the length itself up to
    ``EXACT``, then rounded up at a relative step of 1 / STEPS."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")))) / STEPS
    return F.when(n <= EXACT, n).otherwise(F.ceil(n / step) * step).cast("long")


def choose_boundaries(edges, counts, tokens, n_buckets: int) -> list[int]:
    """Boundaries (a subset of ``edges``, the last one included) that
    minimise sum(boundary - length) over all rows.

    ``best[j]`` after k rounds: least padding of the first j bins in at
    most k buckets; each round tries every start i of the last bucket.
    """
    edges = np.asarray(edges, dtype=np.float64)
    m = len(edges)
    if m == 0:
        return []
    c = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    s = np.concatenate([[0.0], np.cumsum(np.asarray(tokens, dtype=np.float64))])
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    starts = []
    for _ in range(min(n_buckets, m)):
        now, frm = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            total = best[:j] + edges[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(total))
            if total[i] < now[j]:
                now[j], frm[j] = total[i], i
        starts.append(frm)
        best = now
    out, j = [], m
    for frm in reversed(starts):
        if j > 0 and frm[j] >= 0:
            out.append(int(edges[j - 1]))
            j = int(frm[j])
    return sorted(out)


def histogram(lengths: DataFrame) -> list:
    """Rows (edge, count, tokens): at most EXACT + STEPS per doubling."""
    return lengths.groupBy(bin_edge(F.col("n_tokens")).alias("edge")).agg(
        F.count("*").alias("c"), F.sum("n_tokens").alias("t")).orderBy("edge").collect()


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", n_buckets: int = N_BUCKETS,
         budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, n_tokens, bucket, bucket_len, batch, batch_rows, padding) of
    every input row; ``batch`` counts from 0 inside its bucket."""
    lengths = materialise(docs.select(
        F.col(key).alias("key"), n_words(F.col(text)).alias("n_tokens"),
        F.xxhash64(F.col(key), F.col(text)).alias("spot")))
    hist = histogram(lengths)
    bounds = choose_boundaries([r["edge"] for r in hist], [r["c"] for r in hist],
                               [r["t"] for r in hist], n_buckets)
    sizes = [sum(r["c"] for r in hist if lo < r["edge"] <= hi)
             for lo, hi in zip([-1] + bounds[:-1], bounds)]
    n = F.col("n_tokens")
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]).cast("array<bigint>")
    per_batch = F.array(*[F.lit(max(1, budget // max(b, 1))).cast("long") for b in bounds]).cast("array<bigint>")
    shards = F.array(*[F.lit(-(-c // shard_rows)).cast("long") for c in sizes]).cast("array<bigint>")
    bucket = F.size(F.filter(edges, lambda e: e < n))
    rows = lengths.withColumn("bucket", bucket) \
        .withColumn("shard", F.pmod(F.col("spot"), F.get(shards, F.col("bucket"))))
    # offsets of the shards: one row per shard, summed along each bucket
    along = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "shard").agg(F.count("*").alias("size")) \
        .withColumn("before", F.coalesce(F.sum("size").over(along), F.lit(0))).drop("size")
    inside = Window.partitionBy("bucket", "shard").orderBy("spot", "key", "n_tokens")
    numbered = rows.withColumn("rn", F.row_number().over(inside) - 1) \
        .join(offsets, ["bucket", "shard"]) \
        .withColumn("at", F.col("rn") + F.col("before"))
    cap, edge = F.get(per_batch, F.col("bucket")), F.get(edges, F.col("bucket"))
    total = F.get(F.array(*[F.lit(c).cast("long") for c in sizes]).cast("array<bigint>"), F.col("bucket"))
    batch = F.floor(F.col("at") / cap).cast("long")
    return numbered.select(
        F.col("key").alias(key), "n_tokens", "bucket", edge.alias("bucket_len"), batch.alias("batch"),
        F.least(cap, total - batch * cap).alias("batch_rows"), (edge - n).alias("padding"))
