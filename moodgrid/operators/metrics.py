"""Aggregations and evaluation metrics.

Every metric is one aggregation pass with conditional counters (partial
aggregation on the map side), so a label or cluster holding a third of
all rows never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .lookup import materialise

LABELS3 = (C.POS, C.NEG, C.NEU)


# --------------------------------------------------------------------------
# A1–A3 cluster statistics
# --------------------------------------------------------------------------

def cluster_sizes(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A1: (cluster, n)."""
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def cluster_label_counts(df: DataFrame, cluster_col: str = "cluster",
                         label_col: str = "prediction") -> DataFrame:
    """A2: (cluster, label, n)."""
    return df.groupBy(cluster_col, label_col).agg(F.count(F.lit(1)).alias("n"))


def purity(df: DataFrame, cluster_col: str = "cluster", label_col: str = "prediction") -> DataFrame:
    """A3: sum over clusters of the largest label count / all rows -> one
    row (purity, n_rows, n_clusters)."""
    per = cluster_label_counts(df, cluster_col, label_col)
    top = per.groupBy(cluster_col).agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return top.agg((F.sum("top") / F.sum("size")).alias("purity"),
                   F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"))


def size_shares(df: DataFrame, size_col: str = "size") -> DataFrame:
    """Share of each size in the total (scalar subquery total, no
    single-partition window)."""
    total = df.agg(F.sum(size_col)).scalar()
    return df.withColumn("share", F.col(size_col) / total)


# --------------------------------------------------------------------------
# A4 linear histogram, T11 stepped range
# --------------------------------------------------------------------------

def linear_histogram(values: DataFrame, value_col: str, num_buckets: int,
                     weight_col: str | None = None, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """A4: ``num_buckets`` equal-width buckets between min and max; a value
    goes to the first edge >= it (edge i = min + i*step; edge 0 holds only
    the minimum).  Empty buckets are reported with 0.  All min = max
    gives a single bucket.  -> (*group_cols, bucket, edge, n)"""
    w = F.col(weight_col) if weight_col else F.lit(1)
    v = F.col(value_col)
    stats = values.groupBy(*group_cols).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    k = num_buckets
    step = (F.col("_mx") - F.col("_mn")) / k
    j = _attach(values, stats, group_cols)
    idx = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.lit(k), F.greatest(F.lit(0), F.ceil((v - F.col("_mn")) / step).cast("int"))))
    counts = j.groupBy(*group_cols, idx.alias("bucket")).agg(F.sum(w).cast("long").alias("n"))
    nb = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(F.lit(k))
    edges = stats.select(*group_cols, "_mn", "_mx", F.explode(F.sequence(F.lit(0), nb)).alias("bucket"))
    edges = edges.select(*group_cols, "bucket",
                         (F.col("_mn") + F.col("bucket") * (F.col("_mx") - F.col("_mn")) / k).alias("edge"))
    return edges.join(counts, [*group_cols, "bucket"], "left").select(
        *group_cols, "bucket", "edge", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _attach(values: DataFrame, stats: DataFrame, group_cols) -> DataFrame:
    if group_cols:
        return values.join(F.broadcast(stats), list(group_cols))
    mn = stats.select("_mn").scalar()
    mx = stats.select("_mx").scalar()
    return values.withColumn("_mn", mn).withColumn("_mx", mx)


def thresholds(spark: SparkSession, start=C.SWEEP_START, stop=C.SWEEP_STOP,
               step=C.SWEEP_STEP) -> Column:
    """T11 as an array column of the sweep points (inclusive stop)."""
    return T.stepped_range(start, stop, step)


# --------------------------------------------------------------------------
# A7–A11 classification metrics
# --------------------------------------------------------------------------

def confusion(pairs: DataFrame, labels=LABELS3, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn, tn) for each label in one pass over the pairs."""
    t, p = F.col(truth), F.col(pred)
    aggs = []
    for lab in labels:
        aggs += [F.count(F.when((p == lab) & (t == lab), 1)).alias(f"tp_{lab}"),
                 F.count(F.when((p == lab) & (t != lab), 1)).alias(f"fp_{lab}"),
                 F.count(F.when((p != lab) & (t == lab), 1)).alias(f"fn_{lab}"),
                 F.count(F.when((p != lab) & (t != lab), 1)).alias(f"tn_{lab}")]
    one = pairs.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"tp_{lab}").alias("tp"),
                              F.col(f"fp_{lab}").alias("fp"), F.col(f"fn_{lab}").alias("fn"),
                              F.col(f"tn_{lab}").alias("tn")) for lab in labels])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def f1_expr(tp, fp, fn) -> Column:
    """Standard F1; 0 when there is no true positive (Q19)."""
    return F.when(tp == 0, F.lit(0.0)).otherwise(2.0 * tp / (2.0 * tp + fp + fn))


def label_scores(pairs: DataFrame, labels=LABELS3, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """A7 + A8: (label, tp, fp, fn, tn, f1, accuracy, precision)."""
    c = confusion(pairs, labels, truth, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("label", "tp", "fp", "fn", "tn",
                    f1_expr(tp, fp, fn).alias("f1"),
                    ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
                    F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / (tp + fp)).alias("precision"))


def macro_report(pairs: DataFrame, mask: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Macro F1 and macro accuracy over the labels in ``mask``,
    plus overall accuracy -> one row."""
    labs = [lab for lab in (C.POS, C.NEG, C.NEU, C.OBJ, C.OON) if lab & mask]
    s = label_scores(pairs, labs, truth, pred)
    overall = pairs.agg((F.count(F.when(F.col(truth) == F.col(pred), 1)) / F.count(F.lit(1))).alias("acc")).scalar()
    return s.agg(F.avg("f1").alias("macro_f1"), F.avg("accuracy").alias("macro_accuracy")) \
        .withColumn("accuracy", overall)


def three_class_report(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """F1 and accuracy of positive, negative, neutral; macro over
    positive and negative (Q20: labels used as named)."""
    s = label_scores(pairs, LABELS3, truth, pred)
    g = s.agg(*[F.max(F.when(F.col("label") == lab, F.col(m))).alias(f"{m}_{name}")
                for lab, name in ((C.POS, "pos"), (C.NEG, "neg"), (C.NEU, "neu"))
                for m in ("f1", "accuracy")])
    return g.select("*", ((F.col("f1_pos") + F.col("f1_neg")) / 2).alias("macro_f1"),
                    ((F.col("accuracy_pos") + F.col("accuracy_neg")) / 2).alias("macro_accuracy"))


# --------------------------------------------------------------------------
# A12 / A13 filter-as-classifier precision and the threshold sweep
# --------------------------------------------------------------------------

def threshold_sweep(scored: DataFrame, truth: str = "label", score: str = "score",
                    points: Column | None = None, min_percent: float = C.SWEEP_MIN_PERCENT) -> DataFrame:
    """A13 (and A12 per point): for each threshold t and label, the filter
    with ranges POS (t, inf), NEG (-inf, -t), NEU (-t, t) is a classifier;
    report its precision, or 0.0 when it fires on fewer than
    ``min_percent`` of the rows.  The sweep points are an in-row array, so
    the scored rows are read once and aggregated once."""
    pts = points if points is not None else thresholds(scored.sparkSession)
    s, y = F.col(score), F.col(truth)
    x = scored.select(y.alias("y"), s.alias("s"), F.explode(pts).alias("threshold"))
    t = F.col("threshold")
    fires = {C.POS: F.col("s") > t, C.NEG: F.col("s") < -t, C.NEU: (F.col("s") > -t) & (F.col("s") < t)}
    aggs = [F.count(F.lit(1)).alias("n")]
    for lab, cond in fires.items():
        aggs += [F.count(F.when(cond, 1)).alias(f"fire_{lab}"),
                 F.count(F.when(cond & (F.col("y") == lab), 1)).alias(f"hit_{lab}")]
    g = x.groupBy("threshold").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"fire_{lab}").alias("fired"),
                              F.col(f"hit_{lab}").alias("hits")) for lab in fires])
    e = g.select("threshold", "n", F.explode(rows).alias("r")).select("threshold", "n", "r.*")
    prec = (F.when(F.col("fired") < F.lit(min_percent) * F.col("n"), F.lit(0.0))
            .when(F.col("fired") == 0, F.lit(0.0))
            .otherwise(F.col("hits") / F.col("fired")))
    return e.select("threshold", "label", "fired", prec.alias("precision"))


# --------------------------------------------------------------------------
# A5 mutator profile
# --------------------------------------------------------------------------

def weighted_median(freq: DataFrame, group: str, value: str, count: str) -> DataFrame:
    """(group, median) of a (group, value, count) table, the mean of the
    two middle values for an even total.

    Values are range-partitioned and summed inside their partition;
    partition totals (one row per group and partition) shift the running
    counts, so no task holds a group."""
    n = int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = materialise(freq.select(group, F.col(value).alias("_v"), F.col(count).alias("_n"))
                    .repartitionByRange(n, group, "_v").withColumn("_p", F.spark_partition_id()))
    totals = d.groupBy(group, "_p").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(group, "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    size = totals.groupBy(group).agg(F.sum("_t").alias("_size"))
    upto = Window.partitionBy(group, "_p").orderBy("_v")
    run = d.withColumn("_hi", F.sum("_n").over(upto)).join(offset, [group, "_p"]).join(size, group) \
        .withColumn("_hi", F.col("_hi") + F.col("_o")).withColumn("_lo", F.col("_hi") - F.col("_n"))
    at = lambda pos: (F.col("_lo") <= pos) & (F.col("_hi") > pos)
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    mid = run.where(at(low) | at(high)).groupBy(group).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    return mid.select(group, (F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5).alias("median"))


def mutator_profile(deltas: DataFrame, n_rows: Column, buckets: int = C.PROFILE_BUCKETS):
    """A5: deltas (post_id, label, delta) with weight 1; per side (POS /
    NEG, non-zero deltas only) -> summary (side, n, min/max value, min/max
    frequency of a value, median, mean, overall mean per row) and a
    ``buckets``-bucket histogram of the value distribution."""
    nz = deltas.where(F.col("delta") != 0).select(
        F.when(F.col("label") == C.POS, "pos").otherwise("neg").alias("side"), F.col("delta").alias("v"))
    freq = nz.groupBy("side", "v").agg(F.count(F.lit(1)).alias("c"))
    fstats = freq.groupBy("side").agg(F.min("c").alias("min_freq"), F.max("c").alias("max_freq"))
    total = nz.agg(F.sum("v")).scalar()
    summary = nz.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.avg("v").alias("mean")) \
        .join(weighted_median(freq, "side", "v", "c"), "side").join(fstats, "side").withColumn("overall_mean", total / n_rows)
    hist = linear_histogram(freq, "v", buckets, weight_col="c", group_cols=("side",))
    return summary, hist
