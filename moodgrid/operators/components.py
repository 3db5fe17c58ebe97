"""Connected components of an edge table, to a fixed point.

Alternating large-star and small-star rounds: every vertex points its
larger neighbours, then its smaller ones, at the smallest vertex around
it.  Each round is one aggregation and one join per star; the edge table
never grows beyond its first size, hub vertices are only aggregated
partially and joined (so adaptive execution can split them), and the
number of rounds is logarithmic in the longest chain.  Rounds end when
the edge table no longer changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                  F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["x"], r["s"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, comp) of every vertex that has an edge to another vertex;
    ``comp`` is the smallest id of its component."""
    a, b = F.col(src), F.col(dst)
    e = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _fingerprint(e)
    while before[0] > 0:
        e = materialise(_small_star(_large_star(e)))
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots)
