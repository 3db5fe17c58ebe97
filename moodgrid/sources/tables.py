"""Loaders for the driver's parquet tables.

``spark.read.parquet`` is lazy: Catalyst prunes the columns a query
actually uses and pushes filters into the scan, so loaders never select
columns themselves.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


# Row key of each keyed table; posts, features and scores are all keyed
# by it, so a table hash-partitioned on its key feeds later joins and
# per-post aggregations without another exchange.
KEYS = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id",
        "conversations": "conv_id", "embeddings": "vec_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str, by_key: bool = False) -> DataFrame:
    """Scan one table.

    ``by_key`` hash-partitions it on its key, at every size: for inputs of
    per-key aggregations and key joins, the rows then move once, before
    anything is exploded, and all later steps on the key reuse that
    partitioning.  (A table bucketed on the key would need no exchange.)
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if by_key:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), KEYS[name])
    return df
