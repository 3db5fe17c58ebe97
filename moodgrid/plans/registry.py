"""Query registry: one entry per operator, each with its SQL twin.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle is a DuckDB
SQL string over the same parquet tables (or ``None`` when the operator
is not SQL-expressible, e.g. model training).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator registering a query under ``name`` with optional SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that their decorators run."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


MODULES = ["text_queries", "feature_queries", "lexicon_queries", "tfidf_queries", "metric_queries", "mutator_queries", "taxonomy_queries", "selection_queries", "etl_queries", "distance_queries", "learn_queries"]
