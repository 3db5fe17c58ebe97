"""Corpus pipeline over ``documents``: a chain of this library's text operators.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows
its predecessor kept; every stage but the last returns the columns of
``documents``.  ``run`` writes each stage's result as Parquet into a fresh
folder of the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from moodgrid.llm.decontaminate import without_leaks
from moodgrid.llm.jaccard import one_of_each
from moodgrid.llm.packing import pack
from moodgrid.llm.pii import without_personal_data
from moodgrid.llm.quality import keep_clean
from moodgrid.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.8 on
    five-word shingles, the one with the smallest id."""
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return without_personal_data(docs)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("length_buckets", length_buckets),
]

#: Components of similarity links and keyed replacements have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
