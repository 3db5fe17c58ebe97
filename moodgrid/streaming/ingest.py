"""The stateless per-row operators on a streaming source.

The original pipeline has no streaming operator.  Its ingest chain (T1–T3)
and the surface counters (F1–F7) are pure per-row column expressions, so
they run unchanged on a Structured Streaming DataFrame; lexicon, TF-IDF
and mutator operators need per-post aggregation over exploded tokens and
are applied per micro-batch through ``foreachBatch`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import surface as S

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Documents arriving as parquet files in ``path``."""
    return (spark.readStream.schema(DOC_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def stream_surface_features(docs: DataFrame) -> DataFrame:
    """(post_id, normalised text, F1–F6 counters) on a streaming source."""
    p = docs.select(F.col("doc_id").alias("post_id"), T.normalise(T.one_line(F.col("text"))).alias("text"))
    return p.select("post_id", "text", *S.length_features("text"), S.all_caps_count("text"),
                    S.hashtag_count("text"), S.elongated_count("text"), *S.emoticon_features("text"),
                    *S.punctuation_features("text"))


def per_batch(fn: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """``foreachBatch`` adapter: apply a batch operator (e.g. a lexicon or
    word-list scorer) to each micro-batch and hand the result to ``sink``."""
    def run(batch: DataFrame, epoch: int) -> None:
        sink(fn(batch), epoch)
    return run
