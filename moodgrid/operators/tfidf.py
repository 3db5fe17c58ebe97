"""Word and character n-gram TF-IDF (F11, F12) and the weighted feature
union (F13), in long form ``(post_id, term, weight)``.

Vectoriser semantics: lower-case; words are runs of two or more word
characters; character n-grams run over the text with whitespace runs
collapsed to one space; ``idf = ln((1 + n) / (1 + df)) + 1``; terms in
more than ``max_df * n`` posts are dropped; rows are L2-normalised.

Plan, the same at every size: texts are prepared by native functions and
dealt to shards, which list the codes of their terms once
(:mod:`.termshards`); document frequencies come from these lists alone;
weights and norms are computed per shard, from its texts.  What is shuffled is
the texts and a row per (shard, bucket) of codes, never a row per (post, term).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .termshards import SHARD_BYTES, Grams, Texts, char_units, strings, term_shards, with_frequencies, word_units

WORD_RE = r"[\p{L}\p{N}_]{2,}"
WS_RUN_RE = r"\s\s+"


def word_text(text) -> Column:
    """The words of a text, lower-cased, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(T.col_(text)), F.lit(WORD_RE), 0), " ")


def char_text(text) -> Column:
    """A text lower-cased, whitespace runs as one space."""
    return F.regexp_replace(F.lower(T.col_(text)), WS_RUN_RE, " ")


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``F.round`` of numbers from 0 to 1: halves of their decimal form go
    up.  Only numbers next to a half are looked at digit by digit."""
    scaled = x * 10.0 ** digits
    out = np.floor(scaled + 0.5) / 10.0 ** digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def tfidf(posts: DataFrame, prepared: Column, units: Callable, ngram_range: tuple[int, int],
          max_df: float = C.TFIDF_MAX_DF, shard_bytes: int = SHARD_BYTES, digits: int | None = None) -> DataFrame:
    """(post_id, term, weight) — L2-normalised tf·idf of the n-grams of the
    prepared texts' units, rounded to ``digits`` where given."""
    shards, n, size = term_shards(posts.select("post_id", prepared.alias("text")), shard_bytes)

    def weigh(post_id: pa.Array, t: Texts, g: Grams, df: np.ndarray) -> pa.RecordBatch:
        kept = (df <= max_df * n)[g.term]
        post, term = g.text[kept], g.term[kept]
        w = g.count[kept] * (np.log((1.0 + n) / (1.0 + df)) + 1.0)[term]
        norm = np.sqrt(np.bincount(post, weights=w * w, minlength=t.n))
        w = w / norm[post]
        if digits is not None:
            w = rounded(w, digits)
        return pa.record_batch({"post_id": post_id.take(pa.array(post)), "term": strings(t, g.start, g.end).take(pa.array(term)),
                                "weight": pa.array(w)})

    kind = dict(posts.dtypes)["post_id"]
    return with_frequencies(shards, size, units, *ngram_range, weigh, f"post_id {kind}, term string, weight double")


def word_tfidf(posts: DataFrame, text_col: str = "text", ngram_range=C.WORD_NGRAM_RANGE, digits: int | None = None) -> DataFrame:
    """F11."""
    return tfidf(posts, word_text(text_col), word_units, ngram_range, digits=digits)


def char_tfidf(posts: DataFrame, text_col: str = "text", ngram_range=C.CHAR_NGRAM_RANGE, digits: int | None = None) -> DataFrame:
    """F12."""
    return tfidf(posts, char_text(text_col), char_units, ngram_range, digits=digits)


def dense_block(df: DataFrame, block: str, weight: float) -> DataFrame:
    """Wide counter block (post_id, c1, c2 …) -> long (post_id, feature,
    value·weight) with ``feature = block:column``."""
    cols = [c for c in df.columns if c != "post_id"]
    arr = F.array(*[F.struct(F.lit(f"{block}:{c}").alias("feature"),
                             (F.col(c).cast("double") * F.lit(weight)).alias("value")) for c in cols])
    return df.select("post_id", F.explode(arr).alias("f")).select("post_id", "f.feature", "f.value")


def sparse_block(df: DataFrame, block: str, weight: float) -> DataFrame:
    """(post_id, term, weight) -> (post_id, feature, value·weight)."""
    return df.select("post_id", F.concat(F.lit(block + ":"), "term").alias("feature"),
                     (F.col("weight") * F.lit(weight)).alias("value"))
