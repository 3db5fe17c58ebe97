"""Surface feature extractors F1–F7 (one post in, fixed columns out).

All counters are higher-order array expressions over the token array of
the same row: no explode, no join, no shuffle; they run unchanged on a
streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def length_features(text) -> list[Column]:
    """token count, mean token length, max token length."""
    t = T.tokens(text)
    lens = F.transform(t, lambda w: F.length(w))
    n = F.size(t)
    return [n.cast("long").alias("n_tokens"),
            (F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x) / n).alias("mean_len"),
            F.array_max(lens).cast("long").alias("max_len")]


def all_caps_count(text) -> Column:
    """tokens written in capitals, ``I`` excluded."""
    return T.count_where(T.tokens(text), T.is_all_caps).cast("long").alias("n_all_caps")


def hashtag_count(text) -> Column:
    """tokens starting with ``#``."""
    return T.count_where(T.tokens(text), lambda w: w.startswith("#")).cast("long").alias("n_hashtags")


def elongated_count(text) -> Column:
    """tokens holding a character repeated three or more times."""
    return T.count_where(T.tokens(text), lambda w: w.rlike(C.ELONGATED_RE)).cast("long").alias("n_elongated")


def emoticon_features(text) -> list[Column]:
    """tokens holding an emoticon; 1 if the last token holds one."""
    t = T.tokens(text)
    return [T.count_where(t, lambda w: w.rlike(C.EMOTICON_RE)).cast("long").alias("n_emoticons"),
            F.element_at(t, -1).rlike(C.EMOTICON_RE).cast("int").alias("last_emoticon")]


def punctuation_features(text) -> list[Column]:
    """tokens with ``??+``, ``!!+``, mixed ``[!?]{2,}``; 1 if the last
    token holds ``!`` or ``?``."""
    t = T.tokens(text)
    last = F.element_at(t, -1)
    return [T.count_where(t, lambda w: w.rlike(C.QUESTION_RUN_RE)).cast("long").alias("n_question_runs"),
            T.count_where(t, lambda w: w.rlike(C.EXCLAIM_RUN_RE)).cast("long").alias("n_exclaim_runs"),
            T.count_where(t, lambda w: w.rlike(C.MIXED_RUN_RE)).cast("long").alias("n_mixed_runs"),
            (last.contains("!") | last.contains("?")).cast("int").alias("last_mark")]


def pos_column_name(i: int) -> str:
    return f"pos_{i:02d}"


def _equals(value: str):
    return lambda c: c == F.lit(value)


def pos_counts(tags) -> list[Column]:
    """count of each of the 25 tags (fixed order), tag = character at
    an even offset of the tag string; unknown tags are counted apart.

    The even-offset characters are pulled out with one regex pass, then
    each tag is counted by a literal replace — plain string functions in
    generated code, no per-element lambda."""
    even = F.regexp_replace(T.col_(tags), "(.).?", "$1")
    n = F.length(even)
    cols = [(n - F.length(F.replace(even, F.lit(tag), F.lit("")))).cast("long").alias(pos_column_name(i))
            for i, tag in enumerate(C.POS_TAGS)]
    known = None
    for c in cols:
        known = c if known is None else known + c
    cols.append((n - known).cast("long").alias("pos_unknown"))
    return cols


def surface_features(posts: DataFrame, text_col: str = "text", tags_col: str = "tags") -> DataFrame:
    """F1–F7 side by side: (post_id, 38 counter columns)."""
    return posts.select(
        "post_id", *length_features(text_col), all_caps_count(text_col), hashtag_count(text_col),
        elongated_count(text_col), *emoticon_features(text_col), *punctuation_features(text_col),
        *pos_counts(tags_col))
