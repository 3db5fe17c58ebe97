"""Ingest operators: field splitting, label mapping and the labelled scan
(S1, S2, P1, P3–P6, P8, P9, A17).

Lines are ``label \\t text \\t tags`` (labelled) or ``text \\t tags``
(unlabelled).  Everything is a per-row column expression; rows that do
not fit are not dropped silently but routed to a report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T


def strip(c: Column) -> Column:
    """Python's ``str.strip()``: leading / trailing whitespace."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def label_flag(name: Column) -> Column:
    """Label name -> bit flag; unknown names -> NULL."""
    out = None
    for k, v in C.LABEL_NAMES.items():
        out = F.when(name == k, F.lit(v)) if out is None else out.when(name == k, F.lit(v))
    return out


def class_mask(letters: str) -> int:
    """Class letters (``p n e o r``) -> OR of their flags."""
    flags = [C.CLASS_LETTERS[c] for c in letters if c in C.CLASS_LETTERS]
    return reduce(lambda a, b: a | b, flags, 0)


def fields(line: Column) -> Column:
    return F.split(strip(line), "\t")


def split_fields(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(post_id, n_fields, label_name, text, tags); text/tags NULL when
    the row has neither two nor three fields."""
    f = fields(F.col(line_col))
    n = F.size(f)
    return lines.select(
        "post_id", n.alias("n_fields"),
        F.when(n == 3, F.get(f, 0)).alias("label_name"),
        F.when(n == 2, F.get(f, 0)).when(n == 3, F.get(f, 1)).alias("text"),
        F.when(n == 2, F.get(f, 1)).when(n == 3, F.get(f, 2)).alias("tags"))


def mask_filter(posts: DataFrame, mask: int) -> DataFrame:
    """P4 + P5: label flag in the mask and text not the placeholder."""
    return posts.where(F.col("label").isNotNull()
                       & (F.col("label").bitwiseAND(F.lit(mask)) != 0)
                       & (F.col("text") != F.lit(C.NOT_AVAILABLE)))


def labelled_scan(lines: DataFrame, mask: int, line_col: str = "line") -> DataFrame:
    """Three-field rows with a known label in ``mask``, placeholder
    text removed, text normalised (T1–T3).  -> (post_id, label, text, tags)"""
    s = split_fields(lines, line_col).where(F.col("n_fields") == 3)
    s = s.select("post_id", label_flag(F.col("label_name")).alias("label"), "text", "tags")
    s = mask_filter(s, mask)
    return s.select("post_id", "label", T.normalise(F.col("text")).alias("text"), "tags")


def scan_report(lines: DataFrame, mask: int, line_col: str = "line") -> DataFrame:
    """(reason, n_rows) — what the labelled scan keeps or rejects."""
    f = fields(F.col(line_col))
    n = F.size(f)
    flag = label_flag(F.get(f, 0))
    reason = (F.when(~n.isin(2, 3), "bad_arity")
              .when(n == 2, "unlabelled")
              .when(flag.isNull(), "unknown_label")
              .when(F.get(f, 1) == C.NOT_AVAILABLE, "not_available")
              .when(flag.bitwiseAND(F.lit(mask)) == 0, "masked")
              .otherwise("ok"))
    return lines.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def rejoin(text: Column, tags: Column, drop_tags: Column | None = None) -> Column:
    """In-flight ``text \\t tags`` row (only ever built at a sink)."""
    joined = F.concat_ws("\t", text, tags)
    return joined if drop_tags is None else F.when(drop_tags, text).otherwise(joined)


def separate(rows: DataFrame, row_col: str = "row") -> DataFrame:
    """Split ``text \\t tags`` rows; rows without exactly two fields
    are rejected (see :func:`separate_rejects`)."""
    f = fields(F.col(row_col))
    return rows.where(F.size(f) == 2).select(
        "post_id", F.get(f, 0).alias("text"), F.get(f, 1).alias("tags"))


def separate_rejects(rows: DataFrame, row_col: str = "row") -> DataFrame:
    return rows.where(F.size(fields(F.col(row_col))) != 2)


def arity_filter(lines: DataFrame, k: int, line_col: str = "line", delim: str = "\t") -> DataFrame:
    """Rows with exactly ``k`` fields."""
    return lines.where(F.size(F.split(strip(F.col(line_col)), delim)) == k)


# --------------------------------------------------------------------------
# file scans
# --------------------------------------------------------------------------

def read_lines(spark, path: str) -> DataFrame:
    """Text file(s) -> (post_id, line); post_id is a stable line id
    (file, offset order) assigned without collecting anything."""
    df = spark.read.text(path).withColumnRenamed("value", "line")
    return df.withColumn("post_id", F.monotonically_increasing_id()).select("post_id", "line")


def read_labelled_tsv(spark, path: str, mask: int) -> DataFrame:
    """S1 over files: read TSV lines, then :func:`labelled_scan`."""
    return labelled_scan(read_lines(spark, path), mask)
