"""Column helpers shared by the DataFrame-only operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A lambda that mentions an outer *expression* evaluates it for every
    element; a lambda variable is computed once per row.
    """
    return F.transform(F.array(value), body)[0]


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(col: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` (null text: none)."""
    def cut(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES))
    return bind(F.btrim(text_or_empty(col), F.lit(SPACE_CHARS)), cut)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + x)
