"""Quality rules: a threshold table compiled into one projection.

``measures`` computes the length, symbol, stop-word and line measures of
every text in its row (no shuffle, no user function); ``compile_rules``
turns a threshold table into one Boolean column; ``apply_rules`` puts
both into a projection that keeps every input row and column.

Defined cases: a null text counts as empty; an empty text has zero for
every measure and fails ``min_words``; ratios of an empty text are 0;
repeated rows are judged alike, row by row; an empty table gives an empty
result; stop words are asked for only in texts of 50 words and more whose
``lang`` has some in the list (a null ``lang``, or none: not asked), and
duplicate lines have to be three at least; measures live in one struct
column (``MEASURES``), so input columns with clashing names keep their
values.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SPACE_CHARS, array_sum, bind, text_or_empty, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
MEASURES = "__quality_measures"

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "with", "for", "on",
    "de", "la", "le", "les", "et", "des", "en", "un", "que", "el", "los", "y",
    "der", "die", "das", "und", "den", "von", "zu", "ist", "nicht", "ein",
)


class Rule(NamedTuple):
    """``measure`` must lie in [low, high]; an open end is None.  A text is
    judged only if the measure ``when[0]`` is at least ``when[1]`` and its
    language is one of ``langs``, where these are given."""
    name: str
    measure: str
    low: float | None
    high: float | None
    when: tuple[str, float] | None = None
    langs: tuple[str, ...] | None = None


#: Base limits of the query contract, then those of the method.
BASE_RULES = (
    Rule("min_words", "n_words", 10, None),
    Rule("repeated_windows", "repeat_ratio", None, 0.20),
)
STOP_LANGS = ("en", "fr", "es", "de")  # languages of STOP_WORDS
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.25),
    Rule("stop_words", "n_stop_words", 2, None, ("n_words", 50), STOP_LANGS),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.30, ("n_dup_lines", 3)),
)


def _covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Windows are sorted by (hash, position); a window is repeated when a
    sorted neighbour has its hash.  Repeated positions in order cover
    min(window, distance to the next) words each.
    """
    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                       | F.coalesce(F.when(k > 0, F.get(s, k - 1)["h"]) == x["h"], F.lit(False)))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def cover(p: Column) -> Column:
        return array_sum(F.transform(p, lambda x, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long")))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(bind(pairs, repeated), cover)


def _window_hashes(w: Column) -> Column:
    n = F.size(w)
    start = F.sequence(F.lit(0), n - WINDOW)
    return F.when(n >= WINDOW, F.transform(start, lambda i: F.xxhash64(
        *[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def measures(text: Column) -> Column:
    """Struct of all measures of one text (64-bit window hashes)."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def finish(s: Column) -> Column:
        return F.struct(
            s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"),
            s["n_repeat_words"].alias("n_repeat_words"), s["n_lines"].alias("n_lines"),
            s["n_stop_words"].alias("n_stop_words"),
            ratio(s["word_chars"], s["n_words"]).alias("mean_word_chars"),
            ratio(s["n_symbols"], s["n_words"]).alias("symbol_ratio"),
            ratio(s["n_dup_lines"], s["n_lines"]).alias("dup_line_ratio"),
            ratio(s["n_repeat_words"], s["n_words"]).alias("repeat_ratio"))

    def line_part(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))

    def repeat_part(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _covered_words(h)) \
            .otherwise(F.lit(0).cast("long"))

    def word_part(w: Column) -> Column:
        stop = F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))
        return bind(bind(lines, line_part), lambda ln: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            ln["dup"].alias("n_dup_lines"), ln["n"].alias("n_lines"),
            F.size(stop).cast("long").alias("n_stop_words"),
            bind(_window_hashes(w), repeat_part).alias("n_repeat_words")))

    return bind(bind(words(text), word_part), finish)


def compile_rules(rules, m: Column, lang: Column | None = None) -> Column:
    """One Boolean column: every rule of the table holds.  A text whose
    language is null or not given passes the rules for certain languages."""
    base = F.substring_index(F.translate(F.lower(lang), "_", "-"), "-", 1) if lang is not None else F.lit(None)
    ok = F.lit(True)
    for r in rules:
        holds = F.lit(True)
        if r.low is not None:
            holds = holds & (m[r.measure] >= F.lit(r.low))
        if r.high is not None:
            holds = holds & (m[r.measure] <= F.lit(r.high))
        if r.when is not None:
            holds = holds | (m[r.when[0]] < F.lit(r.when[1]))
        if r.langs is not None:
            holds = holds | ~F.coalesce(base.isin(*r.langs), F.lit(False))
        ok = ok & holds
    return ok


def base_failed(m: Column) -> Column:
    """The contract's base verdict, in whole numbers."""
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES, lang: str = "lang") -> DataFrame:
    """Every input row with ``MEASURES`` (struct) and ``__kept`` (boolean)."""
    df = docs.withColumn(MEASURES, measures(F.col(text)))
    m = F.col(MEASURES)
    spoken = F.col(lang) if lang in docs.columns else None
    return df.withColumn("__kept", ~base_failed(m) & compile_rules(rules, m, spoken))


def keep_clean(docs: DataFrame, text: str = "text", rules=RULES, lang: str = "lang") -> DataFrame:
    """Rows that pass all rules, with the input's own columns."""
    return apply_rules(docs, text, rules, lang).where("__kept").select(*docs.columns)


def quality_report(docs: DataFrame) -> DataFrame:
    """Contract columns of query ``op2``."""
    df = apply_rules(docs.select("doc_id", "text", *[c for c in docs.columns if c == "lang"]))
    m = F.col(MEASURES)
    return df.select("doc_id", *[m[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")],
        base_failed(m).alias("base_failed"), F.col("__kept").alias("kept"))
