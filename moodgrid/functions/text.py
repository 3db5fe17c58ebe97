"""Text column expressions (T1–T11, F1–F7 building blocks).

All helpers return ``Column`` objects built from Spark's native
functions and higher-order array functions, so they run inside
whole-stage codegen on the executors: no Python per row, no shuffle.
Tokens are ``split(text, ' ')`` — empty tokens are kept, exactly as the
line-based original splits on a single space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# ingest clean-up
# --------------------------------------------------------------------------

def one_line(text) -> Column:
    """Posts are line-based: tabs / line breaks inside a text become one
    space, then the text is trimmed of spaces."""
    return F.trim(F.regexp_replace(col_(text), r"[\t\r\n]+", " "))


def tokens(text) -> Column:
    """T9 without lower-casing: ``split(text, ' ')`` keeping empties."""
    return F.split(col_(text), " ")


def lower_tokens(text) -> Column:
    """Lower-case, then split on a single space."""
    return F.split(F.lower(col_(text)), " ")


# --------------------------------------------------------------------------
# T1–T3 normalisers
# --------------------------------------------------------------------------

def _map_tokens(text, fn) -> Column:
    return F.array_join(F.transform(tokens(text), fn), " ")


def normalise_urls(text) -> Column:
    """A token starting with ``http`` becomes ``http://url``."""
    return _map_tokens(text, lambda w: F.when(w.startswith("http"), F.lit(C.URL_TOKEN)).otherwise(w))


def normalise_users(text) -> Column:
    """A token starting with ``@`` becomes ``@ref``."""
    return _map_tokens(text, lambda w: F.when(w.startswith("@"), F.lit(C.USER_TOKEN)).otherwise(w))


def cap_elongation(text) -> Column:
    """A run of three or more equal characters inside a token is cut
    to exactly three.  Tokens hold no space, so the whole-string form with
    a non-space class is identical to the per-token rewrite."""
    return F.regexp_replace(col_(text), C.ELONGATED_RE, "$1$1$1")


def normalise(text) -> Column:
    """The ingest chain: T1, then T2, then T3 (the placeholder text is left
    untouched)."""
    t = col_(text)
    # a token starts at the text's start or after a space; neither rule makes a token of the other's
    named = F.regexp_replace(F.regexp_replace(t, "(^| )http[^ ]*", "$1" + C.URL_TOKEN), "(^| )@[^ ]*", "$1" + C.USER_TOKEN)
    out = cap_elongation(named)
    return F.when(t == F.lit(C.NOT_AVAILABLE), t).otherwise(out)


# --------------------------------------------------------------------------
# T4 negation scope — in-row, O(tokens), no window and no shuffle
# --------------------------------------------------------------------------

def is_negator(w: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(x) for x in C.NEGATION_WORDS]), w) | \
        w.contains(C.NEGATION_INFIX)


def is_scope_end(w: Column) -> Column:
    return w.rlike(C.PUNCT_RE)


def negation_marks(text) -> Column:
    """Per token, ``'x'`` when the token lies inside a negation scope.

    Each token is coded ``N`` (cue), ``P`` (scope end) or ``.``; cutting the
    code string before every ``N``/``P`` gives segments that each start at
    the last event, so a segment that starts with ``N`` is negated up to
    its end.  The result is an array of one-character codes aligned with
    the tokens.
    """
    codes = F.array_join(F.transform(
        tokens(text),
        lambda w: F.when(is_negator(w), "N").when(is_scope_end(w), "P").otherwise(".")), "")
    segs = F.split(codes, "(?=[NP])")
    marked = F.array_join(F.transform(
        segs,
        lambda s: F.when(s.startswith("N"),
                         F.concat(F.lit("N"), F.repeat(F.lit("x"), F.length(s) - 1)))
        .otherwise(s)), "")
    return F.split(marked, "")


def negation_scope(text) -> Column:
    """T4: append ``_NEG`` to each token after a negation cue until a token
    that holds ``. , : ; ! ?``; cue and terminator tokens stay unchanged.
    ``zip_with`` walks tokens and marks side by side (each array is built
    once per row, never re-evaluated per element)."""
    return F.array_join(F.zip_with(
        tokens(text), negation_marks(text),
        lambda w, m: F.when(m == "x", F.concat(w, F.lit(C.NEGATION_SUFFIX))).otherwise(w)),
        " ")


# --------------------------------------------------------------------------
# T5 HTML entities, T7 tag map, T8 edit similarity, T10 n-grams, T11 range
# --------------------------------------------------------------------------

def decode_html(text) -> Column:
    """T5: replace the fixed entity list, ``&amp;`` last, in one pass."""
    out = col_(text)
    for ent, ch in C.HTML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def wordnet_pos(tag) -> Column:
    """A* -> adjective, V* -> verb, N/S/Z/L/M -> noun, R* -> adverb,
    anything else -> ''."""
    t = col_(tag)
    return (F.when(t.startswith("A"), C.WN_ADJ)
            .when(t.startswith("V"), C.WN_VERB)
            .when(t.isin(*C.WN_NOUN_TAGS), C.WN_NOUN)
            .when(t.startswith("R"), C.WN_ADV)
            .otherwise(""))


def edit_similarity(a, b) -> Column:
    """``1 - levenshtein / length of the longer string`` on lower-cased
    strings; 1.0 for two empty strings, 0.0 when exactly one is empty."""
    a, b = col_(a), col_(b)
    la, lb = F.length(a), F.length(b)
    longer = F.greatest(la, lb)
    return (F.when((la == 0) & (lb == 0), F.lit(1.0))
            .when((la == 0) | (lb == 0), F.lit(0.0))
            .otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longer))


def shifted_zip(arr, n: int) -> Column:
    """Array of structs (x0 .. x{n-1}) holding n consecutive elements of
    ``arr`` — built from n slices, so ``arr`` is evaluated n times per row
    (never once per element)."""
    a = col_(arr)
    cnt = F.greatest(F.size(a) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(a, k + 1, cnt).alias(f"x{k}") for k in range(n)])


def word_ngrams(toks, n: int) -> Column:
    """Contiguous word n-grams joined by a space (position = first token)."""
    if n == 1:
        return col_(toks)
    return F.transform(shifted_zip(toks, n),
                       lambda s: F.concat_ws(" ", *[s[f"x{k}"] for k in range(n)]))


def word_bigrams(toks) -> Column:
    """Adjacent tokens joined by a space; position = first token."""
    return word_ngrams(toks, 2)


def char_ngrams(chars, n: int) -> Column:
    """Character n-grams from an array of characters (``split(s, '')``)."""
    if n == 1:
        return col_(chars)
    return F.transform(shifted_zip(chars, n),
                       lambda s: F.concat(*[s[f"x{k}"] for k in range(n)]))


def index_range(count) -> Column:
    """0-based indices ``0 .. count-1``; empty when ``count <= 0``."""
    c = col_(count) if not isinstance(count, int) else F.lit(count)
    return F.slice(F.sequence(F.lit(0), F.greatest(c - 1, F.lit(0))), 1, F.greatest(c, F.lit(0)))


def stepped_range(start: float, stop: float, step: float) -> Column:
    """Inclusive float range as an index grid ``start + i*step``,
    rounded to 10 digits so accumulation error cannot drop the stop."""
    n = int(round((stop - start) / step))
    return F.transform(F.sequence(F.lit(0), F.lit(n)),
                       lambda i: F.round(F.lit(start) + i * F.lit(step), 10))


# --------------------------------------------------------------------------
# F1–F7 surface counters (each a column over the token array)
# --------------------------------------------------------------------------

def count_where(arr, pred) -> Column:
    return F.size(F.filter(col_(arr), pred))


def is_all_caps(w: Column) -> Column:
    return (w != "I") & (w == F.upper(w)) & (F.upper(w) != F.lower(w))


def tag_chars(tags) -> Column:
    """POS tags are the characters at even offsets of the tag string."""
    return F.filter(F.split(col_(tags), ""), lambda c, i: i % 2 == 0)
