"""Lexicon features F8–F10.

For one lexicon and one post, three blocks of four numbers are computed:
unigram hits, word-bigram hits and *pair* hits, where a pair is any
ordered combination of two grams of the post at different positions
(uni×uni, bi×bi, uni×bi, bi×uni).  Per block: number of positive hits,
sum of scores, max score (floored at 0), last positive score in the
enumeration order (floored at 0).

Pairs are never enumerated (a 5,000-token post has 25 M of them) and no
candidate row per post is ever made.  A 64-bit code of its bytes stands
for a gram (:mod:`.termshards`).  A pair term hangs on its rarer side, so
that a frequent gram such as "the" brings few terms.  Posts are dealt once
to shards of bounded text; a shard lists each of its grams once and gets,
by a join on the code, the lexicon entries that hang on them.  Where the
posts of a shard and its entries meet, a task counts the grams of a post
once (count, last and second last position) and probes the pair terms of
each gram against them.

No task and no driver holds the lexicon: it is only ever joined by gram,
and posts are prepared once however large it is.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import materialise
from .termshards import ngram_codes, split_units, text_shards, whole_units

BLOCKS = ("uni", "bi", "pair")
STATS = ("n_pos", "sum", "max", "last")
# enumeration order of the pair blocks in the original pair list
PAIR_BLOCK_ORDER = {("u", "u"): 0, ("b", "b"): 1, ("u", "b"): 2, ("b", "u"): 3}
SEPARATOR = "---"
# Enumeration key of a hit as one long: block (below 4), then first
# position, then second position.  30 bits hold any position: a string has
# less than 2**31 bytes and a token takes two of them.
_POS_BITS = 30
SHARD_BYTES = 32 << 20        # text of one shard of posts, at most
LEAST_SHARD_BYTES = 2 << 20   # of shards that only serve to use all cores
_ROWS = 256                   # posts of one step of a task
SINGLE, ON_LEFT, ON_RIGHT = range(3)  # what hangs on a gram


def feature_names(lexicon: str) -> list[str]:
    return [f"{lexicon}_{b}_{s}" for b in BLOCKS for s in STATS]


def pair_splits(term) -> Column:
    """Every (left, right) that a pair term can stand for: it is cut at
    each place where the separator occurs, as a gram may hold it too."""
    t = F.col(term) if isinstance(term, str) else term
    n = F.length(t) - len(SEPARATOR) + 1
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(t, i, F.lit(len(SEPARATOR))) == SEPARATOR)
    return F.transform(at, lambda i: F.struct(F.substring(t, F.lit(1), i - 1).alias("left"),
                                              F.substring(t, i + len(SEPARATOR), n).alias("right")))


class _Postings(NamedTuple):
    """Entries that hang on a gram, as one stretch per gram number."""
    start: np.ndarray
    other: np.ndarray    # the gram on the other side of a pair
    block: np.ndarray
    lexicon: np.ndarray
    score: np.ndarray

    @classmethod
    def of(cls, grams: int, gram, other, block, lexicon, score) -> "_Postings":
        by = np.argsort(gram, kind="stable")
        return cls(np.searchsorted(gram[by], np.arange(grams + 1)), other[by].astype(np.int32), block[by].astype(np.int8),
                   lexicon[by].astype(np.int16), score[by])

    def of_grams(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, index into ``grams``) of all entries of the grams."""
        n = self.start[grams + 1] - self.start[grams]
        return np.repeat(self.start[grams] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(grams)), n)


def _gram_codes(texts: pa.Array) -> np.ndarray:
    """Code of every string as one gram."""
    codes = [ngram_codes(t, whole_units, 1, 1)[0] for t in text_shards(texts)]
    return np.concatenate([np.zeros(0, np.uint64), *codes]).view(np.int64)


def _post_codes(texts: pa.Array):
    """(post, code, position) of all tokens and word bigrams of texts; null
    texts have none."""
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    parts = [(np.zeros(0, np.int64),) * 3]
    for t in text_shards(texts):
        code, a, _, row = ngram_codes(t, split_units, 1, 2)
        tokens = len(split_units(t)[0])
        post = row[:tokens]
        at = np.arange(tokens) - np.searchsorted(post, post)
        at = np.concatenate([at, at[:-1][post[1:] == post[:-1]]])
        keep = known[row + t.first]
        parts.append((row[keep] + t.first, code[keep].view(np.int64), at[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts))


class LexiconArrays:
    """Lexicon entries (gram, other, side, block, lexicon, score) as arrays
    over the numbers of their grams."""

    def __init__(self, entries: pa.Table, names: list[str]):
        gram, other, side, block, which, score = (
            entries[c].to_numpy() for c in ("gram", "other", "side", "block", "lexicon", "score"))
        single = side == SINGLE
        self.names = names
        self.grams = pd.Index(np.unique(np.concatenate([gram, other[~single]])))
        n = len(self.grams)
        number = self.grams.get_indexer(gram)
        opposite = np.where(single, 0, self.grams.get_indexer(other))
        self.single, self.by_left, self.by_right = (
            _Postings.of(n, number[m], opposite[m], block[m], which[m], score[m])
            for m in (side == s for s in (SINGLE, ON_LEFT, ON_RIGHT)))

    def post_grams(self, texts: pa.Array):
        """(post, gram, count, last, second last position) of the grams that
        the lexicon knows, by post and gram."""
        post, code, at = _post_codes(texts)
        gram = self.grams.get_indexer(code)
        keep = gram >= 0
        gram, post, at = gram[keep], post[keep], at[keep]
        by = np.lexsort((at, gram, post))
        gram, post, at = gram[by], post[by], at[by]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (post[1:] != post[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate([head, [len(gram)]]))
        end = head + count - 1
        return post[head], gram[head], count, at[end], at[np.maximum(end - 1, 0)]

    def features(self, texts: pa.Array) -> np.ndarray:
        """stats[post, lexicon, block, (n_pos, sum, max, last)]."""
        out = np.zeros((len(texts), len(self.names), len(BLOCKS), len(STATS)))
        keys = np.full(out.shape[:3], -1, np.int64)
        post, gram, count, last, second = self.post_grams(texts)
        slot = np.full(len(self.grams) + 1, -1, np.int64)
        cut = np.searchsorted(post, np.arange(len(texts) + 1))
        for p in range(len(texts)):
            s = slice(cut[p], cut[p + 1])
            if s.start == s.stop:
                continue
            g, n, end, before = gram[s], count[s], last[s], second[s]
            e, a = self.single.of_grams(g)
            self._add(out[p], keys[p], self.single.block[e], self.single.lexicon[e], self.single.score[e], n[a], end[a])
            slot[g] = np.arange(len(g))
            for table, left_first in ((self.by_left, True), (self.by_right, False)):
                e, a = table.of_grams(g)
                b = slot[table.other[e]]
                met = b >= 0
                e, a, b = e[met], a[met], b[met]
                l, r = (a, b) if left_first else (b, a)
                same = l == r
                hits = n[l] * np.where(same, n[l] - 1, n[r])
                key = (table.block[e].astype(np.int64) << 2 * _POS_BITS) + (end[l] << _POS_BITS) + np.where(same, before[l], end[r])
                ok = hits > 0
                self._add(out[p], keys[p], np.full(ok.sum(), 2), table.lexicon[e][ok], table.score[e][ok], hits[ok], key[ok])
            slot[g] = -1
        return out

    def _add(self, stats: np.ndarray, keys: np.ndarray, block, lexicon, score, hits, key) -> None:
        for x in range(len(self.names)):
            for b in range(len(BLOCKS)):
                mine = (lexicon == x) & (block == b)
                if not mine.any():
                    continue
                to, sc, n = stats[x, b], score[mine], hits[mine]
                to[1] += (sc * n).sum()
                to[2] = max(to[2], sc.max())
                good = sc > 0
                if good.any():
                    to[0] += n[good].sum()
                    best = key[mine][good].argmax()
                    if key[mine][good][best] > keys[x, b]:
                        to[3], keys[x, b] = sc[good][best], key[mine][good][best]


def lexicon_entries(lexicon: DataFrame, names: list[str]) -> DataFrame:
    """(gram, other, side, block, lexicon, score): single terms on their own
    gram, every reading of a pair term on its rarer side."""
    has_counts = "n_pos" in lexicon.columns and "n_neg" in lexicon.columns
    freq = (F.col("n_pos") + F.col("n_neg")) if has_counts else F.lit(0)
    place = F.coalesce(*[F.when(F.col("lexicon") == n, F.lit(i)) for i, n in enumerate(names)]).cast("tinyint")
    lex = lexicon.where(F.col("lexicon").isin(*names) & F.col("term").isNotNull()).select(
        place.alias("lexicon"), "kind", "term", F.col("score").cast("double").alias("score"),
        F.coalesce(freq.cast("long"), F.lit(0)).alias("freq"))
    # a gram of two words holds a space, a single one never does
    two = F.col("term").contains(" ")
    of_kind = lambda c: F.when(F.col(c).contains(" "), "b").otherwise("u")
    block = None
    for (a, b), o in PAIR_BLOCK_ORDER.items():
        cond = (of_kind("left") == a) & (of_kind("right") == b)
        block = F.when(cond, o) if block is None else block.when(cond, o)
    single = F.struct(F.col("term").alias("left"), F.lit("").alias("right"))
    readings = F.when(F.col("kind") == "pair", pair_splits("term")).when(two == (F.col("kind") != "uni"), F.array(single))
    rows = lex.select("lexicon", "score", "freq", (F.col("kind") == "pair").alias("is_pair"), two.alias("two"), F.explode(readings).alias("p")) \
        .select("lexicon", "score", "freq", "is_pair", "p.left", "p.right",
                F.when(F.col("is_pair"), block).otherwise(F.col("two").cast("int")).cast("tinyint").alias("block"))

    def code(batches):
        for b in batches:
            yield pa.record_batch({**{c: b.column(c) for c in ("lexicon", "score", "freq", "is_pair", "block")},
                                   "left": pa.array(_gram_codes(b.column("left"))), "right": pa.array(_gram_codes(b.column("right")))})

    coded = materialise(rows.mapInArrow(
        code, "lexicon tinyint, score double, freq bigint, is_pair boolean, block tinyint, left bigint, right bigint"))
    alone = coded.where(~F.col("is_pair"))
    common = alone.groupBy(F.col("left").alias("gram")).agg(F.max("freq").alias("freq"))
    pairs = coded.where("is_pair").drop("freq")
    for side in ("left", "right"):
        pairs = pairs.join(common.select(F.col("gram").alias(side), F.col("freq").alias(f"{side}_freq")), side, "left")
    on_left = F.coalesce("left_freq", F.lit(0)) <= F.coalesce("right_freq", F.lit(0))
    pairs = pairs.select(F.when(on_left, F.col("left")).otherwise(F.col("right")).alias("gram"),
                         F.when(on_left, F.col("right")).otherwise(F.col("left")).alias("other"),
                         F.when(on_left, ON_LEFT).otherwise(ON_RIGHT).cast("tinyint").alias("side"), "block", "lexicon", "score")
    return alone.select(F.col("left").alias("gram"), F.lit(0).cast("long").alias("other"), F.lit(SINGLE).cast("tinyint").alias("side"),
                        "block", "lexicon", "score").unionByName(pairs)


def post_shards(posts: DataFrame) -> DataFrame:
    """``posts`` (post_id, text) once more, each with the number of its shard."""
    p = materialise(posts)
    size = p.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, math.ceil(size / SHARD_BYTES), min(cores, math.ceil(size / LEAST_SHARD_BYTES)))
    return p.select(F.pmod(F.xxhash64("post_id", "text"), F.lit(n)).cast("int").alias("shard"), "post_id", "text")


def lexicon_features(posts: DataFrame, lexicon: DataFrame, names,
                     text_col: str = "text") -> DataFrame:
    """(post_id, 12 features per lexicon) for one lexicon name or
    several (one shared pass); posts without any hit get zeros."""
    names = [names] if isinstance(names, str) else list(names)
    fields = [(f"{n}_{b}_{s}", "bigint" if s == "n_pos" else "double") for n in names for b in BLOCKS for s in STATS]
    kind = dict(posts.dtypes)["post_id"]
    shards = post_shards(posts.select("post_id", F.col(text_col).alias("text") if isinstance(text_col, str) else text_col.alias("text")))

    def grams(shard: pa.Table) -> pa.Table:
        texts = shard["text"].combine_chunks()
        found = [np.unique(_post_codes(texts.slice(i, _ROWS))[1]) for i in range(0, len(texts), _ROWS)]
        codes = np.unique(np.concatenate(found))
        return pa.table({"shard": pa.array(np.full(len(codes), shard["shard"][0].as_py()), pa.int32()), "gram": pa.array(codes)})

    held = shards.groupBy("shard").applyInArrow(grams, "shard int, gram bigint")
    entries = held.join(lexicon_entries(lexicon, names), "gram")

    def task(shard: pa.Table, entries: pa.Table) -> pa.Table:
        arrays = LexiconArrays(entries, names)
        texts = shard["text"].combine_chunks()
        stats = np.concatenate([np.zeros((0, len(names), len(BLOCKS), len(STATS))),
                                *[arrays.features(texts.slice(i, _ROWS)) for i in range(0, len(texts), _ROWS)]])
        stats = stats.reshape(len(texts), -1)
        return pa.table([shard["post_id"].combine_chunks(), *[pa.array(stats[:, i].astype(np.int64) if t == "bigint" else stats[:, i])
                                                              for i, (_, t) in enumerate(fields)]],
                        names=["post_id", *[n for n, _ in fields]])

    schema = f"post_id {kind}, " + ", ".join(f"`{n}` {t}" for n, t in fields)
    # few bytes of entries can be much work: as many tasks as shuffles have
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(parts, "shard").groupBy("shard").cogroup(entries.repartition(parts, "shard").groupBy("shard")) \
        .applyInArrow(task, schema)
