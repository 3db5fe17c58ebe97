"""N-grams of texts as codes, and shards of posts with their own term lists.

A *unit* of a text is a word of a space-joined string or a single
character; an n-gram is the stretch of bytes from one unit's start to
another one's end.  A 64-bit code of the bytes stands for an n-gram while
it is counted; its text is taken from its first occurrence.

Document frequencies do not need a row per (post, term), nor the terms
themselves.  Posts are dealt to shards of bounded size; a shard lists the
code of each of its terms once, cut by code into buckets.  A bucket sums the
counts of all shards and sends back sums over one; a code that does not
come back stands in one post.  A term that stands in every post is one entry
per shard, so no bucket holds a hot term.  Then the n-grams of a shard are taken
from its posts once more, a stretch of them at a time: what is stored and
shuffled is the posts and the lists of codes, never the counts of a post.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SHARD_BYTES = 16 << 20   # of the texts of one shard
LEAST_BYTES = 2 << 20
STRETCH_BYTES = 1 << 18  # of the texts whose n-grams are held at once
BUCKET_TERMS = 8 << 20   # of the codes of one bucket, if no term stood twice
HELD_TERMS = 4 << 20     # codes of stretches of a shard before they are summed

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20_240_602).integers(1, 1 << 63, 256, dtype=np.uint64)  # the seed is part of a code's meaning


class Texts(NamedTuple):
    """UTF-8 texts ``first`` to ``first + n`` of a batch."""
    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


def text_shards(col: pa.Array, size: int = 1 << 20) -> Iterator[Texts]:
    """Row ranges of a string column of at most ``size`` bytes (a longer
    text is a range of its own); null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1))
        yield Texts(lo, hi - lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def word_units(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the words of space-joined texts."""
    inside = t.data != 0x20
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(inside):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(end) + 1, np.searchsorted(t.offsets, a, side="right") - 1


def char_units(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the characters of texts."""
    a = np.flatnonzero((t.data & 0xC0) != 0x80)
    return a, np.concatenate([a[1:], [len(t.data)]]).astype(np.int64), np.searchsorted(t.offsets, a, side="right") - 1


def split_units(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the stretches between single spaces, empty ones
    kept: a text of k spaces has k + 1."""
    space = np.flatnonzero(t.data == 0x20)
    n = np.diff(np.searchsorted(space, t.offsets)) + 1
    return (np.sort(np.concatenate([t.offsets[:-1], space + 1])), np.sort(np.concatenate([space, t.offsets[1:]])),
            np.repeat(np.arange(t.n), n))


def whole_units(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of whole texts."""
    return t.offsets[:-1], t.offsets[1:], np.arange(t.n)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SIZE = np.uint64(0xD6E8FEB86659FD93)


class Coder:
    """Codes of stretches of bytes of some texts; equal bytes have equal
    codes wherever they stand."""

    def __init__(self, t: Texts):
        f = np.full(len(t.data) + 16, _BASE, np.uint64)
        f[0] = 1
        self.power = np.multiply.accumulate(f)
        f[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        self.inverse = np.multiply.accumulate(f)
        self.total = np.zeros(len(t.data) + 1, np.uint64)
        np.cumsum(_BYTE[t.data] * self.power[:len(t.data)], out=self.total[1:])

    def _sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.inverse[a]

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the bytes from a to b."""
        return _mix(self._sums(a, b) + (b - a).astype(np.uint64) * _SIZE)

    def joined(self, a: np.ndarray, b: np.ndarray, between: str, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Of the bytes from a to b, a short text and the bytes from c to d."""
        middle = np.frombuffer(between.encode(), np.uint8)
        inner = np.sum(_BYTE[middle] * self.power[:len(middle)], dtype=np.uint64)
        at = b - a + len(middle)
        sums = self._sums(a, b) + inner * self.power[b - a] + self._sums(c, d) * self.power[at]
        return _mix(sums + (at + d - c).astype(np.uint64) * _SIZE)


def ngram_codes(t: Texts, units: Callable, lo: int, hi: int):
    """(code, start, end, text) of all n-grams of lo to hi units."""
    start, end, row = units(t)
    parts = []
    for n in range(lo, hi + 1):
        if len(start) < n:
            break
        a, b, r = start[:len(start) - n + 1], end[n - 1:], row[:len(start) - n + 1]
        one = r == row[n - 1:]
        parts.append((a[one], b[one], r[one]))
    if not parts:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    a, b, r = (np.concatenate(x) for x in zip(*parts))
    return Coder(t).codes(a, b), a, b, r


def strings(t: Texts, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of bytes as a string array."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(t.data[at])).cast(pa.string())


def term_shards(posts: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """``posts`` (post_id, text) dealt to shards, written to the shared
    folder: (shard, post_id, text); their number and their bytes."""
    spark = posts.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/term-shards-{uuid.uuid4().hex}"
    posts.select(F.xxhash64("post_id", F.monotonically_increasing_id()).alias("deal"), "post_id", "text").write.parquet(folder)
    held = spark.read.parquet(folder)
    rows, size = held.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = min(shard_bytes, max(LEAST_BYTES, size // (2 * tasks)))
    shard = F.pmod("deal", F.lit(max(1, -(-size // one))).cast("long"))
    return held.select(shard.alias("shard"), "post_id", "text"), rows, size


def _by_shard(df: DataFrame, size: int) -> GroupedData:
    """Few shards to a partition, so that tasks are even."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, min(4 * tasks, 2 * size // LEAST_BYTES)), "shard").groupBy("shard")


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of numbers up to each end, as binary values."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(col: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in col]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, and the sum of each one's numbers."""
    by = np.argsort(code)
    code = code[by]
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[head], np.add.reduceat(n[by], head, dtype=n.dtype) if len(head) else n


class Grams(NamedTuple):
    """N-grams of a stretch of texts: the distinct terms' codes and bytes
    from ``start`` to ``end``; (text, term, count) in order of texts."""
    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    term: np.ndarray
    count: np.ndarray


def grams(t: Texts, units: Callable, lo: int, hi: int) -> Grams:
    code, a, b, row = ngram_codes(t, units, lo, hi)
    local, codes = pd.factorize(code)  # numbered by first occurrence
    first = np.flatnonzero(np.diff(np.maximum.accumulate(local), prepend=-1))
    cell = np.sort(row * max(1, len(codes)) + local)
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else cell
    text, term = np.divmod(cell[head], max(1, len(codes)))
    return Grams(codes, a[first], b[first], text, term, np.diff(head, append=len(cell)))


def corpus_frequencies(shards: DataFrame, size: int, units: Callable, lo: int, hi: int) -> DataFrame:
    """(shard, codes, df): packed codes of a shard's terms that stand in more
    than one post of the whole corpus, and the number of these posts."""
    buckets = max(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), size * (hi - lo + 1) // BUCKET_TERMS)

    def listed(shard: pa.Scalar, held: list) -> pa.RecordBatch:
        codes, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        bucket = ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        ends = np.flatnonzero(np.diff(bucket, append=buckets)) + 1
        return pa.record_batch({"bucket": pa.array(bucket[ends - 1]), "shard": pa.repeat(shard, len(ends)),
                                "codes": _binary(codes, ends), "df": _binary(n, ends)})

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        n = 0
        for batch in batches:
            for t in text_shards(batch.column("text"), STRETCH_BYTES):
                g = grams(t, units, lo, hi)
                held.append((g.codes, np.bincount(g.term, minlength=len(g.codes)).astype(np.int32)))
                n += len(g.codes)
                if n > HELD_TERMS:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    n = 0
        yield listed(key[0], held)

    def total(rows: pa.Table) -> pa.Table:
        codes, df = _numbers(rows["codes"], np.uint64), _numbers(rows["df"], np.int32)
        ends = np.cumsum([len(c) for c in codes])
        codes, df = np.concatenate(codes), np.concatenate(df)
        local, _ = pd.factorize(codes)
        sums = np.bincount(local, weights=df).astype(np.int64)[local]
        more = sums > 1
        ends = np.cumsum(more)[ends - 1]
        return pa.table({"shard": rows["shard"], "codes": _binary(codes[more], ends), "df": _binary(sums[more], ends)})

    lists = _by_shard(shards.select("shard", "text"), size).applyInArrow(
        count, "bucket bigint, shard bigint, codes binary, df binary")
    return lists.groupBy("bucket").applyInArrow(total, "shard bigint, codes binary, df binary")


def with_frequencies(shards: DataFrame, size: int, units: Callable, lo: int, hi: int, fn: Callable, schema: str) -> DataFrame:
    """``fn(post_id, texts, grams, df of their terms)`` for every stretch of
    the posts of every shard."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts, codes, df = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            post = batch.column("codes").is_null()
            posts.append(batch.select(["post_id", "text"]).filter(post))
            lists = batch.filter(pc.invert(post))
            codes += _numbers(lists.column("codes"), np.uint64)
            df += _numbers(lists.column("df"), np.int64)
        known, df = pd.Index(np.concatenate(codes)), np.concatenate([*df, [1]])  # the last one: not listed
        while posts:
            batch = posts.pop(0)
            for t in text_shards(batch.column("text"), STRETCH_BYTES):
                g = grams(t, units, lo, hi)
                if len(g.codes):
                    yield fn(batch.column("post_id").slice(t.first, t.n), t, g, df[known.get_indexer(g.codes)])

    lists = corpus_frequencies(shards, size, units, lo, hi)
    both = shards.unionByName(lists, allowMissingColumns=True)
    return _by_shard(both, size).applyInArrow(task, schema)
