"""Maximal periodic runs of words, by uniting suffix classes.

Per text: suffixes of the word sequence are ordered by doubling (numpy,
many texts at once; a suffix leaves the sort when it is alone in its
class), the common prefix of neighbours follows from the classes of each
doubling round, and suffix classes are united by decreasing common prefix
(Kruskal's order) with union-find.  A class keeps its positions ordered
and takes the smaller class into the larger.  Two positions i < j that
become adjacent in a class, at a distance of at most the common prefix l,
seed a run: words i to j + l have period j - i, which is the smallest one,
because a smaller one would have put a position of the class between i and
j.  The run is maximal to the right as l is exact, and is reported from
its leftmost seed (the words before i and j differ).  Each run has exactly
one such seed.

Only positions that share at least six words with another one of their
text are united: a run of 12 words or of two periods has such a seed, as
max(12, 2q) - q >= 6.  Classes whose closest positions are farther apart
than their longest common prefix hold no seed and are passed over.

Texts are independent rows: nothing is shuffled and a hot key has no
effect.  Memory follows the longest text (n log n numbers for n words).

Defined cases: a null or empty text has no words, no run and an empty
collapsed text; repeated rows and ids are judged row by row; an empty
table gives an empty result; other columns pass through unread and keep
their names, unless the name is one of ``OUT``: those are replaced.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestream import Chunk, chunks, word_bounds, word_codes
from .columns import bind, text_or_empty, words

LEAST = 12                  # words of the shortest run
OUT = ("n_words", "runs", "collapsed")
_LEAST_SHARED = LEAST // 2
_OUT_SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class _Order:
    """Suffix order of the words of many texts; suffixes end with their text.

    ``classes[k]`` holds the positions whose first 2**k words recur in
    their text, sorted, and a class number for each.
    """

    def __init__(self, ids: np.ndarray, row: np.ndarray, stop: np.ndarray):
        n = len(ids)
        self.classes: list[tuple[np.ndarray, np.ndarray]] = []
        key = row * (int(ids.max()) + 1 if n else 1) + ids
        sa = np.argsort(key, kind="stable")
        slot = np.arange(n)
        rank = np.empty(n, np.int64)
        first = _group_starts(key[sa])
        rank[sa] = first
        self.sa = sa
        active = slot[_shared(first)]
        h = 1
        while len(active):
            pos = np.sort(sa[active])
            self.classes.append((pos, rank[pos].copy()))
            pos = sa[active]
            after = pos + h
            inside = after < stop[pos]
            second = np.where(inside, rank[np.where(inside, after, 0)], -1)
            old = rank[pos]
            order = np.lexsort((second, old))
            pos, old, second = pos[order], old[order], second[order]
            sa[active] = pos
            new = np.ones(len(pos), bool)
            new[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
            first = active[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
            rank[pos] = first
            active = active[_shared(first)]
            h *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b (a != b) begin with in common."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            pos, cls = self.classes[k]
            i, j = _index(pos, a + out), _index(pos, b + out)
            same = (i >= 0) & (j >= 0) & (cls[i] == cls[j])
            out[same] += 1 << k
        return out


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def _shared(first: np.ndarray) -> np.ndarray:
    """Members of groups of two and more, groups being adjacent."""
    out = np.zeros(len(first), bool)
    same = first[1:] == first[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _index(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def unite(pos: list[int], common: list[int]) -> list[tuple[int, int, int]]:
    """Seeds (i, j, l) of one chain of suffixes in suffix order, where
    ``common[k]`` is the common prefix of ``pos[k]`` and ``pos[k + 1]``."""
    seeds = []
    root = list(range(len(pos)))
    sets = [[p] for p in pos]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k in sorted(range(len(common)), key=common.__getitem__, reverse=True):
        shared = common[k]
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        i = 0
        while i < len(small):
            gap = bisect_left(large, small[i])
            j = i + 1  # the small class' members in one gap of the large one
            nxt = large[gap] if gap < len(large) else None
            while j < len(small) and (nxt is None or small[j] < nxt):
                j += 1
            if gap and small[i] - large[gap - 1] <= shared:
                seeds.append((large[gap - 1], small[i], shared))
            if nxt is not None and nxt - small[j - 1] <= shared:
                seeds.append((small[j - 1], nxt, shared))
            i = j
        if len(small) < 8:
            for x in small:
                large.insert(bisect_left(large, x), x)
        else:
            large.extend(small)
            large.sort()  # two sorted stretches: one merge
        sets[b], root[b] = [], a
    return seeds


def word_runs(codes: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs in the texts' words;
    ``row`` is the text of every word, ascending.  Sorted by start, period."""
    none = np.zeros(0, np.int64)
    if len(codes) == 0:
        return none, none, none
    need = max(1, (least + 1) // 2)
    ids = np.unique(codes, return_inverse=True)[1]
    stop = np.searchsorted(row, row, side="right")
    order = _Order(ids, row, stop)
    a, b = order.sa[:-1], order.sa[1:]
    depth = need.bit_length() - 1  # only suffixes that share 2**depth <= need words
    if len(order.classes) <= depth:
        return none, none, none
    pos, cls = order.classes[depth]
    i, j = _index(pos, a), _index(pos, b)
    near = (i >= 0) & (j >= 0) & (cls[i] == cls[j])
    slot = np.flatnonzero(near)
    shared = order.common(a[slot], b[slot])
    slot, shared = slot[shared >= need], shared[shared >= need]
    if len(slot) == 0:
        return none, none, none
    # chains of neighbouring slots; a chain is one class of suffixes
    head = np.flatnonzero(np.concatenate([[True], np.diff(slot) > 1]))
    size = np.diff(np.concatenate([head, [len(slot)]]))
    chain = np.repeat(np.arange(len(head)), size)
    member = np.concatenate([a[slot], b[slot[head + size - 1]]])
    of = np.concatenate([chain, np.arange(len(head))])
    by = np.lexsort((member, of))
    gap = np.diff(member[by])
    gap[np.diff(of[by]) > 0] = np.iinfo(np.int64).max
    closest = np.minimum.reduceat(np.concatenate([gap, [np.iinfo(np.int64).max]]), np.searchsorted(of[by], np.arange(len(head))))
    hopeful = closest <= np.maximum.reduceat(shared, head)
    seeds = []
    two = hopeful & (size == 1)
    x, y = a[slot[head[two]]], b[slot[head[two]]]
    pairs = [np.stack([np.minimum(x, y), np.maximum(x, y), shared[head[two]]], 1)]
    for k in np.flatnonzero(hopeful & (size > 1)):
        lo, hi = head[k], head[k] + size[k]
        seeds += unite(order.sa[slot[lo]:slot[hi - 1] + 2].tolist(), shared[lo:hi].tolist())
    if seeds:
        pairs.append(np.array(seeds, np.int64))
    i, j, l = np.concatenate(pairs).T
    period, length = j - i, j - i + l
    left = np.maximum(i - 1, 0)
    inner = (i > 0) & (row[left] == row[i]) & (ids[left] == ids[j - 1])
    good = (period <= l) & (length >= least) & ~inner
    i, length, period = i[good], length[good], period[good]
    by = np.lexsort((period, i))
    return i[by], length[by], period[by]


def _collapsed(c: Chunk, start: np.ndarray, end: np.ndarray, row: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Kept words of every text of the chunk, joined by one space."""
    start, end, row = start[keep], end[keep], row[keep]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    size = end - start + ~last
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - out[:-1], size) + np.arange(out[-1])
    data = c.data[np.minimum(at, max(0, len(c.data) - 1))]
    data[(out[1:] - 1)[~last]] = 0x20
    offsets = out[np.searchsorted(row, np.arange(c.n + 1))]
    return pa.LargeStringArray.from_buffers(c.n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` but the text, with n_words, runs (word
    numbers, sorted by start and period) and the collapsed text: a word is
    dropped if a run holds it after that run's first period."""
    kept = [f for f in docs.schema.fields if f.name not in (text, *OUT)]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], text_or_empty(F.col(text)).alias("__text"))

    def task(batches):
        for batch in batches:
            for c in chunks(batch.column("__text"), lower=False):
                start, end, row = word_bounds(c)
                first = np.searchsorted(row, np.arange(c.n + 1))
                at, length, period = word_runs(word_codes(c, start, end), row, least)
                edge = np.zeros(len(row) + 1, np.int64)
                np.add.at(edge, at + period, 1)
                np.add.at(edge, at + length, -1)
                keep = np.cumsum(edge[:-1]) == 0
                of = row[at]
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(c.n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(at - first[of]), pa.array(length), pa.array(period)],
                                               ["start", "length", "period"]))
                rest = {k: batch.column(k).slice(c.first, c.n) for k in batch.schema.names if k != "__text"}
                yield pa.record_batch({**rest, "n_words": pa.array(np.diff(first)), "runs": runs,
                                       "collapsed": _collapsed(c, start, end, row, keep)})

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(task, schema + _OUT_SCHEMA)


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The contract's texts: where crc32 of the id ends in 0, every word
    from the a-th on repeats the p words from there; a null id stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def bend(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return bind(F.struct(w.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            x["w"], lambda word, i: F.when(i < x["a"], word).otherwise(F.get(x["w"], x["a"] + F.pmod(i - x["a"], x["p"])))), " "))

    bent = bind(words(text), lambda w: F.when(F.size(w) > 0, bend(w)))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), bent).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Contract columns of query ``op13``."""
    planted = docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
