"""Texts of an Arrow batch as byte arrays, and words as 64-bit codes.

Python tasks of this subpackage work on the UTF-8 bytes of many texts at
once with numpy.  ``chunks`` cuts a batch into row ranges of bounded size
(a longer text is a chunk of its own), so memory follows the longest text
and not the batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# One random 64-bit value per byte; the seed is part of the code's meaning.
_CODE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Chunk(NamedTuple):
    """Texts ``first`` to ``first + n`` of a batch; text i of the chunk is
    ``data[offsets[i]:offsets[i + 1]]``."""
    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(col: pa.Array, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        part = data[offs[lo]:offs[hi]]
        yield Chunk(lo, hi - lo, LOWER[part] if lower else part, offs[lo:hi + 1] - offs[lo])
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, CHUNK_BYTES + 1)
        inv = pow(_BASE, -1, 1 << 64)
        for name, b in (("_POWERS", _BASE), ("_INVERSE", inv)):
            f = np.full(size, b, dtype=np.uint64)
            f[0] = 1
            globals()[name] = np.multiply.accumulate(f)
    return _POWERS, _INVERSE


def word_bounds(chunk: Chunk, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every run of non-space bytes; a run
    never crosses a text's end."""
    if len(chunk.data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~space[chunk.data]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[chunk.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(end) + 1, np.searchsorted(chunk.offsets, a, side="right") - 1


def running_code(chunk: Chunk) -> np.ndarray:
    """Running sums of the bytes' polynomial, from which any run's code follows."""
    n = len(chunk.data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_CODE[chunk.data] * _powers(n + 1)[0][:n], out=total[1:])
    return total


def run_codes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit code of every run of bytes: a polynomial of its bytes, mixed."""
    if len(start) == 0:
        return np.zeros(0, dtype=np.uint64)
    h = (total[end] - total[start]) * _powers(len(total))[1][start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_codes(chunk: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return run_codes(running_code(chunk), start, end)


def per_text_sum(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n)


class Tally:
    """Counts of 64-bit codes with bounded memory: ``add`` returns rows
    that no longer fit (they are summed again after the shuffle)."""

    def __init__(self, limit: int = 1 << 21):
        self.limit, self.keys, self.counts, self.size = limit, [], [], 0

    def add(self, codes: np.ndarray):
        k, c = np.unique(codes, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size > self.limit:
            k, c = self._fold()
            if len(k) > self.limit // 2:
                self.keys, self.counts, self.size = [], [], 0
                return k, c
            self.keys, self.counts, self.size = [k], [c], len(k)
        return None

    def _fold(self):
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return fold(np.concatenate(self.keys), np.concatenate(self.counts))

    def rest(self):
        out = self._fold()
        self.keys, self.counts, self.size = [], [], 0
        return out


def fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class CodeMap:
    """Code -> float by open addressing, looked up for whole arrays."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
    LOAD = 0.65  # of the slots, whatever their number: a map in a file is copied to every executor

    def __init__(self, keys: np.ndarray, values: np.ndarray, slots: np.ndarray | None = None, room: np.ndarray | None = None):
        """``slots`` and ``room``: arrays of ``size_for(len(keys))`` to hold
        the map, such as parts of a mapped file."""
        size = self.size_for(len(keys))
        self._adopt(np.empty(size, np.uint64) if slots is None else slots, np.empty(size, values.dtype) if room is None else room)
        self.slots[:] = self.FREE
        self.values[:] = 0
        left, at = np.arange(len(keys)), self._spot(keys)
        while len(left):
            free = self.slots[at] == self.FREE
            self.slots[at[free]] = keys[left[free]]
            won = self.slots[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) % self.size

    @staticmethod
    def size_for(n: int) -> int:
        return max(16, int(n / CodeMap.LOAD) + 1)

    def _adopt(self, slots: np.ndarray, values: np.ndarray) -> None:
        self.slots, self.values, self.size = slots, values, len(slots)

    @classmethod
    def held(cls, slots: np.ndarray, values: np.ndarray) -> "CodeMap":
        """The map that an earlier one left in these arrays."""
        out = cls.__new__(cls)
        out._adopt(slots, values)
        return out

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        high = (keys * np.uint64(_BASE)) >> np.uint64(32)
        return ((high * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); the value of a missing code is 0."""
        at = self._spot(keys)
        seen = self.slots[at]
        found = seen == keys
        out = self.values[at]
        again = np.flatnonzero(~found & (seen != self.FREE))
        out[~found] = 0
        at = at[again]
        while len(again):
            at = (at + 1) % self.size
            seen = self.slots[at]
            hit = seen == keys[again]
            out[again[hit]] = self.values[at[hit]]
            found[again[hit]] = True
            go = ~hit & (seen != self.FREE)
            again, at = again[go], at[go]
        return out, found


class ArrayFile:
    """Named arrays in one file, mapped read-only by every reader: readers
    on one machine share its pages and hold no copy."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            self.head = json.loads(f.read(size))
        self.data = np.memmap(path, np.uint8, "r")

    def __getitem__(self, name: str) -> np.ndarray:
        kind, n, at = self.head[name]
        return self.data[at:at + n * np.dtype(kind).itemsize].view(kind)

    @staticmethod
    def create(path: str, shapes: dict) -> dict:
        """Arrays to fill, ``shapes``: name -> (dtype, length); the file is
        complete when they are flushed."""
        head, at = {}, 1 << 16
        for name, (kind, n) in shapes.items():
            head[name] = (np.dtype(kind).str, int(n), at)
            at += -(-int(n) * np.dtype(kind).itemsize // 64) * 64
        text = json.dumps(head).encode()
        with open(path, "wb") as f:
            f.write(len(text).to_bytes(8, "little") + text)
            f.truncate(max(at, 1 << 16))
        data = np.memmap(path, np.uint8, "r+")
        return {name: data[a:a + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, a) in head.items()}
