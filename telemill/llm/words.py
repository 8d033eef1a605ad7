"""Whole Arrow columns of text as byte arrays: words, hashes of byte ranges and remembered results per word.

A column of UTF-8 texts is one byte buffer with offsets. Everything here works on that buffer with numpy, so no Python
object is made per word. Ranges are compared by 64-bit polynomial hashes over random byte values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # texts are worked on in blocks of about this many bytes; a longer text is a block of its own
LARGE_BLOCK = 4 << 20  # where work per block counts and a block needs little besides

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(2**60, 2**63)) | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(1 << (n - 1).bit_length(), 2 * BLOCK_BYTES)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[:len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, width: int) -> np.ndarray:
        """Of every window of that many bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1]
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], name: str,
           limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of the text column ``name``, as (rows, bytes, offsets)."""
    for batch in batches:
        at = batch.schema.get_field_index(name)
        data, offsets = column(batch.column(at))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (batch.slice(first, last - first), data[offsets[first]:offsets[last]],
                   offsets[first:last + 1] - offsets[first])
            first = last


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``white``; no run crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~white[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def pick(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges [at, at + size) of a flat array, one after the other."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    return flat[np.arange(total) + np.repeat(at - (ends - sizes), sizes)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over the ranges between successive bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Memo:
    """Remembers an integer list per hash; forgets all beyond ``limit`` entries, so that its memory is bounded."""

    def __init__(self, kind=np.uint16, limit: int = 1_500_000):
        self.kind, self.limit = kind, limit
        self.clear()

    def clear(self) -> None:
        self.parts = [self._empty(), self._empty()]  # a large one and the newest entries
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0

    @staticmethod
    def _empty():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size per key; the place of an unknown key is -1."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for known, places, sizes in self.parts:
            if len(known):
                k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[k] == keys
                at[hit], size[hit] = places[k[hit]], sizes[k[hit]]
        return at, size

    def add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New keys, in ascending order, with their lists one after the other."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.kind)])
        self.flat[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.parts[1] = self._merge(self.parts[1], (keys, at.astype(np.int64), sizes.astype(np.int32)))
        if len(self.parts[1][0]) > 50_000 + len(self.parts[0][0]) // 4:
            self.parts = [self._merge(*self.parts), self._empty()]

    def full(self, more: int) -> bool:
        return sum(len(p[0]) for p in self.parts) + more > self.limit

    @staticmethod
    def _merge(a, b):
        if not len(a[0]):
            return b
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]


def remembered(memo: Memo, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make,
               hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lists of all ranges, one after the other, and their sizes; ``make(list of bytes)`` is asked once per new range.

    ``make`` returns the lists of its arguments in a flat array, and their sizes.
    """
    if not len(starts):
        return np.zeros(0, memo.kind), np.zeros(0, np.int32)
    hashes = Hasher(data).ranges(starts, ends) if hashes is None else hashes
    keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    at, size = memo.find(keys)
    new = np.flatnonzero(at < 0)
    if len(new):
        if memo.full(len(new)):
            memo.clear()
            new = np.arange(len(keys))
        text, f = data.tobytes(), first[new]
        flat, sizes = make([text[s:e] for s, e in zip(starts[f].tolist(), ends[f].tolist())])
        memo.add(keys[new], flat, sizes)
        at, size = memo.find(keys)
    return pick(memo.flat, at[back], size[back]), size[back]
