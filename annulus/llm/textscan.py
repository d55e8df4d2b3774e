"""Vectorised word and shingle hashing over Arrow text batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z folded to a-z; a
shingle is ``k`` consecutive words, or the whole sequence of a shorter text.  Everything works
on numpy arrays over slices of at most ``SLICE_BYTES`` of text (a longer text is a slice of its
own), so a worker's memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as longer slices come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            made = []
            for base in (_BASE, _BASE_INVERSE):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_powers = _Powers()


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, text bytes, row offsets into them) of each slice; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(len(texts), max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each row's start and after the last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | row_start[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | row_start[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers.to(n)
    total = np.cumsum(_CODE[data] * up, dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], _U(0))
    hashes = mix((total[stop] - before) * down[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row, the hashes of its shingles in order, repeats included."""
    hashes, bounds = words(data, offsets)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
        for j in range(k):
            rolled += hashes[j : j + len(rolled)] * weights[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            yield rolled[a : b - k + 1]
        elif b > a:
            short = np.array([(hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + _U(b - a)])
            yield mix(short)
        else:
            yield rolled[:0]
