"""Words, word hashes and shingles of whole Arrow batches at once.

A word is a run of bytes outside SPACE and TAB..CR, after lower-casing A-Z.
Hashes have 64 bits: equal words always get equal hashes; a pair of different
words meets by chance once in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # bytes hashed at once; bounds memory, also inside one very long text
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWER = _powers(_BASE, BLOCK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


class Words(NamedTuple):
    """Words of a batch, in order. ``first[i]:first[i + 1]`` are those of text i; ``data[start:end]`` is a word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> Words:
    data, offsets = raw(texts)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = inside[tails]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of data[start:end] for spans within one block."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[:n], out=sums[1:])
    return (sums[end] - sums[start]) * _INVERSE[start]


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash for each word, block by block; a word longer than a block is hashed in pieces."""
    out = np.empty(len(w.start), np.uint64)
    i = 0
    while i < len(w.start):
        low = w.start[i]
        j = int(np.searchsorted(w.end, low + BLOCK, "right"))
        if j > i:
            out[i:j] = _hashed(w.data[low : w.end[j - 1]], w.start[i:j] - low, w.end[i:j] - low)
        else:
            j, h = i + 1, np.zeros(1, np.uint64)
            for k in range(low, w.end[i], BLOCK):
                piece = w.data[k : min(k + BLOCK, w.end[i])]
                h = mix(h * np.uint64(_BASE)) + _hashed(piece, np.zeros(1, int), np.array([len(piece)]))
            out[i] = h[0]
        i = j
    return mix(out + (w.end - w.start).astype(np.uint64) * np.uint64(_BASE))


def shingles(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, with offsets for each text; a shorter text is one run."""
    count = np.diff(w.first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    full = count >= n
    out = np.empty(at[-1], np.uint64)
    if len(h) >= n:
        runs = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            runs = runs * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
        runs = mix(runs)
        valid = np.repeat(full, count)[: len(runs)]
        last = np.repeat(w.first[1:], count)[: len(runs)]
        out[np.repeat(full, made)] = runs[valid & (np.arange(len(runs)) + n <= last)]
    for i in np.flatnonzero(~full & (count > 0)):
        value = np.full(1, count[i], np.uint64)
        for x in h[w.first[i] : w.first[i + 1]]:
            value = value * np.uint64(_BASE) + x
        out[at[i]] = mix(value)[0]
    return out, at


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a single longer text is a slice of its own."""
    lengths = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0)
    size = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    i = 0
    while i < len(batch):
        base = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(i, j - i)
        i = j

