"""Words, word hashes and shingles of a batch of texts, computed over the UTF-8 bytes of the whole batch at once.

Word separators are the bytes 0x20 and 0x09-0x0D, and only A-Z is lower-cased, so working on bytes equals working on code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_GEN = np.random.Generator(np.random.PCG64(20260101))
_BYTE_VALUE = _GEN.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        both = []
        for base in (_BASE, _INVERSE):
            p = np.ones(size, np.uint64)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * np.uint64(pow(base, have, 2**64))
                have *= 2
            both.append(p)
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together; a longer text comes alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of the texts in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """starts, ends (bytes) and doc (row) of each word; first[d]:first[d + 1] are the words of row d."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = raw(texts)
        n = len(self.data)
        ok = ~SPACE[self.data]
        start, end = ok.copy(), ok.copy()
        start[1:] &= ~ok[:-1]
        end[:-1] &= ~ok[1:]
        edge = self.off[(self.off > 0) & (self.off < n)]
        start[edge] = ok[edge]
        end[edge - 1] = ok[edge - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.first[-1] = len(self.starts)
        self.docs = len(self.off) - 1

    def part_final(self, marks: bytes) -> None:
        """Make a mark that ends a word, behind an ASCII letter or digit, a word of its own."""
        if not len(self.starts):
            return
        last = self.data[self.ends - 1]
        before = self.data[np.maximum(self.ends - 2, 0)]
        split = np.isin(last, list(marks)) & (self.ends - self.starts > 1) & _ALNUM[before]
        more = np.cumsum(split)
        at = np.arange(len(self.starts)) + more - split
        n = len(self.starts) + int(more[-1])
        starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts[at], ends[at] = self.starts, self.ends - split
        own = at[split] + 1
        starts[own], ends[own] = self.ends[split] - 1, self.ends[split]
        self.first = self.first + np.concatenate([[0], more])[self.first]
        self.starts, self.ends = starts, ends

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64 bits of each word, lower-cased if asked for."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = powers(n)
        value = _BYTE_VALUE[LOWER[self.data] if lower else self.data]
        value *= power
        total = np.cumsum(value, dtype=np.uint64)
        return mix((total[self.ends - 1] - total[self.starts] + value[self.starts]) * inverse[self.starts])

    def shingles(self, size: int) -> Iterator[np.ndarray]:
        """The sorted distinct hashes of each row's word windows; fewer words than `size` make one window, no word makes none."""
        h = self.hashes()
        n = len(h)
        window = np.zeros(n, np.uint64)
        for k in range(min(size, n)):
            window[: n - k] = mix(window[: n - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(k + 1))
        for d in range(self.docs):
            a, b = self.first[d], self.first[d + 1]
            if b - a >= size:
                yield np.unique(window[a : b - size + 1])
            elif b > a:
                x = np.zeros(1, np.uint64)
                for k in range(a, b):
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k] + np.uint64(k - a + 1))
                yield mix(x ^ np.uint64(int(b - a)))
            else:
                yield np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
