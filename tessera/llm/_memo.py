"""Encoding whole texts through a memo of their space-separated pieces; the memo is bounded and lives as long as the worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from tessera.llm._bytes import ragged

MOST_PIECES = 600_000
MOST_BYTES = 48 << 20  # of the pieces and their ids, about
FLUSH = 4 << 20  # characters of pieces that wait for being encoded
SEGMENT = 1 << 20  # characters of a long text that are looked at together
_INNER_EDGE = re.compile(r"\S(?=\x20)")


class PieceMemo:
    """Ids of pieces, as runs in one growing array. encode_new gets new pieces and returns their id lists."""

    def __init__(self, encode_new: Callable[[list[str]], list[list[int]]], most: int = MOST_PIECES):
        self.encode_new, self.most = encode_new, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used, self.bytes = np.zeros(1 << 18, np.uint32), 0, 0

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and the number of ids of each piece."""
        new = list(set(pieces).difference(self.at))
        if new and self.at and (len(self.at) + len(new) > self.most or self.bytes > MOST_BYTES):
            self.clear()
            new = list(set(pieces))
        if new:
            got = self.encode_new(new)
            k, m = len(self.at), len(new)
            lengths = np.fromiter(map(len, got), np.int64, m)
            total = int(lengths.sum())
            self.start, self.length, self.flat = _room(self.start, k + m), _room(self.length, k + m), _room(self.flat, self.used + total)
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.start[k : k + m] = self.used + np.cumsum(lengths) - lengths
            self.length[k : k + m] = lengths
            self.used += total
            self.bytes += 4 * total + sum(map(len, new))
            self.at.update(zip(new, range(k, k + m), strict=True))
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.length[which]
        return self.flat[ragged(self.start[which], lengths)], lengths

    def texts(self, parts: Iterator[tuple[int, list[str]]], texts: int) -> list[list[np.ndarray]]:
        """For each of so many texts the ids of its parts. parts gives the text's number and the pieces of a part, in order."""
        out: list[list[np.ndarray]] = [[] for _ in range(texts)]
        owner: list[int] = []
        size: list[int] = []
        pieces: list[str] = []

        waiting = 0

        def flush() -> None:
            ids, lengths = self.ids(pieces)
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *size])]
            for i, d in enumerate(owner):
                out[d].append(ids[ends[i] : ends[i + 1]])
            owner.clear()
            size.clear()
            pieces.clear()

        for d, more in parts:
            owner.append(d)
            size.append(len(more))
            pieces += more
            waiting += sum(map(len, more))
            if len(pieces) > 200_000 or waiting > FLUSH:
                flush()
                waiting = 0
        flush()
        return out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    bigger = np.zeros(1 << (size - 1).bit_length(), array.dtype)
    bigger[: len(array)] = array
    return bigger


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """The text in parts that begin with a space after a non-space (but the first); no part is much longer than `most` unless nothing can be cut."""
    at = 0
    while len(text) - at > most:
        edge = _INNER_EDGE.search(text, at + most)
        if edge is None:
            break
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:] if at else text
