"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, at least LEAST and 2q long, that no neighbouring word extends. The texts of a slice, with marks that occur once between them, are one string:

1. A word that lies in no repeated window of LEAST / 2 words can't be in a run (two words q apart stand for each word of a run, and LEAST / 2 such pairs at least follow each other), so only stretches of other words are kept.
2. The suffix array and its common prefixes stand for the suffix tree: an interval of suffixes that share m words is the tree's place for these words.
3. Lempel-Ziv blocks. A square whose leftmost occurrence has its middle in a block reaches the next block or begins before this one; for each such period two common extensions at the block's edge find it. This gives squares that
   cover the leftmost occurrence of every square.
4. From each of these the suffix links are walked: the square that begins one word later is there as long as the next word closes it. This completes the vocabulary of squares.
5. Each member's interval locates all its occurrences; occurrences of one period at consecutive words merge into a run. Periods that are multiples of a smaller one have the same stretch and go.

Defined results: null and empty texts have no words and no runs. Rows are judged each by its own whole text, also repeated ones and those without doc_id; a text of any length is one string, never cut. Words are told apart by 64-bit hashes.
An empty table gives none. Other columns of docs, of whatever name, aren't read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._bytes import Words, mix, ragged, slices

LEAST = 12
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Suffixes:
    """The suffixes of t (numbers from 0; its last, and first, occur once) in order, and how far any two places agree.

    names[j] tells apart the stretches of 2^j numbers at each place: by the place, in the order of suffixes, of the first with the same stretch."""

    def __init__(self, t: np.ndarray):
        n = len(t)
        self.order = np.argsort(t, kind="stable")
        s = t[self.order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        rank = np.empty(n, np.int64)
        rank[self.order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.names = []
        slots = np.arange(n)  # of order, whose suffixes aren't told apart yet
        width = 1
        while True:
            many = np.diff(np.append(np.flatnonzero(new), len(slots)))
            shared = np.repeat(many > 1, many)
            slots = slots[shared]
            if not len(slots):
                break
            self.names.append(rank)
            at = self.order[slots]
            key = rank[at] * n + rank[at + width]
            some = np.argsort(key, kind="stable")
            at, key = at[some], key[some]
            self.order[slots] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank = rank.copy()
            rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
            width *= 2
        self.rank = rank
        self.prefix = np.zeros(n, np.int64)  # that a suffix shares with the one before it in order
        self.prefix[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.least = [self.prefix]  # least[j]: the smallest of 2^j prefixes up to each place

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree from a and b on; a and b differ."""
        far = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.names))):
            far += (self.names[j][a + far] == self.names[j][b + far]).astype(np.int64) << j
        return far

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree up to and with a and b; a and b differ."""
        far = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.names))):
            x, y = a - far - (1 << j) + 1, b - far - (1 << j) + 1
            inside = np.minimum(x, y) >= 0
            far += (inside & (self.names[j][np.maximum(x, 0)] == self.names[j][np.maximum(y, 0)])).astype(np.int64) << j
        return far

    def interval(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last place in order of the suffixes that share so many numbers with the one at each place."""
        n = len(self.order)
        while 2 << (len(self.least) - 1) < n:
            w, last = 1 << (len(self.least) - 1), self.least[-1]
            more = last.copy()
            more[w:] = np.minimum(last[w:], last[:-w])
            more[: 2 * w - 1] = 0
            self.least.append(more)
        first, last = self.rank[at], self.rank[at]
        for j in reversed(range(len(self.least))):
            w, least = 1 << j, self.least[j]
            first = first - w * (least[first] >= length)
            to = np.minimum(last + w, n - 1)
            last = np.where((last + w < n) & (least[to] >= length), to, last)
        return first, last


def blocks(s: Suffixes) -> np.ndarray:
    """The first places of the Lempel-Ziv blocks: each is the longest stretch that also begins earlier, or one number.

    Suffixes are taken out of the order from the last one on, so that each one's neighbours are then those that begin earlier."""
    n = len(s.order)
    left, right, shared = np.full(n + 1, n), np.full(n + 1, n), np.zeros(n + 1, np.int64)
    left[s.order[1:]], right[s.order[:-1]], shared[s.order] = s.order[:-1], s.order[1:], s.prefix
    left, right, shared = left.tolist(), right.tolist(), shared.tolist()
    longest = [0] * n
    for i in range(n - 1, -1, -1):
        a, b, x, y = left[i], right[i], shared[i], 0
        if b < n:
            y = shared[b]
            left[b] = a
            shared[b] = min(x, y)
        right[a] = b
        longest[i] = max(x, y)
    out, at = [], 0
    while at < n:
        out.append(at)
        at += longest[at] or 1
    return np.array(out, np.int64)


def covering(t: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, period and end of the stretch with this period, of squares that cover the leftmost occurrence of each square; of several periods of one stretch the smallest."""
    n = len(t)
    h = blocks(s)
    ends = np.append(h[1:], n)
    length = ends - h
    # the middle is in the block and the square reaches beyond it
    inner = ends < n
    edge = np.repeat(ends[inner], length[inner])
    q = ragged(h[inner], length[inner])
    ok = t[q] == t[edge]
    edge, q = edge[ok], q[ok]
    period = edge - q
    k1, k2 = s.ahead(edge, q), s.behind(edge - 1, q - 1)
    ok = k1 + k2 >= period
    found = [(np.maximum(q - k2, q - period + 1)[ok], period[ok], (q - k2)[ok], (edge + k1)[ok])]
    # the square begins before the block and its middle is in it
    both = np.minimum(length + np.append(length[1:], 0), n - 1 - h)
    both[0] = 0
    start, stop = np.repeat(h, both), np.repeat(ends, both)
    q = ragged(h + 1, both)
    ok = t[q] == t[start]
    start, stop, q = start[ok], stop[ok], q[ok]
    ok = t[q - 1] == t[start - 1]
    start, stop, q = start[ok], stop[ok], q[ok]
    period = q - start
    k1, k2 = s.ahead(start, q), s.behind(start - 1, q - 1)
    at = np.maximum(start - k2, start - period + 1)
    ok = (k1 + k2 >= period) & (at + period <= stop)
    found.append((at[ok], period[ok], (start - k2)[ok], (q + k1)[ok]))
    at, period, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((at, period, end, first))
    at, period, first, end = at[by], period[by], first[by], end[by]
    new = np.ones(len(at), bool)
    new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    return at[new], period[new], end[new]


def runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of all stretches of t of two periods or more that can't be extended, by start and period. t's first and last number occur once."""
    s = Suffixes(t)
    if not s.names:
        return (np.zeros(0, np.int64),) * 3
    at, period, end = covering(t, s)
    # the walk: after as many links as the period has words the squares come again
    links = np.minimum(period, end - 2 * period - at + 1)
    at, period = ragged(at, links), np.repeat(period, links)
    first, last = s.interval(at, 2 * period)
    _, members = np.unique(first * (len(t) + 1) + period, return_index=True)
    first, last, period = first[members], last[members], period[members]
    many = last - first + 1
    at, period = s.order[ragged(first, many)], np.repeat(period, many)
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
    start, period = at[new], period[new]
    end = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 2 * period if len(at) else start
    by = np.lexsort((period, end, start))
    start, period, end = start[by], period[by], end[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, period, length = start[new], period[new], (end - start)[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def repeated(h: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of so many words that occurs twice or more in their document."""
    n = len(h)
    inside = np.zeros(n, bool)
    if n < width + 1:
        return inside
    w = mix(doc[: n - width + 1].astype(np.uint64))
    for k in range(width):
        w = mix(w + h[k : n - width + 1 + k])
    whole = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    w = w[whole]
    by = np.argsort(w, kind="stable")
    same = w[by][1:] == w[by][:-1]
    at = whole[np.unique(np.concatenate([by[1:][same], by[:-1][same]]))]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return np.cumsum(edges[:-1]) > 0


def runs_of_words(w: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start (word of the row), length and period of the runs of all rows, by row, start and period."""
    h = w.hashes(lower=False)
    doc = np.repeat(np.arange(w.docs), np.diff(w.first))
    at = np.flatnonzero(repeated(h, doc, (least + 1) // 2))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    values = np.unique(h[at], return_inverse=True)[1].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at][1:] != doc[at][:-1])
    part = np.cumsum(new)  # of the stretch of words, from 1
    t = np.arange(len(at) + part[-1] + 1) + len(at)  # numbers that occur once, where no word is put
    place = np.arange(len(at)) + part
    t[place] = values
    back = np.zeros(len(t), np.int64)
    back[place] = at
    start, length, period = runs(t)
    ok = length >= least
    start, length, period = back[start[ok]], length[ok], period[ok]
    row = doc[start]
    return row, start - w.first[row], length, period


def found(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and collapsed, the text without what any run holds after its first period, words joined by one space."""
    rows = docs.selectExpr("doc_id", "cast(text as string) text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                row, start, length, period = runs_of_words(w, least)
                bounds = np.searchsorted(row, np.arange(w.docs + 1))
                collapsed = []
                for d in range(w.docs):
                    words = w.data[w.off[d] : w.off[d + 1]].tobytes().split()
                    a, b = bounds[d], bounds[d + 1]
                    if b > a:
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, start[a:b] + period[a:b], 1)
                        np.add.at(gone, start[a:b] + length[a:b], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words))
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
