"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters for an Aho-Corasick automaton over the vocabulary; one pass over a pre-token gives the longest
token at each byte. From these the encoder goes forward, falls back to shorter tokens where two neighbours are not compatible, and
backtracks where no token fits; a mark for each byte makes sure that no place is tried twice, so the time grows in proportion to the length. Two tokens are compatible if merging their
bytes by the ranks would give just these two; that is found by undoing merges at the seam, and memoised. The result equals applying the
merges in rank order.

Memos are bounded by entries and by bytes: pre-tokens of more than LONG characters aren't kept.

Defined results: null is the empty text; an empty text has no tokens. Rows, also repeated ones and those without doc_id (which stays null), are encoded each on its own. Lone surrogates
cannot occur in Spark strings. An empty table gives none."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm._bytes import slices
from tessera.llm._memo import PieceMemo, segments

_AWKWARD = regex.compile(r"\s\x20|\s\Z")
MOST_WORDS = 300_000  # of the memo of pre-tokens
LONG = 48
MOST_SEAMS = 2_000_000  # of the memo of compatible neighbours
_PIECE = regex.compile(r"\s*\S+|\s+")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks in the .tiktoken format: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b) - 1, r))
        self.automaton.make_automaton()
        most = max(self.bytes_of) + 1
        self.size, self.prefix = [0] * most, [None] * most
        for r, b in self.bytes_of.items():
            self.size[r] = len(b)
            self.prefix[r] = next((x for n in range(len(b) - 1, 0, -1) if (x := ranks.get(b[:n])) is not None), None)  # the longest token that is a proper prefix
        self.fits: dict[int, bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        for r in sorted(self.bytes_of):
            self.parts[r] = self._last_merge(r)
            if self.parts[r]:
                self.merged[self.parts[r]] = r
        self.words: dict[str, list[int]] = {}
        self.memo = PieceMemo(self._pieces)

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges join to get token; None for single bytes and for tokens that no merge makes."""
        b, left = self.bytes_of[token], self.prefix[token]
        while left is not None:
            right = self.ranks.get(b[len(self.bytes_of[left]) :])
            if right is not None and left < token and right < token and self._compatible(left, right):
                return left, right
            left = self.prefix[left]
        return None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the seam between left and right alone: undo merges, the latest first, and look for one across the seam that would have come before."""
        limit, a, b = 1 << 60, left, right
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            pa_, pb_ = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb_ is None:
                return True
            if pb_ is None or (pa_ is not None and a > b):
                limit, a = a, pa_[1]
            else:
                limit, b = b + 1, pb_[0]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n, size, fits, prefix, seam = len(word), self.size, self.fits, self.prefix, self.fits.get
        longest = [0] * n
        for end, (back, rank) in self.automaton.iter(word.decode("latin-1")):
            longest[end - back] = rank  # ends only grow, so the longest token of a start comes last
        out: list[int] = []
        closed = bytearray(n)  # places from which no way leads to the end
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            ok = end == n or not closed[end]
            if ok and out:
                ok = seam(key := out[-1] << 32 | token)
                if ok is None:
                    if len(fits) > MOST_SEAMS:
                        fits.clear()
                    ok = fits[key] = self._compatible(out[-1], token)
            if ok:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            shorter = prefix[token]
            while shorter is None:  # nothing fits here: this place is closed, and the token before is shortened
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                shorter = prefix[token]
            token = shorter

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        out, words, find = [], self.words, self.pattern.findall
        if len(words) > MOST_WORDS:
            words.clear()
        for piece in pieces:
            ids: list[int] = []
            for word in find(piece):
                got = words.get(word)
                if got is None:
                    got = self.encode_word(word.encode())
                    if len(word) <= LONG:
                        words[word] = got
                ids += got
            out.append(ids)
        return out

    @staticmethod
    def split(text: str) -> Iterator[list[str]]:
        """Pieces of the text, part by part. The pattern never joins a non-space to a space after it, so the text may be cut there."""
        for part in segments(text):
            if _AWKWARD.search(part):
                yield _PIECE.findall(part)
            else:
                first, *rest = part.split(" ")
                yield ([first] if first else []) + [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each text the ids of its parts."""
        return self.memo.texts(((i, pieces) for i, text in enumerate(texts) for pieces in self.split(text)), len(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def encoded(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text; with_ids adds ids (array of int) and decoded (string).

    vocabulary is a .tiktoken file on the driver; its content (about a megabyte, whatever the input) is sent to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids_hash, text_hash, all_ids, all_text = [], [], [], [], []
                for parts in enc.encode([x or "" for x in part.column("text").to_pylist()]):
                    count, h, d, kept, said = 0, hashlib.sha256(), hashlib.sha256(), [], []
                    for ids in parts:
                        count += len(ids)
                        h.update(ids.astype("<u4").tobytes())
                        d.update(back := enc.decode(ids))
                        if with_ids:
                            kept.append(ids)
                            said.append(back)
                    n.append(count)
                    ids_hash.append(h.hexdigest())
                    text_hash.append(d.hexdigest())
                    if with_ids:
                        all_ids.append(np.concatenate([*kept, np.zeros(0, np.uint32)]).astype(np.int32))
                        all_text.append(b"".join(said).decode())
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)
