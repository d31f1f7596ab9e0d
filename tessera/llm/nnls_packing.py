"""Packing token sequences into windows with non-negative least squares.

Every document is cut into full windows and one tail. The histogram of tail lengths (at most WINDOW - 1 numbers, whatever the input) goes
to the driver, where shallow combinations that fill a window exactly - k tails of one length and one of another, or two
lengths and a third - are enumerated over the lengths that occur. Non-negative least squares finds how often to use each combination so
that the histogram is met; the counts are rounded down (never above what is there) and the remaining tails are packed greedily, longest first, one
behind the other, cut where a window is full. The last, partial window is cut into powers of two, which need no padding.

A tail's place follows from its rank among the tails of its length: a running number within the task that read it plus the counts of the tasks
before. Full windows are numbered in the same way. So nothing but histogram and plan passes through the driver, and a length that a third of all documents share is no burden. The
counts before a task, at most WINDOW numbers, are sent to each run of DEAL of its rows.

Defined results: null is the empty text, which still has the end token; rows with the same or no doc_id are packed each on its own, also repeated ones. A document of any length is cut into
windows of which each is a sequence of its own. Tails of one length take their places in an order that depends on how the table is split. An empty table gives none."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import Words, ragged, slices
from tessera.llm._tables import keep

WINDOW = 4096
END_ID = 2
SWEEPS = 30
SPLITS = 4  # pairs of lengths that are tried to fill up beside one of another length: the most even ones
MOST_WORDS = 600_000  # of a worker's memo
MOST_IDS = 4_000_000  # of these words together
DEAL = 4096  # rows of a task that look up their ranks together


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordTokens:
    """Ids of texts by a tokenizer that lower-cases and whose pre-tokens never hold white space.

    Words are found and hashed for a whole batch at once, a final point or comma as a word of its own; each different word is looked up once in a
    bounded memo of 64-bit hashes. A new word of Latin characters is split here, by the tokenizer's own pattern, and only its model is
    asked; for these characters (up to U+024F) NFC changes nothing. All other new words go through the whole tokenizer."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        says = json.loads(definition)
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in says["added_tokens"]))
        self.pattern = regex.compile(says["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.map = str.maketrans({chr(b): c for b, c in enumerate(_byte_characters())})
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _new(self, words: Iterator[str]) -> list[list[int]]:
        out, find, tokenize = [], self.pattern.findall, self.model.tokenize
        for word in words:
            if not (word.isascii() or max(word) <= "ɏ") or self.special.search(word):
                out.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
                continue
            low = word.lower()
            ids: list[int] = []
            for x in (low,) if low.isalpha() else find(low):
                ids += [t.id for t in tokenize(x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.map))]
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 offsets of the texts in them."""
        w = Words(texts)
        w.part_final(b".,")
        special = bool(((w.data[:-1] == 60) & (w.data[1:] == 124)).any()) if len(w.data) else False  # where "<|" occurs, case matters
        found, first, inverse = np.unique(w.hashes(lower=not special), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == found[inside]
        if (len(self.keys) + (~known).sum() > MOST_WORDS or len(self.flat) > MOST_IDS) and len(self.keys):
            self.clear()
            known[:] = False
        if not known.all():
            data, places = w.data, first[~known]
            got = self._new(data[a:b].tobytes().decode() for a, b in zip(w.starts[places].tolist(), w.ends[places].tolist(), strict=True))
            n, lengths = len(self.start), np.fromiter(map(len, got), np.int64, len(got))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))])
            keys, slot = np.concatenate([self.keys, found[~known]]), np.concatenate([self.slot, np.arange(n, n + len(got))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slot = keys[order], slot[order]
        which = self.slot[np.searchsorted(self.keys, found)][inverse]
        lengths = self.length[which]
        return self.flat[ragged(self.start[which], lengths)], np.concatenate([[0], np.cumsum(lengths)])[w.first]


_tokens: dict[str, WordTokens] = {}


def word_tokens(definition: str) -> WordTokens:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = WordTokens(definition)
    return _tokens[key]


def combinations(lengths: np.ndarray, window: int = WINDOW) -> list[dict[int, int]]:
    """Combinations of lengths that occur and that fill the window: k of one and one other, and k of one with two others."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found: dict[tuple, dict[int, int]] = {}
    by_size = np.sort(lengths)[::-1]
    for a in by_size.tolist():
        for k in range(window // a, 0, -1):
            rest = window - k * a
            if not rest:
                found.setdefault(((a, k),), {a: k})
            elif there[rest]:
                c = {a: k}
                c[rest] = c.get(rest, 0) + 1
                found.setdefault(tuple(sorted(c.items())), c)
        if (rest := window - a) > 2:
            half = np.flatnonzero(there[1 : rest // 2 + 1]) + 1
            for b in half[there[rest - half]][-SPLITS:].tolist():
                c = {a: 1}
                for x in (b, rest - b):
                    c[x] = c.get(x, 0) + 1
                found.setdefault(tuple(sorted(c.items())), c)
    return list(found.values())


def solve(histogram: np.ndarray, patterns: list[dict[int, int]], sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that makes sum over patterns of x * pattern close to the histogram in least squares, by cyclic coordinate descent."""
    left = histogram.astype(float).copy()
    x = np.zeros(len(patterns))
    rows = [(list(p), [float(k) for k in p.values()], float(sum(k * k for k in p.values()))) for p in patterns]
    values = left.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, k, norm) in enumerate(rows):
            step = sum(values[i] * c for i, c in zip(at, k, strict=True)) / norm
            new = x[j] + step
            if new < 0:
                step, new = -x[j], 0.0
            if step:
                x[j] = new
                moved = max(moved, abs(step))
                for i, c in zip(at, k, strict=True):
                    values[i] -= c * step
        if moved < 0.05:
            break
    return x


class Plan:
    """Where the tail of a length and rank goes. Each length's ranks are used up by combinations in turn; ranks behind these are residual."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        lengths = np.flatnonzero(histogram)
        patterns = combinations(lengths, window) if len(lengths) else []
        x = solve(histogram, patterns)
        left = histogram.astype(np.int64).copy()
        runs: dict[int, list[tuple[int, int, int, int, int]]] = {int(n): [] for n in lengths}
        self.sequences = 0
        for want_more in (False, True):  # rounded down first; then rounded up as far as tails are left
            for j in np.argsort(-x, kind="stable"):
                times = int(x[j]) if not want_more else int(x[j] - int(x[j]) > 0.3)
                times = min([times, *(int(left[n]) // k for n, k in patterns[j].items())])
                if times <= 0:
                    continue
                offset = 0
                for n, k in patterns[j].items():
                    # rank r of the run: instance r // k of the combination, copy r % k
                    runs[n].append((int(histogram[n] - left[n]), times * k, k, self.sequences, offset))
                    left[n] -= times * k
                    offset += n * k
                self.sequences += times
        self.first_rank = {n: [r[0] for r in v] for n, v in runs.items()}
        self.runs = runs
        self.residual_rank = {int(n): int(histogram[n] - left[n]) for n in lengths}
        # residual tails lie one behind the other, the longest length first
        order = lengths[::-1]
        tokens = np.concatenate([[0], np.cumsum(left[order] * order)])
        self.residual_token = {int(n): int(t) for n, t in zip(order, tokens[:-1], strict=True)}
        self.residual_tokens = int(tokens[-1])
        last = self.residual_tokens % window
        self.cuts = [0]
        for bit in range(last.bit_length() - 1, -1, -1):
            if last >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))
        self.full_residual = self.residual_tokens // window

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the tail, length, sequence, offset) of each piece of the tail."""
        if rank < self.residual_rank[length]:
            start, _, k, sequence, offset = self.runs[length][bisect_right(self.first_rank[length], rank) - 1]
            r = rank - start
            return [(0, length, sequence + r // k, offset + r % k * length)]
        token = self.residual_token[length] + (rank - self.residual_rank[length]) * length
        pieces, done = [], 0
        while done < length:
            window, at = divmod(token + done, self.window)
            if window < self.full_residual:
                n, sequence, offset = min(length - done, self.window - at), self.sequences + window, at
            else:
                which = next(i for i in range(len(self.cuts) - 1) if self.cuts[i] <= at < self.cuts[i + 1])
                n, sequence, offset = min(length - done, self.cuts[which + 1] - at), self.sequences + self.full_residual + which, at - self.cuts[which]
            pieces.append((done, n, sequence, offset))
            done += n
        return pieces


def packed(docs: DataFrame, vocabulary: str, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids (array of int). vocabulary is a file for the tokenizers library on the driver, sent to the executors once."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(vocabulary).read_text())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(definition.value), TaskContext.get().partitionId()
        seen, rows, windows = np.zeros(window, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                total, tail, number, tail_ids, full, before, full_ids = [], [], [], [], [], [], []
                every, off = tokens.encode(part.column("text"))
                for d in range(part.num_rows):
                    ids = np.append(every[off[d] : off[d + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // window
                    n = len(ids) - whole * window
                    total.append(len(ids))
                    tail.append(n)
                    number.append(int(seen[n]))
                    seen[n] += 1
                    full.append([zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(whole)])
                    before.append(windows)
                    windows += whole
                    full_ids.append(ids[: whole * window].tobytes() if with_ids else b"")
                    tail_ids.append(ids[whole * window :].astype("<u2" if ids.max() < 65536 else "<u4").tobytes())
                m = len(total)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(m, task, np.int64)), pa.array(np.arange(rows, rows + m)), pa.array(total, pa.int64()), pa.array(tail, pa.int32()), pa.array(number, pa.int64()), pa.array(tail_ids, pa.binary()), pa.array(full, pa.list_(pa.int64())), pa.array(before, pa.int64()), pa.array(full_ids, pa.binary())],
                    ["doc_id", "task", "row", "doc_tokens", "tail", "number", "tail_ids", "full", "windows", "full_ids"],
                )
                rows += m

    cut_schema = "doc_id bigint, task bigint, row bigint, doc_tokens bigint, tail int, number bigint, tail_ids binary, full array<bigint>, windows bigint, full_ids binary"
    tails = keep(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(cut, cut_schema), "tails")
    per_task = tails.groupBy("tail", "task").count()
    histogram = np.zeros(window, np.int64)
    for n, k in per_task.groupBy("tail").agg(F.sum("count")).collect():  # at most `window` rows
        histogram[n] = k
    histogram[0] = 0
    plan = spark.sparkContext.broadcast(Plan(histogram, window))
    before = F.sum("count").over(Window.partitionBy("tail").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranks = per_task.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("tail", "before"))).alias("before"))  # `window` entries at most
    own = tails.groupBy("task").agg(F.max(F.col("windows") + F.size("full")).alias("n"), F.floor(F.max("row") / DEAL).alias("deals"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a task
    offsets = ranks.join(own.select("task", "deals", first.alias("first")), "task").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals")))).select("task", "deal", "before", "first")
    ranked = tails.withColumn("deal", F.floor(F.col("row") / DEAL)).join(offsets, ["task", "deal"])
    ranked = ranked.withColumn("rank", F.col("number") + F.col("before")[F.col("tail")]).withColumn("windows", F.col("windows") + F.col("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        first_full = p.sequences + p.full_residual + len(p.cuts) - 1
        for batch in batches:
            out: list[tuple] = []
            for doc, total, n, rank, tail_ids, full, windows, full_ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "tail", "rank", "tail_ids", "full", "windows", "full_ids")), strict=True):
                for i, crc in enumerate(full):
                    sequence = first_full + windows + i  # full windows are numbered behind all others
                    ids = np.frombuffer(full_ids, "<u4")[i * window : (i + 1) * window].astype(np.int32) if with_ids else None
                    out.append((doc, i * window, window, crc, total, sequence, 0, ids))
                if n:
                    ids = np.frombuffer(tail_ids, "<u2" if len(tail_ids) == 2 * n else "<u4").astype("<u4")
                    for start, length, sequence, offset in p.place(n, rank):
                        own = ids[start : start + length]
                        out.append((doc, len(full) * window + start, length, zlib.crc32(own.tobytes()), total, sequence, offset, own.astype(np.int32) if with_ids else None))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(list(c), pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array(list(columns[7]), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return ranked.select("doc_id", "doc_tokens", "tail", "rank", "tail_ids", "full", "windows", "full_ids").mapInArrow(place, schema)
