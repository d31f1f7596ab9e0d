"""LM scoring with a log-bilinear neural model.

The model predicts a token from the two before it. The context vector is the sum of two position-wise embeddings. A token is predicted in two steps, its class and then
the word in the class; each score is the product of the context vector with an output vector plus a bias. The vocabulary that has vectors of its own grows with the training
tokens: the most frequent words, one for each TOKENS_A_WORD tokens (LEAST_WORDS at least, HEAD at most). The most frequent SINGLES of them and the
text's end are classes by themselves; the others are sorted by their endings and cut into groups of about the square root of their number, so that both softmaxes stay small. All other
words, as contexts and as targets, are one of BUCKETS classes by their last two bytes; inside such a class a word has its smoothed training frequency. So every word, also one never
seen, has a probability and all of them sum to one.

The parameters are learnt by noise-contrastive estimation on both levels, with noise from the frequencies of the classes and of the words in a group (the biases start at their logarithms). The training rows are dealt to
ROUNDS by a hash; in each, all tasks start from the same parameters and speeds and make one pass over their rows of it. What they changed is averaged row by row, weighted by how often the tasks met the row. The more tasks a pass is
dealt to, the shorter each one's way, so the mean of a row that m tasks met alike is taken m^POWER times; the power is the one of POWERS with which a bounded sample of training texts (about SAMPLE tokens) becomes likeliest, in each round anew
(0 is the mean, 1 would be the sum). So what is learnt grows with the data, however many tasks there are. Tasks
that learn are as many as have TOKENS_A_TASK tokens each, and twice the cores at most. The parameters, and with them score (but none of the counts), still depend a little on how the input is split into tasks.
Scores are normalised by batched matrix products on the executors.

Word counts are taken over all training rows. The HEAD most frequent words (ties by a hash) and the end go to the executors as a table, a size fixed by the parameter; the counts
of all other words are joined to the tokens that need them. No count depends on HEAD.

Defined results: null and empty texts have the one end token. A null doc_id is never held out. Rows, also repeated ones, are scored each on its own, whole, whatever their length. Without training rows N and V are 0 and
the parameters stay as they start. An empty table gives none."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import slices
from tessera.llm._tables import keep

HEAD = 200_000
TOKENS_A_WORD = 3000
LEAST_WORDS = 1000
SINGLES = 63
BUCKETS = 64
DIM = 16
NOISE = 16
GROUP_NOISE = 16
MINIBATCH = 2048
RATE = 0.08
SMOOTH = 0.1
END = b" "  # no word holds a space
FLUSH = 300_000  # distinct words a task counts before it sends them on
ROUNDS = (1, 2, 5)  # shares of the training rows
POWERS = (0.0, 0.125, 0.25, 0.375, 0.5)
TOKENS_A_TASK = 2_000_000  # at least, of those that learn at once
SAMPLE = 60_000  # training tokens, about, on which the powers are compared
TIES = 4096  # parts by hash of the words at the edge of the head
BLOCK = 1024  # rows of parameters that are averaged together
TOGETHER = 64  # tasks whose changes to a block are averaged at once


def buckets_of(words: list[bytes] | pa.Array) -> np.ndarray:
    """Each word's bucket: by 31 and 7 times its last two bytes plus 2, or 31 times its only byte plus 1."""
    _, offsets, data = pa.array(words, pa.large_binary()).buffers() if isinstance(words, list) else pc.take(words, pa.array(np.arange(len(words)))).cast(pa.large_binary()).buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(words) + 1]
    data = np.frombuffer(data if data is not None and len(data) else b"\0", np.uint8).astype(np.int64)
    long = np.diff(ends) > 1
    last = ends[1:] - 1
    return (np.where(long, data[np.maximum(last - 1, 0)], data[last]) * 31 + np.where(long, data[last] * 7 + 2, 1)) % BUCKETS


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary) and c: how often each token occurs; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                seen[END] += len(texts)
                for text in texts:
                    seen.update((text or "").encode().lower().split())
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head's words with their counts, the class, context row and place in a group of each, and each bucket's number of tokens and words.

    Classes are, in this order, SINGLES words, the end, the buckets, and the groups. Rows of contexts are the words with vectors, the end, and the buckets."""

    def __init__(self, head: list[tuple[bytes, int]], buckets: dict[int, tuple[int, int]], tokens: int, words: int):
        """head: words by falling count, the end among them; buckets: tokens and words of all words but the end."""
        self.tokens, self.words = tokens, words
        self.count = np.array([c for _, c in head], np.int64)
        self.at = {w: i for i, (w, _) in enumerate(head)}
        self.head = pa.array([w for w, _ in head], pa.binary())
        most = min(HEAD, max(LEAST_WORDS, tokens // TOKENS_A_WORD))
        own = [(w, c) for w, c in head if w != END][:most]
        grouped = sorted(own[SINGLES:], key=lambda x: x[0][::-1])
        self.singles = min(SINGLES, len(own))
        size = max(16, int(1.5 * len(grouped) ** 0.5))
        many = -(-len(grouped) // size)
        self.edges = np.minimum(np.arange(many + 1) * size, len(grouped))  # places of each group
        self.end_class, self.first_bucket, self.first_group = SINGLES, SINGLES + 1, SINGLES + 1 + BUCKETS
        self.classes, self.rows = self.first_group + many, len(own) + 1 + BUCKETS
        self.end_row = len(own)
        place = {w: i for i, (w, _) in enumerate(grouped)}
        row = {w: i for i, (w, _) in enumerate(own)}
        n = len(head)
        in_bucket = buckets_of([w for w, _ in head]).tolist()
        # the last entry of each stands for words that are not in the head, and is replaced
        self.class_of, self.row_of, self.place_of = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        for i, (w, _) in enumerate(head):
            if w == END:
                self.class_of[i], self.row_of[i] = self.end_class, self.end_row
            elif w not in row:
                self.class_of[i], self.row_of[i] = self.first_bucket + in_bucket[i], self.end_row + 1 + in_bucket[i]
            else:
                self.row_of[i] = row[w]
                p = place.get(w)
                self.class_of[i] = row[w] if p is None else self.first_group + p // size
                self.place_of[i] = -1 if p is None else p
        self.place_count = np.array([c for _, c in grouped], np.float64)
        rest = {b: list(buckets.get(b, (0, 0))) for b in range(BUCKETS)}
        for w, c in own:
            b = in_bucket[self.at[w]]
            rest[b] = [rest[b][0] - c, rest[b][1] - 1]
        self.mass = np.zeros(self.classes)  # training tokens of each class
        np.add.at(self.mass, self.class_of[:n], self.count)
        self.inner = np.zeros(self.classes)
        for b, (t, v) in rest.items():
            self.mass[self.first_bucket + b] = t
            self.inner[self.first_bucket + b] = t + SMOOTH * (v + 1)

    def look_up(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head (-1: not there), class and context row of each word."""
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words
        at = pc.fill_null(pc.index_in(words, self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        classes, rows = self.class_of[at], self.row_of[at]
        tail = np.flatnonzero(at < 0)
        b = buckets_of(words.take(pa.array(tail)))
        classes[tail], rows[tail] = self.first_bucket + b, self.end_row + 1 + b
        return at, classes, rows


def vocabulary(counts: DataFrame) -> Vocabulary:
    # the rule of buckets_of(), on the last two bytes
    byte = lambda at: F.conv(F.hex(F.expr(f"substring(word, greatest(length(word) - 1, 1) + {at}, 1)")), 16, 10).cast("long")
    k = (byte(0) * 31 + F.coalesce(F.when(F.length("word") > 1, byte(1)), F.lit(0)) * 7 + F.least(F.length("word"), F.lit(2))) % BUCKETS
    k = F.when(F.col("word") == F.lit(END), F.lit(-1)).otherwise(k)
    buckets = {r.k: (r.n, r.v) for r in counts.groupBy(k.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens, words = (sum(x[i] for x in buckets.values()) for i in (0, 1))
    # the least step of a logarithmic scale of counts from which on there are at most HEAD words, and of the step below as many parts by a hash as still fit
    step, tie = F.floor(64 * F.log2("c")), F.pmod(F.xxhash64("word"), F.lit(TIES))
    rest = counts.where(F.col("word") != F.lit(END))
    room, least, edge, parts = HEAD, None, None, 0
    for r in sorted(rest.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        if r["count"] > room:
            edge = r.s
            break
        room, least = room - r["count"], r.s
    if edge is not None:
        sizes = {r.t: r["count"] for r in rest.where(step == edge).groupBy(tie.alias("t")).count().collect()}
        while parts < TIES and sizes.get(parts, 0) <= room:
            room -= sizes.get(parts, 0)
            parts += 1
    taken = F.col("word") == F.lit(END)
    if least is not None:
        taken = taken | (step >= least)
    if parts:
        taken = taken | ((step == edge) & (tie < parts))
    head = sorted(((bytes(r.word), r.c) for r in counts.where(taken).collect()), key=lambda x: (-x[1], x[0]))  # HEAD + 1 rows at most
    return Vocabulary(head, buckets, tokens, words)


def _sums(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that occur, the sum of the gradients of each, and how often it occurs."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    if len(rows) and int(rows.max()) >> 16:
        order = order.take(np.argsort((rows.take(order) >> 16).astype(np.uint16), kind="stable"))
    ordered = rows.take(order)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(gradient.take(order, axis=0), starts, axis=0), np.diff(np.append(starts, len(rows)))


def packed(change: np.ndarray) -> bytes:
    """Rows of changes in a byte each: 127ths of the row's largest one, which comes before them."""
    top = np.maximum(np.abs(change).max(axis=1, keepdims=True), 1e-8).astype(np.float32)
    return np.hstack([top.view(np.int8), np.round(change / top * 127).astype(np.int8)]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.frombuffer(data, np.int8).reshape(-1, 4 + DIM + 1)
    return wide[:, 4:] * (np.ascontiguousarray(wide[:, :4]).view(np.float32) / 127)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Step:
    """What the tasks of a round changed together in a block of rows: which parameters, the rows, their mean change, by how many tasks they were met (less where some met them far more often than others), and the mean of
    what was added to their speeds."""

    def __init__(self, block: int, rows: bytes, met: bytes, square: bytes, gain: bytes, change: bytes):
        self.which = block >> 24
        self.at = (block & 0xFFFFFF) * BLOCK + np.frombuffer(rows, np.int16).astype(np.int64)
        met, square = np.frombuffer(met, np.float32).astype(float), np.frombuffer(square, np.float32).astype(float)
        self.tasks = np.maximum(met * met / square, 1.0)
        self.gain, self.change = np.frombuffer(gain, np.float32).reshape(-1, 2), unpacked(change)


def together(blocks: Iterator[tuple[bytes, bytes, bytes, bytes, bytes]]) -> dict:
    """The changes of several tasks, or of several groups of them, to one block of rows as one."""
    met, square, gain, total = np.zeros(BLOCK), np.zeros(BLOCK), np.zeros((BLOCK, 2)), np.zeros((BLOCK, DIM + 1))
    for rows, often, squares, gained, change in blocks:
        at, w = np.frombuffer(rows, np.int16), np.frombuffer(often, np.float32).astype(float)
        met[at] += w
        square[at] += np.frombuffer(squares, np.float32)
        gain[at] += w[:, None] * np.frombuffer(gained, np.float32).reshape(-1, 2)
        total[at] += w[:, None] * unpacked(change)
    at = np.flatnonzero(met)
    raw = lambda x: x.astype(np.float32).tobytes()
    return {"rows": at.astype(np.int16).tobytes(), "met": raw(met[at]), "square": raw(square[at]), "gain": raw(gain[at] / met[at, None]), "change": packed(total[at] / met[at, None])}


class Model:
    """Position-wise context embeddings, and output vectors of classes and of the words in groups. The last column of outputs is a bias; that of contexts is fixed, so that they add up to 1 there."""

    def __init__(self, v: Vocabulary):
        rng = np.random.Generator(np.random.PCG64(11))
        self.edges = v.edges
        inside = v.place_count + SMOOTH
        whole = np.add.reduceat(inside, v.edges[:-1]) if len(inside) else inside
        shares = [(v.mass + SMOOTH) / (v.mass + SMOOTH).sum(), inside / np.repeat(whole, np.diff(v.edges))]
        self.share = {2: shares[0], 3: shares[1]}  # of classes among all, and of words in their groups
        self.parts = [(0.1 * rng.standard_normal((n, DIM + 1))).astype(np.float32) for n in (v.rows, v.rows, v.classes, len(inside))]
        for p, last in zip(self.parts, (1.0, 0.0, np.log(shares[0]), np.log(shares[1])), strict=True):
            p[:, DIM] = last

        self.speed = [np.full((len(p), 2), 1e-2, np.float32) for p in self.parts]  # squared gradients of vectors and of biases so far

    def begin(self) -> None:
        """Make ready for learning: the start, and how often each row was met."""
        self.start = [p.copy() for p in self.parts]
        self.first_speed = [s.copy() for s in self.speed]
        self.met = [np.zeros(len(p), np.float32) for p in self.parts]
        self.offset = {k: np.log(n * self.share[k]).astype(np.float32) for k, n in ((2, NOISE), (3, GROUP_NOISE))}

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = self.parts[0].take(one, axis=0)
        out += self.parts[1].take(two, axis=0)
        return out

    def learn(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray, places: np.ndarray, rng: np.random.Generator) -> None:
        """Noise-contrastive estimation over some tokens: the classes in minibatches, then the words of each group."""
        order = rng.permutation(len(classes))
        for at in range(0, len(order), MINIBATCH):
            some = order[at : at + MINIBATCH]
            noise = rng.choice(len(self.share[2]), NOISE, p=self.share[2])
            self._contexts(one[some], two[some], self._against(2, self.context(one[some], two[some]), classes[some], noise))
        held, waiting = [], 0
        for low, high, some in self._by_group(places):
            noise = low + rng.choice(high - low, GROUP_NOISE, p=self.share[3][low:high])
            held.append((some, self._against(3, self.context(one[some], two[some]), places[some], noise)))
            waiting += len(some)
            if waiting >= MINIBATCH:
                self._all_contexts(held, one, two)
                held, waiting = [], 0
        self._all_contexts(held, one, two)

    def _by_group(self, places: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each group that occurs its first place, the one behind its last, and which tokens are in it."""
        own = np.flatnonzero(places >= 0)
        own = own[np.argsort(places[own])]
        bounds = np.searchsorted(places[own], self.edges)
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            yield int(self.edges[g]), int(self.edges[g + 1]), own[bounds[g] : bounds[g + 1]]

    def _all_contexts(self, held: list, one: np.ndarray, two: np.ndarray) -> None:
        if held:
            some = np.concatenate([x[0] for x in held])
            self._contexts(one[some], two[some], np.concatenate([x[1] for x in held]))

    def _contexts(self, one: np.ndarray, two: np.ndarray, slope: np.ndarray) -> None:
        slope[:, DIM] = 0
        self._step(0, one, slope)
        self._step(1, two, slope)

    def _against(self, which: int, context: np.ndarray, token: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """One step of the output vectors: the tokens against noise that they share; returns the slope for the contexts."""
        own, other, offset = self.parts[which].take(token, axis=0), self.parts[which][noise], self.offset[which]
        g_own = 1 - _sigmoid(_products(context, own) - offset[token])
        g_other = -_sigmoid(context @ other.T - offset[noise])
        own *= g_own[:, None]
        slope = g_other @ other
        slope += own
        self._step(which, np.concatenate([token, noise.astype(token.dtype)]), np.concatenate([g_own[:, None] * context, g_other.T @ context]))
        return slope

    def _step(self, which: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Adagrad with one speed a vector and one a bias, over the summed gradient of each row."""
        at, total, often = _sums(rows, gradient)
        speed = self.speed[which].take(at, axis=0)
        speed[:, 0] += _products(total[:, :DIM], total[:, :DIM]) / DIM
        speed[:, 1] += total[:, DIM] ** 2
        self.speed[which][at] = speed
        pace = RATE / np.sqrt(speed)
        total[:, :DIM] *= pace[:, :1]
        total[:, DIM] *= pace[:, 1]
        self.parts[which][at] += total
        self.met[which][at] += often

    def changes(self) -> Iterator[dict]:
        """For each block of rows its number, the rows in it that were met, how often, what was added to their speeds, and what changed."""
        for which, p in enumerate(self.parts):
            for low in range(0, len(p), BLOCK):
                rows = np.flatnonzero(self.met[which][low : low + BLOCK])
                if len(rows):
                    met = self.met[which][low + rows]
                    gain = self.speed[which][low + rows] - self.first_speed[which][low + rows]
                    yield {"block": which << 24 | low // BLOCK, "rows": rows.astype(np.int16).tobytes(), "met": met.tobytes(), "square": (met * met).tobytes(), "gain": gain.tobytes(), "change": packed(p[low + rows] - self.start[which][low + rows])}

    def moved(self, steps: list["Step"], power: float) -> "Model":
        """A model whose rows went m^power times their mean change, where m tasks met them."""
        out = copy(self)
        out.parts = [p.copy() for p in self.parts]
        for s in steps:
            out.parts[s.which][s.at] += (s.change * (s.tasks**power)[:, None]).astype(np.float32)
        return out

    def cost(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray, places: np.ndarray) -> float:
        return -float(self.log_probability(one, two, classes, places).sum())

    def log_probability(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of each token's class and, in groups, of the word. Sums over all classes, or all words of a group, are taken once for each distinct context."""
        pair, which = np.unique(one.astype(np.int64) * len(self.parts[1]) + two, return_inverse=True)
        context = self.context(pair // len(self.parts[1]), pair % len(self.parts[1]))
        out = _scores(context, which, self.parts[2], classes) - _log_sums(context, self.parts[2])[which]
        for low, high, own in self._by_group(places):
            seen, at = np.unique(which[own], return_inverse=True)
            near, vectors = context.take(seen, axis=0), self.parts[3][low:high]
            out[own] += _scores(near, at, vectors, places[own] - low) - _log_sums(near, vectors)[at]
        return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _scores(context: np.ndarray, which: np.ndarray, vectors: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The score of each token in the context that it stands in."""
    out = np.empty(len(token))
    for at in range(0, len(token), 16384):
        part = slice(at, at + 16384)
        out[part] = _products(context.take(which[part], axis=0), vectors.take(token[part], axis=0))
    return out


def _log_sums(context: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each context the logarithm of the summed exponentials of its scores with all vectors."""
    out, ones, longest = np.empty(len(context)), np.ones(len(vectors), np.float32), float(_products(vectors, vectors).max())
    turned = np.ascontiguousarray(vectors.T)
    for at in range(0, len(context), 2048):
        part = context[at : at + 2048]
        scores, top = part @ turned, 0.0
        if float(_products(part, part).max()) * longest > 3600:  # a score may exceed 60
            top = scores.max(axis=1, keepdims=True)
            scores -= top
            top = top[:, 0].astype(float)
        out[at : at + 2048] = top + np.log((np.exp(scores, out=scores) @ ones).astype(float))
    return out


def contexts(rows: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context row before each token and the one before that; texts are separate, and begin as after an end."""
    n = len(rows)
    starts = np.cumsum(lengths) - lengths
    one, two = np.full(n, start, rows.dtype), np.full(n, start, rows.dtype)
    one[1:] = rows[:-1]
    two[2:] = rows[:-2]
    one[starts] = start
    two[starts] = start
    two[starts[lengths > 1] + 1] = start
    return one, two


def _tokens(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of some texts (binary, the end last), which of them stands at each place of all texts, one after the other, and each text's number of tokens, its end counted."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column("text"), "")))  # both work on bytes, as words do
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    own = coded.indices.to_numpy(zero_copy_only=False)
    held = np.ones(len(own), bool)
    empty = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:  # beside leading and trailing separators stands an empty string
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
        held, own = own != empty, own - (own > empty)
    words = pa.concat_arrays([words, pa.array([END], pa.binary())])
    upto = np.concatenate([[0], np.cumsum(held)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    lengths = np.diff(upto) + 1
    codes = np.full(int(lengths.sum()), len(words) - 1, np.int64)
    word = np.ones(len(codes), bool)
    word[np.cumsum(lengths) - 1] = False
    codes[word] = own[held]
    return words, codes, lengths


LEARNT = {"block": "int", "rows": "binary", "met": "binary", "square": "binary", "gain": "binary", "change": "binary"}


def inputs(v: Vocabulary, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both contexts, class and place in a group of each token of some texts."""
    words, codes, lengths = _tokens(part)
    at, classes, rows = (x[codes] for x in v.look_up(words))
    return *contexts(rows, lengths, v.end_row), classes, v.place_of[at]


def follow(model: Model, steps: list[Step], some: tuple[np.ndarray, ...]) -> Model:
    """The model moved by the steps of a round, with the power that makes the sample likeliest."""
    best = min((model.moved(steps, p) for p in POWERS), key=lambda m: m.cost(*some)) if len(some[0]) else model.moved(steps, 0.0)
    best.speed = [s.copy() for s in model.speed]
    for s in steps:
        best.speed[s.which][s.at] += s.gain
    return best


def train_model(train: DataFrame, vocab) -> Model:
    """The start, moved round by round by what the tasks learn.

    As tasks are bounded by the cores, what they send doesn't grow with the input; blocks of rows are averaged in two steps where there are more than TOGETHER of them, so no task gathers those of all others at once."""
    model = Model(vocab.value)
    tokens = vocab.value.tokens
    if not tokens:
        return model
    context = train.sparkSession.sparkContext
    drawn = F.pmod(F.xxhash64("text", "doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / tokens))
    some = inputs(vocab.value, pa.RecordBatch.from_arrays([train.where(drawn).select("text").toArrow().column("text").combine_chunks()], ["text"]))  # about SAMPLE tokens
    kinds = ", ".join(f"{c} {k}" for c, k in LEARNT.items())
    tasks = max(1, min(2 * context.defaultParallelism, tokens // TOKENS_A_TASK))
    parts = -(-tasks // TOGETHER)  # of tasks whose changes are averaged first
    turn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(sum(ROUNDS)))
    for number, share in enumerate(ROUNDS):
        low = sum(ROUNDS[:number])
        sent = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            v, own, rng, seen = vocab.value, copy(sent.value), np.random.Generator(np.random.PCG64(5 + number)), 0
            own.parts, own.speed = [p.copy() for p in own.parts], [s.copy() for s in own.speed]
            own.begin()
            for batch in batches:
                for part in slices(batch, "text"):
                    one, two, classes, places = inputs(v, part)
                    own.learn(one, two, classes, places, rng)
                    seen += len(classes)
            if seen:
                part_number = TaskContext.get().partitionId() % parts
                for change in own.changes():
                    yield pa.RecordBatch.from_pylist([change | {"part": part_number}], schema=pa.schema([("part", pa.int32()), *[(c, pa.int32() if k == "int" else pa.binary()) for c, k in LEARNT.items()]]))

        def average(t: pa.Table) -> pa.Table:
            columns = [t.column(c).to_pylist() for c in LEARNT if c != "block"]
            mean = together(zip(*columns, strict=True))
            return pa.table({"block": t.column("block")[:1]} | {c: pa.array([x], pa.binary()) for c, x in mean.items()})

        rows = train.where((turn >= low) & (turn < low + share)).select("text").coalesce(tasks)
        learnt = rows.mapInArrow(run, f"part int, {kinds}")
        if parts > 1:
            learnt = learnt.groupBy("block", "part").applyInArrow(average, kinds)
        learnt = learnt.groupBy("block").applyInArrow(average, kinds)
        steps = [Step(r.block, *(bytes(r[c]) for c in LEARNT if c != "block")) for r in learnt.select(*LEARNT).collect()]  # one row a block; their number is bounded by HEAD
        model = follow(model, steps, some)
        sent.destroy()
    return model


def scored(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 10 = 0") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    train = rows.where("not held_out")
    counts = keep(word_counts(train), "counts")
    vocab = spark.sparkContext.broadcast(vocabulary(counts))
    learnt = spark.sparkContext.broadcast(train_model(train, vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = vocab.value, learnt.value
        base = np.append(np.log10(v.count + SMOOTH), 0.0)
        inner = np.log10(np.where(v.inner > 0, v.inner, 1.0))
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, lengths = _tokens(part)
                at, classes, context_rows = (x[codes] for x in v.look_up(words))
                one, two = contexts(context_rows, lengths, v.end_row)
                p = model.log_probability(one, two, classes, v.place_of[at]) / np.log(10)
                known = at >= 0
                c = base[at]  # 0 for words that aren't in the head
                p += np.where((classes >= v.first_bucket) & (classes < v.first_group), c - inner[classes], 0.0)
                starts = np.cumsum(lengths) - lengths
                tail = np.flatnonzero(~known)
                text_of = np.repeat(np.arange(len(lengths)), lengths)[tail]
                each, times = np.unique(text_of * len(words) + codes[tail], return_counts=True)  # each text's words that aren't in the head
                many = pa.array(np.searchsorted(each, np.arange(len(lengths) + 1) * len(words)), pa.int32())
                own = [pa.ListArray.from_arrays(many, x) for x in (words.take(pa.array(each % len(words))), pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lengths), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(c, starts)), pa.array(np.add.reduceat(p, starts)), *own],
                    ["doc_id", "held_out", "n_tokens", "n_head", "head_base", "head_score", "word", "k"],
                )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_head bigint, head_base double, head_score double, word array<binary>, k array<bigint>"
    partly = keep(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "partly")
    # the counts of words that aren't in the head: one row for each text and word, joined to the words' counts
    needed = partly.select("row", F.explode(F.arrays_zip("word", "k")).alias("t")).select("row", "t.word", "t.k")
    rest = needed.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k"))).alias("n"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("s"))
    n, v = vocab.value.tokens, vocab.value.words
    space = float(np.log10(n + SMOOTH * (v + 1)))
    more = F.coalesce("s", F.lit(0.0))
    return partly.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("head_base") + more - F.col("n_tokens") * space).alias("base_score"),
        (F.col("head_score") + more).alias("score"),
    )
