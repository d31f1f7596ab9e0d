"""Quality classifier: a regularised quadratic discriminant on document statistics.

Each text gives FEATURES, made near normal by logarithms. Per class only the number of labelled rows and the sums of the features and of their products
are gathered (map-side, over all labelled rows, or about MOST_LABELS of them, as their doc_ids are broadcast); from these come means and covariances, shrunk towards their pooled diagonal, and
the Cholesky factors, which are made once and sent out. The score is the logistic of the difference of the two log densities
(Mahalanobis terms and log determinants) plus the log odds of the classes.

Defined results: null is the empty text, which is scored like any other (its statistics are zeros); a text of any length is measured whole. Rows of labels with a null quality
are ignored; if a doc_id has several labels the largest counts. Rows, also repeated ones and those without doc_id (which have no label), are each scored by their own text. If either
class has no labelled row, all scores are 0.5. An empty table gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm._bytes import Words, slices
from tessera.llm._tables import keep, rolled, unrolled

FEATURES = ["words", "word_length", "symbols", "upper", "digits", "spaces", "distinct", "top_run", "duplicate_lines", "line_words", "points", "calls", "bars", "short_words", "entropy", "repeated_pairs"]
SHRINKAGE = 0.15
MOST_LABELS = 1_000_000  # labels that are learnt from
CLIP = 6.0  # standard deviations of the training rows beyond which a statistic counts no further

_CLASSES = {
    "symbols": b"#*$%&|<>=~^_{}[]\\/@+",
    "upper": bytes(range(65, 91)),
    "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "digits": bytes(range(48, 58)),
    "spaces": bytes([32, *range(9, 14)]),
    "points": b".,;:",
    "calls": b"!?",
    "bars": b"|",
}
_LUT = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def _per_doc(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = Words(texts)
    n = np.diff(w.off).astype(float)
    count = {k: _per_doc(lut[w.data], w.off) for k, lut in _LUT.items()}
    words = np.diff(w.first).astype(float)
    size = (w.ends - w.starts).astype(float)
    edges = np.concatenate([[0.0], np.cumsum(size)])
    short = np.concatenate([[0.0], np.cumsum(size <= 3)])
    h = w.hashes()
    distinct, run, pairs, entropy, lines, duplicate = (np.zeros(w.docs) for _ in range(6))
    for d in range(w.docs):
        a, b = w.first[d], w.first[d + 1]
        part = w.data[w.off[d] : w.off[d + 1]]
        if b > a:
            own = h[a:b]
            _, each = np.unique(own, return_counts=True)
            distinct[d] = len(each)
            run[d] = np.count_nonzero(own[1:] == own[:-1])
            pairs[d] = len(own) - 1 - len(np.unique(own[1:] * np.uint64(31) + own[:-1]))
            p = np.bincount(part, minlength=256)
            p = p[p > 0] / len(part)
            entropy[d] = -(p * np.log2(p)).sum()
        rows = [x for x in part.tobytes().split(b"\n") if x.strip()]
        lines[d] = len(rows)
        duplicate[d] = len(rows) - len(set(rows))
    # each share is drawn towards a usual one by PRIOR units, so that short texts don't look extreme
    share = lambda x, y, usual, prior: np.log((x + usual * prior) / (y + prior))
    chars, some, few = 60, 12, 6
    short_of = short[w.first[1:]] - short[w.first[:-1]]
    return np.column_stack(
        [
            np.log1p(words),
            np.log((edges[w.first[1:]] - edges[w.first[:-1]] + 5 * some) / (words + some)),
            share(count["symbols"], n, 0.005, chars),
            share(count["upper"], count["letters"], 0.04, chars),
            share(count["digits"], n, 0.005, chars),
            share(count["spaces"], n, 0.15, chars),
            share(distinct, words, 0.8, some),
            share(run, words, 0.01, some),
            share(duplicate, lines, 0.02, few),
            np.log((words + 15 * few) / (lines + few)),
            share(count["points"], words, 0.15, some),
            share(count["calls"], words, 0.01, some),
            share(count["bars"], words, 0.01, some),
            share(short_of, words, 0.4, some),
            (entropy * n + 4.1 * chars) / (n + chars),
            share(np.maximum(pairs, 0), words, 0.02, some),
        ]
    )


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), np.ascontiguousarray(x).ravel())


def features(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, features (array of double) and some columns more of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(c) for c in more], _arrays(statistics(part.column("text")))], ["doc_id", *more, "features"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema[c] for c in ("doc_id", *more)] + StructType.fromDDL("features array<double>").fields))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class the number of rows, the sum of the features and the sum of their products. Each task sends one row for each class and batch."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, d)
            y = batch.column("y").to_numpy()
            for c, own in total.items():
                z = x[y == c]
                own += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        for c, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["y", "k", "v"])

    sums = labelled.mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    out = {}
    for c in (0, 1):
        own = np.zeros(1 + d + d * d)
        for r in sums:
            if r.y == c:
                own[r.k] = r.v
        out[c] = (own[0], own[1 : 1 + d], own[1 + d :].reshape(d, d))
    return out


class Discriminant:
    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        self.trained = all(sums[c][0] > 0 for c in (0, 1))
        if not self.trained:
            return
        n = sum(sums[c][0] for c in (0, 1))
        self.center = sum(sums[c][1] for c in (0, 1)) / n
        square = sum(sums[c][2] for c in (0, 1)) / n - np.outer(self.center, self.center)
        self.scale = np.sqrt(np.maximum(np.diag(square), 1e-6))
        self.odds = float(np.log(sums[1][0] / sums[0][0]))
        self.mean, self.root, self.log_det = {}, {}, {}
        for c in (0, 1):
            m, first, second = sums[c]
            mean = (first / m - self.center) / self.scale
            cov = (second / m - np.outer(first / m, first / m)) / np.outer(self.scale, self.scale)
            weight = max(shrinkage, min(1.0, len(mean) / (m + 1)))
            cov = (1 - weight) * cov + weight * np.diag(0.5 * np.maximum(np.diag(cov), 0.0) + 0.5)
            self.mean[c] = mean
            factor = np.linalg.cholesky(cov + 1e-6 * np.eye(len(mean)))
            self.root[c] = np.linalg.inv(factor)
            self.log_det[c] = 2 * float(np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        density = {c: -0.5 * ((((z - self.mean[c]) @ self.root[c].T) ** 2).sum(axis=1) + self.log_det[c]) for c in (0, 1)}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -700, 700)))


def known(labels: DataFrame, held_out: str) -> DataFrame:
    """doc_id and y of the labels that held_out leaves; where there are more than MOST_LABELS, about so many, chosen by a hash."""
    all_of = labels.where("quality is not null and doc_id is not null").selectExpr("cast(doc_id as bigint) doc_id", "cast(quality as int) q").where(f"not ({held_out})").groupBy("doc_id").agg(F.max("q").alias("y"))
    n = all_of.count()
    return all_of if n <= MOST_LABELS else all_of.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MOST_LABELS / n))


HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def scored(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, learnt from the labelled rows that held_out leaves."""
    table = keep(features(docs), "features")
    train = table.join(F.broadcast(known(labels, held_out)), "doc_id")  # MOST_LABELS rows
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(moments(train.select("features", "y"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            s = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "features").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, held_out: str = HELD_OUT) -> DataFrame:
    """The rows of docs that are not rejected, with docs' own columns; each row is judged by its own text, in one pass without a join."""
    rows = rolled(docs)
    train = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known(labels, held_out)), "doc_id")  # MOST_LABELS rows
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(moments(features(train, "y").select("features", "y"))))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.value.score(statistics(part.column("text"))) >= 0.5))

    return unrolled(rows.mapInArrow(good, rows.schema), docs)
