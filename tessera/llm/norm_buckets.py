"""Hard negatives by a norm-bucketed search for the largest inner products.

Components become integers (floor of SCALE times the component), so scores are exact. Candidates are sorted by norm into levels (quantiles of the norm, at most LEVELS), and a level's rows are dealt by a hash to cells of about PART
rows, however many rows have the same norm. Inside a cell rows lie in blocks by descending norm.

By Cauchy and Schwarz no score of a block exceeds the anchor's norm times the block's largest one. For each anchor and window of scores the search holds the window's lower limit and the k-th best score so far; a block, or a whole
level, whose bound is below both is left out, and so is all that follows, as norms only fall. Levels are searched from the largest norms on, always
GROWTH times as many as before, with the k-th best scores of all that came before. Vectors of nearly the same norm can't be left out,
then every anchor meets every candidate, in blocks.

First each anchor's positives are looked for, in one window without limits among rows of its label; then, in one window for each positive, its negatives among rows of other labels.

Anchors meet a cell in chunks of about ASKED; candidates are copied for each chunk. What is sent to the driver are quantiles, counts and largest norms of the levels.

Defined results: rows with a null vec_id, a null label or vector, or a null or non-finite component take no part; neither do vectors of another length than most (the shorter of two that are as many) and those whose norm reaches 2^31 after scaling, whose scores
needn't fit a long. Of rows that share a vec_id one counts: the one with the smallest label, then vector. Other columns aren't read. An anchor without other rows of its label has no rows, and neither has a positive with a score below 0, whose
window is empty. An empty table gives no rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import ragged
from tessera.llm._native import count_below
from tessera.llm._tables import forget, keep

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
LEVELS = 1024
PART = (1024, 8192)  # rows of a cell, between these; a 64th of all rows where that is between
BLOCK = 1024
ASKED = 8192
GROWTH = 4  # times the levels so far are searched together next
NO_LIMIT = 1 << 62
SLACK = 1 + 1e-9  # of a bound, for rounding


def _matrix(column: pa.ChunkedArray, exact: bool) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float if exact else np.int64)


def best(x: np.ndarray, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, a_norms: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window, id and score of the k best candidates of each window: first[i]:first[i + 1] are the windows of anchor i, with the limits low and high and the k-th best score known so far (or less than any).

    Candidates have the anchor's label (and aren't the anchor itself) if same, another one if not."""
    order = np.lexsort((ids, -norms))
    x, ids, labels, norms = x[order], ids[order], labels[order], norms[order]
    owner = np.repeat(np.arange(len(a)), np.diff(first))
    kth = np.maximum(low, kth)  # from here on, what a candidate must reach
    have_w, have_id, have_s = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(x), BLOCK):
        need = np.full(len(a), NO_LIMIT)
        np.minimum.at(need, owner, kth)
        active = np.flatnonzero((first[1:] > first[:-1]) & (a_norms * norms[at] * SLACK >= need))
        if not len(active):
            break
        some = slice(at, at + BLOCK)
        s = a[active] @ x[some].T
        ok = s >= need[active][:, None]
        ok &= (a_labels[active][:, None] == labels[some][None, :]) == same
        if same:
            ok &= a_ids[active][:, None] != ids[some][None, :]
        row, col = np.nonzero(ok)
        score = s[row, col].astype(np.int64)
        many = np.diff(first)[active[row]]
        w = ragged(first[active[row]], many)
        score, own = np.repeat(score, many), np.repeat(ids[some][col], many)
        ok = (score >= kth[w]) & (score <= high[w])
        have_w, have_s, have_id = np.concatenate([have_w, w[ok]]), np.concatenate([have_s, score[ok]]), np.concatenate([have_id, own[ok]])
        by = np.lexsort((have_id, -have_s, have_w))
        have_w, have_s, have_id = have_w[by], have_s[by], have_id[by]
        rank = np.arange(len(by)) - np.searchsorted(have_w, have_w)
        full = rank == k - 1
        kth[have_w[full]] = np.maximum(kth[have_w[full]], have_s[full])
        have_w, have_s, have_id = have_w[rank < k], have_s[rank < k], have_id[rank < k]
    return have_w, have_id, have_s


class Buckets:
    """Candidates by level and cell."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id, label, q (integers), norm."""
        n = rows.count()
        part = min(max(n // 64, PART[0]), PART[1])
        wanted = min(LEVELS, max(1, n // part))
        edges: list[float] = []
        if wanted > 1:
            cuts = F.percentile_approx("norm", [i / wanted for i in range(1, wanted)], 10_000)
            edges = sorted(set(rows.agg(cuts.alias("e")).head().e))
        level = F.lit(len(edges)) - (count_below(F.array(*map(F.lit, edges)), F.col("norm"), True) if edges else F.lit(0))
        rows = rows.withColumn("level", level.cast("int"))
        sizes = rows.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy("level").collect()
        self.tops = [s.top for s in sizes]  # by descending norm
        tasks = [math.ceil(s.n / part) for s in sizes]
        self.cells = np.concatenate([[0], np.cumsum(tasks)]).tolist()  # the first cell of each level, and their number
        first, many = dict(zip([s.level for s in sizes], self.cells, strict=False)), dict(zip([s.level for s in sizes], tasks, strict=True))
        starts, deal = (F.array(*[F.lit(x.get(i, 1)) for i in range(len(edges) + 1)]) for x in (first, many))
        self.rows = rows.withColumn("cell", (F.get(starts, F.col("level")) + F.pmod(F.xxhash64("vec_id"), F.get(deal, F.col("level")))).cast("int")).drop("level")

    def search(self, asked: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """anchor_id, w, vec_id, score: the k best candidates for each window of asked (anchor_id, label, q, norm, low, high: arrays with a number for each window), by descending score, then vec_id."""
        rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
        number, got, end = asked.count(), None, 0
        while end < len(self.tops):
            first, end = end, min(max(1, GROWTH * end), len(self.tops))
            known = F.transform("low", lambda _: F.lit(-NO_LIMIT).cast("bigint"))
            ready = asked.withColumn("kth", known)
            if got is not None:
                full = got.where(f"place = {k}").groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
                ready = asked.join(full, "anchor_id", "left").withColumn("kth", F.transform("low", lambda _, i: F.coalesce(F.col("known")[i], F.lit(-NO_LIMIT).cast("bigint")))).drop("known")
            found = self._meet(ready, number, first, end, k, same)
            found = found if got is None else got.drop("place").union(found)
            before, got = got, keep(found.withColumn("place", rank).where(f"place <= {k}"), name)
            if before is not None:
                forget(before)
        return got.drop("place")

    def _reached(self) -> Column:
        """How many levels can hold scores that an anchor still needs."""
        need = F.array_min(F.zip_with("low", "kth", lambda a, b: F.greatest(a, b)))
        tops = F.array(*[F.lit(float(t)) for t in reversed(self.tops)])
        return F.when(need > 0, F.lit(len(self.tops)) - count_below(tops, need / (F.col("norm") * SLACK), False)).otherwise(F.lit(len(self.tops)))

    def _meet(self, asked: DataFrame, number: int, first: int, end: int, k: int, same: bool) -> DataFrame:
        copies = max(1, math.ceil(number / ASKED))
        starts = F.array(*map(F.lit, self.cells))
        last = F.get(starts, F.least(self._reached(), F.lit(end)).cast("int"))
        asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own: asked may come from the same table as the candidates
        right = asked.where(F.size("low") > 0).withColumn("last", last).where(f"last > {self.cells[first]}")
        right = right.withColumn("cell", F.explode(F.sequence(F.lit(self.cells[first]), F.col("last") - 1))).withColumn("copy", F.pmod(F.xxhash64("anchor_id"), F.lit(copies)).cast("int")).drop("last")
        left = self.rows.where((F.col("cell") >= self.cells[first]) & (F.col("cell") < self.cells[end])).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

        def compared(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            if left.num_rows and right.num_rows:
                norms, a_norms = left.column("norm").to_numpy(), right.column("norm").to_numpy()
                exact = norms.max() * a_norms.max() < 2**52  # in double precision; else in integers
                x, a = _matrix(left.column("q"), exact), _matrix(right.column("q"), exact)
                ids, labels, a_ids, a_labels = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), right.column("anchor_id").to_numpy(), right.column("label").to_numpy()
                lists = {c: right.column(c).combine_chunks() for c in ("low", "high", "kth")}
                first = lists["low"].offsets.to_numpy().astype(np.int64)
                first = first - first[0]
                low, high, kth = (x.flatten().to_numpy() for x in lists.values())
                for at in range(0, len(a), BLOCK):
                    to = min(at + BLOCK, len(a))
                    own = slice(first[at], first[to])
                    w, found, score = best(x, ids, labels, norms, a[at:to], a_ids[at:to], a_labels[at:to], a_norms[at:to], first[at : to + 1] - first[at], low[own], high[own], kth[own], k, same)
                    w = w + first[at]
                    i = np.searchsorted(first, w, "right") - 1
                    out.append((a_ids[i], (w - first[i]).astype(np.int32), found, score))
            return pa.table(dict(zip(("anchor_id", "w", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        keys = ["cell", "copy"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, "anchor_id bigint, w int, vec_id bigint, score bigint")


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q and norm of the rows that take part."""
    kind = "double" if "double" in vectors.schema["embedding"].dataType.simpleString() else "float"
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    v = v.where("vec_id is not null and label is not null and embedding is not null")
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**31, F.floor(x.cast("double") * scale))  # noqa: E731  null, NaN and beyond: null
    v = v.select("vec_id", "label", F.transform("embedding", lambda x: F.when(~F.isnan(x), whole(x))).alias("q")).where(F.forall("q", lambda x: x.isNotNull()))
    v = v.withColumn("norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).where(f"norm < {2**31}")
    one = v.groupBy("vec_id").agg(F.min(F.struct("label", "q", "norm")).alias("r")).select("vec_id", "r.*")
    return keep(one, "vectors")


def mined(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives the first negatives whose score is from low to high percent of the positive's."""
    spark = vectors.sparkSession
    v = quantised(vectors, scale)
    sizes = v.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    if not sizes:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    v = v.where(F.size("q") == sizes[0].d)
    buckets = Buckets(v)
    asked = v.where(anchors).withColumnRenamed("vec_id", "anchor_id")
    limit = lambda x: F.array(F.lit(x).cast("bigint"))
    near = buckets.search(asked.withColumns({"low": limit(-NO_LIMIT), "high": limit(NO_LIMIT)}), positives, True, "positives")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    near = keep(near.withColumn("place", place).where("score >= 0").select("anchor_id", "vec_id", "score", "place"), "near")
    # of x percent of a score, rounded up and down without leaving a long
    share = lambda p, percent, up: F.expr(f"{p} div 100 * {percent} + ({p} % 100 * {percent} + {99 if up else 0}) div 100")
    windows = near.withColumn("low", share("score", low, True)).withColumn("high", share("score", high, False)).where("low <= high")
    windows = windows.withColumn("w", F.row_number().over(Window.partitionBy("anchor_id").orderBy("place")) - 1)
    windows = keep(windows, "windows")
    lists = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("all"))
    lists = lists.select("anchor_id", F.col("all.low").alias("low"), F.col("all.high").alias("high"))
    far = buckets.search(asked.join(lists, "anchor_id"), negatives, False, "negatives")
    far = far.select("anchor_id", "w", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = windows.select("anchor_id", "w", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(far, ["anchor_id", "w"])
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    forget(near)
    return out.select("anchor_id", "positive_id", rank.cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
