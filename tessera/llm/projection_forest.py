"""Nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample (SAMPLE vectors, chosen by a hash): a node is split at the median along the line between two of its points, down to LEAF
vectors, or single points of the sample. Every vector is put into one leaf of each tree. A query walks all trees through one shared priority queue, always to the node whose cell is nearest (the sum of its squared
distances to the hyperplanes on whose other side it lies), until the leaves that it has reached hold the budget of vectors, counted over the trees; all vectors in these leaves are compared
exactly, in double precision on the original vectors.

The budget is measured, not set: for TRIED points of the sample the neighbours among all vectors are found by one pass over these, and the budget is what RECALL of them take to be reached in the whole forest. So it is right at any size, also where
vectors lie in clusters whose inside the sample doesn't show; it grows as slowly as the data allow, hardly near a surface of few dimensions, and nearly as the table for directions without any structure, for which no index does much better.

Equal vectors are one, with their NEIGHBOURS + 1 smallest ids, which are all that can be reported; that is cut down before the shuffle. Neighbouring leaves of a tree make a cell of about PART
vectors. A vector is sent to its cells, a query once to each cell in which it reached a leaf; queries of one cell beyond ASKED are dealt to copies of it, and cells that hold
more than PART to several tasks, so no task holds more than these.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part, neither do rows without vec_id. Rows that repeat a
vec_id with the same vector count once; of different vectors under one vec_id the smallest (in array order) is asked, all are candidates, and the nearest is reported. With fewer
candidates than NEIGHBOURS all of them are returned. An empty table gives no rows."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import ragged
from tessera.llm._tables import keep

SAMPLE = 32_000
TREES = 8
LEAF = 4  # vectors in a leaf, as long as the sample is large enough for that
RECALL = 0.95  # of the known neighbours inside the sample that the budget has to reach
TRIED = 128  # points of the sample whose neighbours among all vectors are looked up to find the budget
LEAST_BUDGET = 640  # vectors, counted over the trees
NEIGHBOURS = 10
PART = 4096
ASKED = 20_000


class Forest:
    """The nodes of all trees in flat arrays: a hyperplane across the line between two points of the sample, and two children. A child, or root, below 0 is the leaf -1 - child. Leaves are numbered from
    left to right through the trees."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        rng = np.random.Generator(np.random.PCG64(3))
        ends, offsets, left, right, held = [], [], [], [], []

        def grow(at: np.ndarray) -> int:
            if len(at) > leaf:
                for _ in range(5):
                    pair = at[rng.integers(0, len(at), 2)]
                    normal = sample[pair[0]] - sample[pair[1]]
                    if not normal.any():
                        continue
                    along = sample[at] @ normal
                    offset = float(np.median(along)) if len(at) > 3 else float(along.min() + along.max()) / 2
                    side = along > offset
                    if 0.1 < np.count_nonzero(side) / len(at) < 0.9:
                        own = len(left)
                        ends.append(pair), offsets.append(offset), left.append(0), right.append(0)
                        left[own] = grow(at[side])
                        right[own] = grow(at[~side])
                        return own
            held.append(len(at))
            return -len(held)

        self.roots = [grow(np.arange(len(sample))) for _ in range(trees)]
        self.sample = sample.astype(np.float32)
        self.ends = np.array(ends, np.int32).reshape(-1, 2)
        length = np.sqrt(((self.sample[self.ends[:, 0]] - self.sample[self.ends[:, 1]]) ** 2).sum(axis=1))
        self.offsets, self.shrink = np.array(offsets, np.float32), 1 / np.maximum(length, np.float32(1e-30))
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.held = np.array(held, float)  # vectors in each leaf; replaced where other vectors than the sample are meant
        self.leaves = len(held)

    def place(self, x: np.ndarray) -> list[np.ndarray]:
        """The leaf of each vector in each tree."""
        x, out = x.astype(np.float32), []
        for root in self.roots:
            node = np.full(len(x), root, np.int64)
            at = np.flatnonzero(node >= 0)
            while len(at):
                here = node[at]
                normal = self.sample[self.ends[here, 0]] - self.sample[self.ends[here, 1]]
                side = np.einsum("ij,ij->i", x[at], normal) > self.offsets[here]
                node[at] = np.where(side, self.left[here], self.right[here])
                at = at[node[at] >= 0]
            out.append(-1 - node)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_normals"}

    def normals(self) -> np.ndarray:
        """Each node's normal; made once in a process, and not sent."""
        if "_normals" not in self.__dict__:
            self._normals = self.sample[self.ends[:, 0]] - self.sample[self.ends[:, 1]]
        return self._normals

    def walk(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, nearest first. One product gives a batch's places along all normals; only those of nodes on the way are looked at."""
        nodes = list(zip(self.left.tolist(), self.right.tolist(), self.offsets.tolist(), self.shrink.tolist(), strict=True))
        for at in range(0, len(q), 16):
            for along in q[at : at + 16].astype(np.float32) @ self.normals().T:
                yield self._leaves(along, nodes)

    def _leaves(self, along: np.ndarray, nodes: list[tuple[int, int, float, float]]) -> Iterator[int]:
        queue = [(0.0, r) for r in self.roots]
        while queue:
            far, node = heapq.heappop(queue)
            while node >= 0:  # down the near sides, which are no farther
                left, right, offset, shrink = nodes[node]
                m = (along.item(node) - offset) * shrink
                near, other = (left, right) if m > 0 else (right, left)
                heapq.heappush(queue, (far + m * m, other))
                node = near
            yield -1 - node

    def reach(self, q: np.ndarray, budget: float) -> Iterator[list[int]]:
        """For each query the leaves, nearest first, that hold the budget."""
        held = self.held.tolist()
        for leaves in self.walk(q):
            out, seen = [], 0.0
            for leaf in leaves:
                out.append(leaf)
                seen += held[leaf]
                if seen >= budget:
                    break
            yield out


def closest(x: np.ndarray, probes: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """probe, place in x and squared distance of the k + 1 rows of x nearest to each probe (itself, where it is in x)."""
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ probes.T + (probes**2).sum(axis=1)
    at = np.argpartition(d, min(k, len(x) - 1), axis=0)[: k + 1] if len(x) > k + 1 else np.repeat(np.arange(len(x))[:, None], len(probes), axis=1)
    which = np.repeat(np.arange(len(probes))[None], len(at), axis=0).ravel()
    return which, at.ravel(), d[at.ravel(), which]


def needed(forest: Forest, probes: np.ndarray, near: list[np.ndarray], share: float = RECALL) -> float:
    """How many vectors, counted over the trees, queries have to see until they have met that share of their nearest: near, for each probe."""
    held, found = forest.held.tolist(), []
    for own, leaves in zip(near, forest.walk(probes), strict=True):
        where: dict[int, list[int]] = {}
        for i, places in enumerate(np.column_stack(forest.place(own)).tolist()):
            for leaf in places:
                where.setdefault(leaf, []).append(i)
        left, seen = set(range(len(own))), 0.0
        for leaf in leaves:
            seen += held[leaf]
            for i in where.get(leaf, ()):
                if i in left:
                    left.discard(i)
                    found.append(seen)
            if not left:
                break
    return float(np.quantile(found, share))


def leaf_size(sample: np.ndarray, rows: int) -> int:
    """Vectors of the sample in a leaf, so that a leaf holds LEAF of the rows where the sample allows it."""
    return max(1, LEAF * len(sample) // max(rows, 1))


def budget(forest: Forest, probes: np.ndarray, near: list[np.ndarray], rows: int) -> float:
    """The budget among so many rows, counted over the trees."""
    most = float(len(forest.roots) * rows)
    if rows * len(forest.roots) <= LEAST_BUDGET or not len(probes):
        return most
    return min(most, max(LEAST_BUDGET, needed(forest, probes, near)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _known(classes: DataFrame, probes: np.ndarray, kind: str, k: int) -> list[np.ndarray]:
    """The k + 1 vectors of all that are nearest to each probe, by comparing with every one: at most TRIED x (k + 1) rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.slice(at, 4096).column("embedding"))
                which, place, d = closest(x, probes, k)
                have.append((which, d, x[place]))
                if len(have) == 16:
                    have = [kept(have)]
        if have:
            which, d, x = kept(have)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(d), pa.array(list(x.astype(float)), pa.list_(pa.float64()))], ["probe", "d", "embedding"])

    def kept(have: list[tuple]) -> tuple:
        which, d, x = (np.concatenate(v) for v in zip(*have, strict=True))
        order = np.lexsort((d, which))
        which, d, x = which[order], d[order], x[order]
        first = np.arange(len(which)) - np.searchsorted(which, which) <= k
        return which[first], d[first], x[first]

    rank = F.row_number().over(Window.partitionBy("probe").orderBy("d"))
    rows = classes.select("embedding").mapInArrow(run, "probe int, d double, embedding array<double>").withColumn("rank", rank).where(f"rank <= {k + 1}")
    near: list[list] = [[] for _ in probes]
    for r in rows.select("probe", "embedding").collect():
        near[r.probe].append(r.embedding)
    return [np.array(v, float) for v in near]


def nearest(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = NEIGHBOURS, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that are found for each query among all other rows of vectors (vec_id, embedding, ...)."""
    spark = vectors.sparkSession
    kind = "double" if "double" in vectors.schema["embedding"].dataType.simpleString() else "float"
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind)))  # no -0.0
    v = keep(v.dropDuplicates(["vec_id", "embedding"]), "vectors")
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").take(1)
    out = "query_id bigint, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    v = v.where(F.size("embedding") == sizes[0].d)
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = v.withColumn("n", first).where(f"n <= {k + 1}").groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = keep(classes, "classes")
    question = v.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    rows, asked_for = classes.count(), v.where(queries).select("vec_id").distinct().count()
    draw = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(rows, 1)))
    sample = _matrix(classes.where(draw).select("embedding").toArrow().column("embedding").combine_chunks())  # about SAMPLE rows
    if not len(sample):
        sample = np.array([r.embedding for r in classes.select("embedding").take(1)], float)
    sample = sample[np.lexsort(sample.T)]  # in an order that doesn't depend on how the table is split
    sample = sample[np.random.Generator(np.random.PCG64(4)).permutation(len(sample))]
    forest = Forest(sample, trees, min(LEAF, leaf_size(sample, rows)))
    forest.held = np.bincount(np.concatenate(forest.place(sample)), minlength=forest.leaves) * (rows / len(sample))
    probes = sample[:TRIED]
    enough = budget(forest, probes, _known(classes, probes, kind, k), rows)
    # cells: leaves in a row that should hold about PART vectors together, and how many tasks each cell is dealt to
    cell_of = (np.cumsum(forest.held) - forest.held).astype(np.int64) // PART
    size = np.bincount(cell_of, forest.held)
    tasks = np.maximum(1, np.ceil(size / (2 * PART))).astype(np.int64)
    copies = max(1, math.ceil(asked_for * min(1.0, enough / max(1.0, rows)) / ASKED))
    sent = spark.sparkContext.broadcast((forest, cell_of, tasks))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, cells, many = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                salt = part.column("salt").to_numpy()
                for leaf in f.place(_matrix(part.column("embedding"))):
                    cell = cells[leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(salt % many[cell]), pa.array(leaf), part.column("embedding"), part.column("ids")], ["cell", "task", "leaf", "embedding", "ids"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, cells, many = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                which, cell, task, leaves = [], [], [], []
                for i, reached in enumerate(f.reach(_matrix(part.column("embedding")), enough)):
                    reached = np.sort(np.array(reached, np.int64))
                    own, starts = np.unique(cells[reached], return_index=True)
                    for c, some in zip(own.tolist(), np.split(reached, starts[1:]), strict=True):
                        for t in range(many[c]):
                            which.append(i)
                            cell.append(c)
                            task.append(t)
                            leaves.append(some)
                take = pa.array(np.array(which, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(task, pa.int64()), part.column("query_id").take(take), part.column("embedding").take(take), pa.array(leaves, pa.list_(pa.int64()))],
                    ["cell", "task", "query_id", "embedding", "leaves"],
                )

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        keep_q, keep_v, keep_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            leaf = left.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, x = leaf[order], _matrix(left.column("embedding").combine_chunks())[order]
            ids = left.column("ids").combine_chunks().take(pa.array(order))
            off = ids.offsets.to_numpy()
            flat, first, many = ids.flatten().to_numpy(), off[:-1] - off[0], np.diff(off)
            q = _matrix(right.column("embedding").combine_chunks())
            for i, (own_id, leaves) in enumerate(zip(right.column("query_id").to_pylist(), right.column("leaves").to_pylist(), strict=True)):
                a, b = np.searchsorted(leaf, leaves, "left"), np.searchsorted(leaf, leaves, "right")
                at = ragged(a, b - a)
                d = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                own = flat[ragged(first[at], many[at])]
                d = np.repeat(d, many[at])
                other = own != own_id
                d, own = d[other], own[other]
                if len(d) > (most := k * trees):  # a vector may be here once for each tree
                    near = d <= np.partition(d, most - 1)[most - 1]
                    d, own = d[near], own[near]
                some = np.lexsort((own, d))
                some = some[np.sort(np.unique(own[some], return_index=True)[1])][:k]
                keep_q.append(np.full(len(some), own_id, np.int64))
                keep_v.append(own[some])
                keep_d.append(d[some])
        return pa.table({"query_id": np.concatenate(keep_q), "vec_id": np.concatenate(keep_v), "score": np.concatenate(keep_d)})

    base = classes.withColumn("salt", F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(1 << 30))).select("salt", "embedding", "ids")
    left = base.mapInArrow(placed, f"cell bigint, task bigint, leaf bigint, embedding array<{kind}>, ids array<bigint>").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    right = question.repartition(max(1, min(10_000, asked_for // 64)), "query_id").mapInArrow(asked, f"cell bigint, task bigint, query_id bigint, embedding array<{kind}>, leaves array<bigint>").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int"))
    keys = ["cell", "task", "copy"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, out).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
