"""MinHash near-dedup with odd sketches.

Each document's set of word shingles gives SAMPLES MinHash values. They make BANDS band keys, by which candidates meet, and
an odd sketch: the values, each with its position, are folded into a parity bitmap of SKETCH_BITS bits. For two documents that differ in
D of the positions the bitmaps' XOR has about SKETCH_BITS / 2 * (1 - exp(-4 D / SKETCH_BITS)) ones, so its population count
estimates high similarities closely. The estimate only discards candidates that are far below the threshold. A second parity bitmap, of SET_BITS bits, folds the whole
shingle set: the ones in the XOR of two such bitmaps can't exceed the size of the symmetric difference, so more than
(|A| + |B|) (1 - t) / (1 + t) ones prove a similarity below t. This bound never discards a link, and leaves few pairs below the threshold.
Every link is confirmed on the full shingle sets, as sets of 64-bit hashes of the shingles; n_shingles counts these.

Equal sets are one class from the start, and only the smallest doc_id of a class goes further. Within a band key, all rows first meet
the smallest one alone (a star, counted before it is shuffled). What confirmed stars join is one component; only in buckets that still hold several
components are further pairs looked for, block against block, and only across components: no block of the bucket's largest component meets another block of it. So a bucket with a third of
all rows costs about one pair a row and for each block of the others, and yet no candidate is left out. Bands and classes of more than HOT rows, of which there can't be more than MOST_HOT (else the
bound is raised), are joined by broadcast where their rows stand; all others are small. The texts of documents that share a band are fetched once.

Defined results: null or empty texts and texts of separators only have n_shingles 0 and stand alone. A null doc_id stands alone with
component_id null and kept true. Rows that repeat a doc_id with the same text share its class, and each is returned; where texts under one doc_id differ, the doc_id links what either links.
Of a text of any length all shingles count: its sets and sketches are made in the task that reads it. An empty table gives none. keep_one() goes by rows, not by doc_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bytes import Words, mix, slices
from tessera.llm._tables import forget, keep, keep_only, rolled, unrolled

ROWS = 4
BANDS = 32
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
SET_BITS = 2048
SMALL = 64  # rows of a bucket up to which it is joined with itself
BLOCK = 4096  # rows of a bucket that one task compares with as many others
HOT = 1000  # rows of a band or class beyond which it is joined by broadcast
MOST_HOT = 100_000  # bands or classes that are broadcast, at most
MISS_SIGMAS = 6.0

_GEN = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = (_GEN.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _GEN.integers(0, 2**32, SAMPLES, dtype=np.uint32)[:, None]
_POSITION = np.arange(1, SAMPLES + 1, dtype=np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64)


def minhash(elements: np.ndarray) -> np.ndarray:
    """SAMPLES minima over the 64-bit elements."""
    low = (elements >> np.uint64(16)).astype(np.uint32)
    out = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 2048):
        part = _MULTIPLY * low[None, at : at + 2048]
        part += _ADD
        part ^= part >> np.uint32(15)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """The parity bitmap of rows of minima, as bytes."""
    place = (mix(minima.astype(np.uint64) * np.uint64(1 << 10) + _POSITION) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = np.zeros((len(minima), SKETCH_BITS), np.uint8)
    np.bitwise_xor.at(bits, (np.arange(len(minima))[:, None], place), 1)
    return np.packbits(bits, axis=1)


def set_parity(elements: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as bytes."""
    return np.packbits(np.bincount((elements >> np.uint64(20)).astype(np.int64) % SET_BITS, minlength=SET_BITS).astype(np.uint8) & 1)


def most_ones(percent: int) -> int:
    """Ones in the XOR of two sketches beyond which a similarity of percent / 100 is out of the question: MISS_SIGMAS above the expected differing samples."""
    share = 1 - percent / 100
    differ = min(SAMPLES, SAMPLES * share + MISS_SIGMAS * np.sqrt(SAMPLES * share * (1 - share)) + 1)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS)) + MISS_SIGMAS * np.sqrt(differ) / 2))


def signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, k1, k2, minima, parity = [], [], [], [], []
                for s in Words(part.column("text")).shingles(size):
                    n.append(len(s))
                    k1.append(int(np.sum(mix(s), dtype=np.uint64)))
                    k2.append(int(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
                    minima.append(minhash(s))
                    parity.append(set_parity(s))
                m = np.array(minima, np.uint32).reshape(-1, SAMPLES)
                bands = np.zeros((len(m), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + m[:, r::ROWS] + np.uint64(0x9E3779B97F4A7C15))
                bands = mix(bands ^ _BAND).view(np.int64)
                sketches = np.ascontiguousarray(np.hstack([odd_sketch(m), np.array(parity, np.uint8).reshape(len(m), -1)])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(k1, np.uint64).view(np.int64)),
                        pa.array(np.array(k2, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * BANDS, bands.ravel()),
                        pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * sketches.shape[1], sketches.ravel()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return run


def confirm(size: int, percent: int):
    """100 * intersection >= percent * union on the full sets of text_a and text_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                ok = []
                for x, y in zip(Words(part.column("text_a")).shingles(size), Words(part.column("text_b")).shingles(size), strict=True):
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        ok.append(False)
                        continue
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


def across(most: int, percent: int, best_only: bool):
    """Pairs of different components in two blocks of one bucket that the sketches don't rule out; with best_only the nearest for each row and foreign component."""
    head = SKETCH_BITS // 64

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        left, right = rows[rows.chunk == lo], rows[rows.chunk == hi]
        a, b = left.rep.to_numpy(), right.rep.to_numpy()
        ca, cb = left.comp.to_numpy(), right.comp.to_numpy()
        na, nb = left.n.to_numpy(), right.n.to_numpy()
        sa = np.array(left.sketch.tolist(), np.int64).reshape(len(a), -1).view(np.uint64)
        sb = np.array(right.sketch.tolist(), np.int64).reshape(len(b), -1).view(np.uint64)
        out_a, out_b = [], []
        for i in range(len(a)):
            j = np.flatnonzero((cb != ca[i]) & (b > a[i] if lo == hi else True))
            ones = np.bitwise_count(sb[j, :head] ^ sa[i, :head]).sum(axis=1, dtype=np.int64)
            j = j[ones <= most]
            ones = np.bitwise_count(sb[j, head:] ^ sa[i, head:]).sum(axis=1, dtype=np.int64)
            near = ones * (100 + percent) <= (na[i] + nb[j]) * (100 - percent)
            j, ones = j[near], ones[near]
            if best_only and len(j):
                j = j[np.lexsort((b[j], ones))]
                j = j[np.unique(cb[j], return_index=True)[1]]
            out_a.append(np.full(len(j), a[i]))
            out_b.append(b[j])
        x, y = np.concatenate([*out_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*out_b, np.zeros(0, np.int64)]).astype(np.int64)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all ids in links (a, b); comp is the smallest id of the component.

    Each round every id joins the neighbour, or itself, that comes first in an order, and the links are carried over to what they
    joined. By turns the order is that of the ids, which shrinks a star around its smallest id to a point at once, and one dealt anew, which shrinks
    chains by a constant share."""
    edges, turn, steps = keep(links.where("a <> b").select("a", "b").distinct(), "edges"), 0, []
    names = keep(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), "names")
    begun = names
    while edges.take(1):
        order = (lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("v"))) if turn % 2 else (lambda c: F.struct(F.lit(0).alias("h"), c.alias("v")))  # noqa: B023, E731
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        first = F.least(F.min(order(F.col("w"))), order(F.col("v")))
        to = keep(both.groupBy("v").agg(first.alias("m")).select("v", F.col("m")["v"].alias("to")), "join")
        steps.append(to)
        x, y = to.toDF("a", "x"), to.toDF("b", "y")
        before, edges = edges, keep(edges.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        forget(before)
        turn += 1
    for to in steps:
        names = names.join(to, names.comp == to.v, "left").select("id", F.coalesce("to", "comp").alias("comp"))
    least = names.groupBy("comp").agg(F.min("id").alias("least"))
    out = keep(names.join(least, "comp").select("id", F.col("least").alias("comp")), "components")
    forget(edges, begun, *steps)
    return out


def _near(x: str, y: str, size_x: str, size_y: str, most: int, percent: int) -> F.Column:
    """Whether two sketches leave it open that their sets are near enough."""
    ones = lambda places: sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in places), F.lit(0))
    head = SKETCH_BITS // 64
    return (ones(range(head)) <= most) & (ones(range(head, head + SET_BITS // 64)) * (100 + percent) <= (F.col(size_x) + F.col(size_y)) * (100 - percent))


def _joined(rows: DataFrame, keyed: DataFrame, hot: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """rows joined with keyed (one row a key). hot: the keys whose many rows must not meet in one task, MOST_HOT at most."""
    few = F.broadcast(hot.select(*key))
    there = rows.join(F.broadcast(keyed.join(few, key, "left_semi")), key)
    others = rows.join(few, key, "left_anti").join(keyed.join(few, key, "left_anti"), key)
    return there.select(*names).unionByName(others.select(*names))


def _hot(counted: DataFrame, key: list[str], rows: int) -> DataFrame:
    """The keys of counted (key, rows; of so many rows in all) that hold more than HOT. Not more than MOST_HOT keys can hold a MOST_HOT-th of all rows."""
    return keep(counted.where(F.col("rows") > max(HOT, rows // MOST_HOT)).select(*key), "hot")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>"
    signed = keep(texts.mapInArrow(signatures(size), schema), "signatures")
    key = ["n_shingles", "k1", "k2"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # the smallest doc_id of each class with its sketches, picked before the shuffle
    classes = keep(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("first")), "classes")
    reps = classes.select("rep", F.col("n_shingles").alias("n"), "first.bands", "first.sketch")
    band = reps.select("rep", F.explode("bands").alias("band"))
    shared = keep(band.groupBy("band").agg(F.count("*").alias("rows"), F.min("rep").alias("hub")).where("rows > 1"), "bands")
    hot = _hot(shared, ["band"], reps.count() * BANDS)
    buckets = keep(_joined(band, shared, hot, ["band"], ["band", "rep", "rows", "hub"]), "buckets")
    sketches = reps.select("rep", "n", "sketch")
    most = most_ones(percent)
    held = buckets.select(F.col("rep").alias("doc_id")).distinct()
    held = keep(texts.join(held.hint("merge"), "doc_id", "left_semi"), "texts")  # never broadcast: the ids grow with the input
    stars = buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(sketches.toDF("a", "n_a", "x"), "a").join(sketches.toDF("b", "n_b", "y"), "b").where(_near("x", "y", "n_a", "n_b", most, percent)).select("a", "b").distinct()
    checked = confirmed(stars, held, size, percent)
    comp = None
    for best_only in (True, False):
        if comp is None:
            comp = components(checked.where("linked"))
            labelled = keep(buckets.join(comp, F.col("rep") == F.col("id"), "left").select("band", "rep", "rows", F.coalesce("comp", "rep").alias("comp")), "labelled")
            rows = keep(_mixed(labelled, hot).join(sketches, "rep"), "mixed")
            forget(labelled)
        small, large = rows.where(F.col("rows") <= SMALL), rows.where(F.col("rows") > SMALL)
        left, right = (small.select("band", F.col("rep").alias(f"{n}"), F.col("comp").alias(f"comp_{n}"), F.col("sketch").alias(f"sketch_{n}"), F.col("n").alias(f"n_{n}")) for n in "ab")
        found = left.join(right, "band").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _near("sketch_a", "sketch_b", "n_a", "n_b", most, percent)).select("a", "b")
        found = found.union(_dealt(large).groupBy("band", "lo", "hi").applyInPandas(across(most, percent, best_only), "a bigint, b bigint")).distinct()
        fresh = keep(found.join(checked, ["a", "b"], "left_anti"), "pairs")
        if fresh.take(1):
            checked = checked.unionByName(confirmed(fresh, held, size, percent))
            forget(rows, comp, fresh)
            comp = None
        elif not large.take(1):  # small buckets are exhausted by either pass; in large ones a nearest pair that failed may hide others
            break
    if comp is None:
        comp = components(checked.where("linked"))
    forget(buckets, shared, hot, held, rows)
    named = classes.join(comp, F.col("rep") == F.col("id"), "left").select(*key, F.coalesce("comp", "rep").alias("component_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    linked = _joined(full.select("doc_id", *key), named, _hot(classes, key, signed.count()), key, out)
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _mixed(labelled: DataFrame, hot: DataFrame) -> DataFrame:
    """band, rep, rows, comp (labelled) of the buckets that hold several components, with major (whether the row is of the bucket's largest one), and n_major and n_minor, the numbers of such rows and of others."""
    each = labelled.groupBy("band", "comp").agg(F.count("*").alias("k"))
    bands = each.groupBy("band").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.max("k").alias("n_major"), F.sum("k").alias("all"), F.count("*").alias("several")).where("several > 1")
    out = _joined(labelled, bands, hot, ["band"], ["band", "rep", "rows", "comp", "largest", "n_major", "all"])
    return out.select("band", "rep", "rows", "comp", (F.col("comp") == F.col("largest")).alias("major"), "n_major", (F.col("all") - F.col("n_major")).alias("n_minor"))


def _dealt(large: DataFrame) -> DataFrame:
    """Rows of large buckets in chunks of about BLOCK, sent to each pair of chunks (lo, hi) that may hold a pair: chunks of the largest component don't meet each other."""
    chunks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    minor, every = chunks("n_minor"), chunks("n_minor") + chunks("n_major")
    place = F.when(F.col("major"), minor + F.pmod(F.xxhash64("rep"), chunks("n_major"))).otherwise(F.pmod(F.xxhash64("rep"), minor)).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("major"), minor).otherwise(every) - 1)
    dealt = large.withColumn("chunk", place).withColumn("other", F.explode(others))
    return dealt.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "rows", "major", "n_major", "n_minor")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, linked: the pairs judged on the full sets of their texts."""
    joined = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    judged = joined.select("a", "b", "text_a", "text_b").mapInArrow(confirm(size, percent), "a bigint, b bigint, linked boolean")
    return keep(judged.groupBy("a", "b").agg(F.max("linked").alias("linked")), "judged")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with docs' own columns, of each group of linked rows: that with the smallest doc_id (null comes last; of equal ones any). Rows are told apart by a number that is written with
    them, so of rows that repeat a doc_id and its text one stays, and different texts under one doc_id are judged each on its own."""
    rows = keep(rolled(docs).withColumn("row", F.monotonically_increasing_id()), "rows")

    def first() -> DataFrame:
        found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias("row"), "component_id")
        own = rows.select("row", F.col("own.doc_id").cast("bigint").alias("doc_id"))
        least = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
        return found.join(own, "row").groupBy("component_id").agg(least.alias("row")).select("row")

    return unrolled(rows.join(keep_only(first, "stay").hint("merge"), "row", "left_semi"), docs)  # never broadcast: the numbers grow with the input
