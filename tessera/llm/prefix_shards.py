"""Contiguous shards of near equal bytes, from global prefix sums.

Rows are put in one order (doc_id, then size and checksum of the text) by ranges; each task sums the sizes in its own range as it goes, and the totals of the tasks before, at most as many numbers as there are shuffle partitions, make
these sums global. A row goes to the shard in which the middle of its bytes lies when all bytes are cut at equal targets, so a shard differs from the target by less than its outermost rows. Its slot is its place in the task plus what
the tasks before have put into the shard: one number for each task and shard that meet, at most partitions plus shards.

Texts are read once, for their sizes and checksums; only these are put in order. Whole rows move only where shards are written.

Defined results: a null text has no bytes and is as large as its overhead. Rows without doc_id come first. Repeated rows are rows of their own; which of two equal ones comes first is open, and equal rows are dealt to several tasks.
Copies lie where their ids put them: the law knows no groups. A row larger than a shard's target leaves shards beside it empty, as do fewer rows than shards. An empty table gives no rows. Sizes may sum to 10^17 bytes at 40 shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm._tables import forget, keep

SHARDS = 40
OVERHEAD = 16
LAW = "bytes"


def _ordered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with size) written in order, with part (the task), pos (place in it) and before (bytes before it there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = before + np.cumsum(size)
            more = [np.full(len(size), part), np.arange(pos, pos + len(size)), ends - size]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], [*batch.schema.names, "part", "pos", "before"])
            pos += len(size)
            before = int(ends[-1]) if len(ends) else before

    schema = StructType([*rows.schema, *[StructField(c, LongType()) for c in ("part", "pos", "before")]])
    return keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ordered")


def _cut(ordered: DataFrame, shards: int) -> DataFrame:
    """ordered with shard and slot in place of part, pos and before."""
    spark = ordered.sparkSession
    totals = sorted(ordered.groupBy("part").agg(F.sum("size")).toArrow().to_pydict().items(), key=lambda x: x[0] != "part")
    parts, sums = (np.array(x, np.int64) for _, x in totals)
    by = np.argsort(parts)
    parts, sums = parts[by], sums[by]
    starts = np.cumsum(sums) - sums
    whole = int(sums.sum())
    offsets = spark.createDataFrame(list(zip(parts.tolist(), starts.tolist(), strict=True)), "part bigint, start bigint")
    rows = ordered.join(F.broadcast(offsets), "part").withColumn("shard", F.expr(f"cast(((2 * (start + before) + size) * {shards}) div {max(2 * whole, 1)} as int)"))
    met = rows.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy("part").collect()
    have, bases = [0] * shards, []
    for m in met:
        bases.append((m.part, m.shard, have[m.shard] - m.first))
        have[m.shard] += m.n
    base = spark.createDataFrame(bases, "part bigint, shard int, base bigint")
    return rows.join(F.broadcast(base), ["part", "shard"]).withColumn("slot", F.col("pos") + F.col("base")).drop("part", "pos", "before", "start", "base")


def _sized(overhead: int) -> list[F.Column]:
    text = F.col("text").cast("string")
    return [(F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")]


def sharded(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row of docs."""
    slim = keep(docs.select("doc_id", *_sized(overhead), F.monotonically_increasing_id().alias("id")), "sizes")
    ordered = _ordered(slim, ["doc_id", "size", "text_crc32", "id"])
    forget(slim)
    return _cut(ordered, shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, overhead: int = OVERHEAD) -> str:
    """Write the rows of docs, with their own columns, as Parquet to a folder for each shard, in the order of their slots (files by name, rows in them); the name of the folders' column, which docs doesn't have."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("doc_id").alias("doc_id"), *_sized(overhead), F.monotonically_increasing_id().alias("id"))
    ordered = _ordered(keep(rows, "rows"), ["doc_id", "size", "text_crc32", "id"])
    out = _cut(ordered, shards).repartitionByRange("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    out.select(*[F.col("own").getField(c).alias(c) for c in docs.columns], F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
