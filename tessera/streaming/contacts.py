"""Contact counts of a stream of read pairs: the sum over chunks as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _places(bins: DataFrame, read: int, width: int) -> DataFrame:
    """_k and near: the bins (bs, be, bin_id) that a read of that length can overlap if it begins in the bucket _k of that width."""
    low, high = F.floor((F.col("bs") - read + 1) / width), F.floor((F.col("be") - 1) / width)
    dealt = bins.withColumn("_k", F.explode(F.sequence(low, high)))
    return dealt.groupBy("_k").agg(F.collect_list(F.struct("bs", "be", "bin_id")).alias("near"))


def _best(near: Column, start: Column, read: int) -> Column:
    """The bin that the read overlaps most, of equal ones the first; null where it overlaps none."""
    each = F.transform(near, lambda b: F.struct((F.least(start + read, b["be"]) - F.greatest(start, b["bs"])).alias("olp"), (-b["bin_id"]).alias("no")))
    top = F.array_max(F.filter(each, lambda x: x["olp"] > 0))
    return -top["no"]


def stream_counts(pairs: DataFrame, bins: DataFrame, read: int, width: int, late: str = "1 hour", period: str = "1 hour") -> DataFrame:
    """period_start, chrom, bin1_id, bin2_id, cnt of a stream of pairs (pair_id, chrom, p1, p2, ts): the counts of each period of ts, each pair at the bins that its two reads overlap most.

    Bins are found without state, by a join with the bins of a bucket (one row a bucket of width). The only state is the counts of periods that the watermark hasn't passed; append mode gives a period once it is closed,
    and the sum over periods is the map. Pairs that come later than `late` are left out. Pairs of which a read overlaps no bin, or without ts, count nowhere."""
    near = _places(bins, read, width)
    out = pairs.withWatermark("ts", late)
    for i, p in ((1, "p1"), (2, "p2")):
        own = near.toDF(f"_k{i}", "_near")
        out = out.withColumn(f"_k{i}", F.floor(F.col(p) / width)).join(own, f"_k{i}").withColumn(f"b{i}", _best(F.col("_near"), F.col(p), read)).drop("_near")
    met = out.where("b1 is not null and b2 is not null")
    counts = met.groupBy(F.window("ts", period).alias("w"), "chrom", F.least("b1", "b2").alias("bin1_id"), F.greatest("b1", "b2").alias("bin2_id")).agg(F.count("*").alias("cnt"))
    return counts.select(F.col("w.start").alias("period_start"), "chrom", "bin1_id", "bin2_id", "cnt")
