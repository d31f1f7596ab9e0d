"""Symmetric sparse matrices as pixels (chrom, bin1_id <= bin2_id, cnt): each entry once, diagonal included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["chrom", "bin1_id", "bin2_id"]


def from_pairs(pairs: DataFrame, one: str = "b1", two: str = "b2") -> DataFrame:
    """Counts of bin pairs in upper-triangle order."""
    return pairs.groupBy("chrom", F.least(one, two).alias("bin1_id"), F.greatest(one, two).alias("bin2_id")).agg(F.count("*").alias("cnt"))


def add(*maps: DataFrame) -> DataFrame:
    """The sum of maps, as of chunks."""
    out = maps[0].select(*PIXEL, "cnt")
    for m in maps[1:]:
        out = out.unionByName(m.select(*PIXEL, "cnt"))
    return out.groupBy(*PIXEL).agg(F.sum("cnt").alias("cnt"))


def _both_ways(pixels: DataFrame, value: str) -> DataFrame:
    """Each pixel, and each one off the diagonal turned around; one pass, no union of two scans."""
    ways = F.when(F.col("bin1_id") == F.col("bin2_id"), F.array(F.struct("bin1_id", "bin2_id"))).otherwise(F.array(F.struct("bin1_id", "bin2_id"), F.struct(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"))))
    return pixels.select("chrom", value, F.explode(ways).alias("_w")).select("chrom", F.col("_w.bin1_id").alias("bin1_id"), F.col("_w.bin2_id").alias("bin2_id"), value)


def mirror(pixels: DataFrame, value: str = "cnt") -> DataFrame:
    return _both_ways(pixels, value)


def triangle(pixels: DataFrame, k: int = 0) -> DataFrame:
    return pixels.where(F.col("bin2_id") - F.col("bin1_id") >= k)


def marginals(pixels: DataFrame, value: str = "cnt") -> DataFrame:
    """chrom, bin_id, marginal: row sums of the symmetric matrix, the diagonal once."""
    return _both_ways(pixels, value).groupBy("chrom", F.col("bin1_id").alias("bin_id")).agg(F.sum(value).alias("marginal"))


def sparsity(pixels: DataFrame, bins: int) -> DataFrame:
    return mirror(pixels).groupBy("chrom").agg((1 - F.count("*") / F.lit(float(bins) * bins)).alias("sparsity"))


def bias_multiply(pixels: DataFrame, bias: DataFrame, column: str, value: str = "cnt", out: str | None = None) -> DataFrame:
    """value * bias of both bins; bias: chrom, bin_id and a column."""
    one, two = (bias.select("chrom", F.col("bin_id").alias(f"bin{i}_id"), F.col(column).alias(f"_w{i}")) for i in (1, 2))
    joined = pixels.join(one, ["chrom", "bin1_id"]).join(two, ["chrom", "bin2_id"])
    return joined.withColumn(out or value, F.col(value) * F.col("_w1") * F.col("_w2")).drop("_w1", "_w2")


def sinkhorn_step(pixels: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """One step of balancing by square roots of marginals: chrom, bin_id, bias. An alternative to kernels.balance without a task for each chromosome."""
    current = pixels if bias is None else bias_multiply(pixels, bias, "bias")
    step = marginals(current).where("marginal > 0").select("chrom", "bin_id", (1 / F.sqrt("marginal")).alias("bias"))
    if bias is None:
        return step
    return bias.join(step.withColumnRenamed("bias", "_b"), ["chrom", "bin_id"]).select("chrom", "bin_id", (F.col("bias") * F.col("_b")).alias("bias"))


def block_sum(pixels: DataFrame, blocks: DataFrame, value: str = "cnt") -> DataFrame:
    """Sums over pairs of blocks; blocks: chrom, bin_id, block."""
    one, two = (blocks.select("chrom", F.col("bin_id").alias(f"bin{i}_id"), F.col("block").alias(f"_b{i}")) for i in (1, 2))
    joined = pixels.join(one, ["chrom", "bin1_id"]).join(two, ["chrom", "bin2_id"])
    return joined.groupBy("chrom", F.least("_b1", "_b2").alias("block1"), F.greatest("_b1", "_b2").alias("block2")).agg(F.sum(value).alias("total"))


def block_mean(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """Block sums over the product of the blocks' sizes, both ways; sizes: chrom, block, size."""
    one, two = (sizes.select("chrom", F.col("block").alias(f"block{i}"), F.col("size").alias(f"_n{i}")) for i in (1, 2))
    scaled = sums.join(one, ["chrom", "block1"]).join(two, ["chrom", "block2"]).withColumn("mean", F.col("total") / (F.col("_n1") * F.col("_n2")))
    return _both_ways(scaled.select("chrom", F.col("block1").alias("bin1_id"), F.col("block2").alias("bin2_id"), "mean"), "mean").toDF("chrom", "block1", "block2", "mean")


def coarsen(pixels: DataFrame, k: int, value: str = "cnt") -> DataFrame:
    wide = lambda c: F.floor(F.col(c) / k)
    return pixels.groupBy("chrom", wide("bin1_id").alias("bin1_id"), wide("bin2_id").alias("bin2_id")).agg(F.sum(value).alias(value))


def coarsen_bins(bins: DataFrame, k: int) -> DataFrame:
    return bins.groupBy("chrom", F.floor(F.col("bin_id") / k).alias("bin_id")).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def union_priority(a: DataFrame, b: DataFrame, value: str = "cnt") -> DataFrame:
    """a, and what only b has."""
    joined = a.select(*PIXEL, F.col(value).alias("_a")).join(b.select(*PIXEL, F.col(value).alias("_b")), PIXEL, "full")
    return joined.select(*PIXEL, F.coalesce("_a", "_b").alias(value))


def drop_unsupported(pixels: DataFrame, sites: DataFrame, count: str = "sites") -> DataFrame:
    """Pixels of which one bin at least holds a site; sites: bin_id with a count."""
    held = sites.where(F.col(count) > 0).select(F.col("bin_id").alias("_b"))
    one = held.withColumnRenamed("_b", "bin1_id").withColumn("_h1", F.lit(True))
    two = held.withColumnRenamed("_b", "bin2_id").withColumn("_h2", F.lit(True))
    return pixels.join(one, "bin1_id", "left").join(two, "bin2_id", "left").where(F.coalesce("_h1", F.lit(False)) | F.coalesce("_h2", F.lit(False))).select(*pixels.columns)


def point_lookup(points: DataFrame, pixels: DataFrame, value: str = "cnt") -> DataFrame:
    """points with the matrix value at (bin1_id, bin2_id), 0 where there is none."""
    return points.join(pixels.select(*PIXEL, value), PIXEL, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def diagonal(pixels: DataFrame) -> Column:
    return F.col("bin2_id") - F.col("bin1_id")


def _with_bins(rows: DataFrame, bins: int | DataFrame) -> DataFrame:
    """rows with _bins, the number of bins of their chromosome: the same for all, or a table chrom, bins."""
    return rows.withColumn("_bins", F.lit(bins)) if isinstance(bins, int) else rows.join(bins.select("chrom", F.col("bins").alias("_bins")), "chrom")


def diagonal_stats(pixels: DataFrame, bins: int | DataFrame, window: int, value: str = "cnt") -> DataFrame:
    """n, mean and sd of each diagonal 1 <= k < 2 * window, zeros counted without being made."""
    k = F.col("k")
    sums = pixels.withColumn("k", diagonal(pixels)).where((k >= 1) & (k < 2 * window)).groupBy("chrom", "k").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n = F.col("_bins") - k
    mean = F.col("s") / n
    return _with_bins(sums, bins).select("chrom", "k", n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest((F.col("q") - n * mean * mean) / (n - 1), F.lit(0.0))).alias("sd"))


def diagonal_zscore(pixels: DataFrame, bins: int | DataFrame, window: int, value: str = "cnt") -> DataFrame:
    """z of the cells that there are; those without a pixel are at -mean / sd of their diagonal, see empty_scores()."""
    stats = diagonal_stats(pixels, bins, window, value)
    joined = pixels.withColumn("k", diagonal(pixels)).join(F.broadcast(stats), ["chrom", "k"])  # 2 * window rows a chromosome
    return joined.where("sd > 0").select(*PIXEL, ((F.col(value) - F.col("mean")) / F.col("sd")).alias("z"))


def empty_scores(pixels: DataFrame, bins: int | DataFrame, window: int, value: str = "cnt") -> DataFrame:
    """chrom and fill: an array over the diagonals 0 <= k < 2 * window of the z of cells without a pixel; 0 on the main one and where a diagonal doesn't vary."""
    stats = diagonal_stats(pixels, bins, window, value).where("sd > 0").groupBy("chrom").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), -F.col("mean") / F.col("sd")))).alias("_m"))  # 2 * window entries
    return stats.select("chrom", F.transform(F.sequence(F.lit(0), F.lit(2 * window - 1)), lambda k: F.coalesce(F.col("_m")[k], F.lit(0.0))).alias("fill"))


def diagonal_mean(pixels: DataFrame, value: str = "cnt") -> DataFrame:
    """Mean of the entries that there are on each diagonal."""
    return pixels.groupBy("chrom", diagonal(pixels).alias("k")).agg(F.avg(value).alias("mean"))


def insulation(pixels: DataFrame, bins: int | DataFrame, window: int, value: str = "cnt") -> DataFrame:
    """Mean of the diamond of each bin i: rows i - w + 1 .. i, columns i + 1 .. i + w, as far as the matrix goes.

    A pixel lies in the diamonds of the bins between its own, so it is dealt to these and summed; no window over a chromosome is needed."""
    r, c = F.col("bin1_id"), F.col("bin2_id")
    near = pixels.where((c - r >= 1) & (c - r < 2 * window)).withColumn("i", F.explode(F.sequence(F.greatest(r, c - window), F.least(r + window - 1, c - 1))))
    i = F.col("i")
    area = F.least(i + 1, F.lit(window)) * F.least(F.col("_bins") - 1 - i, F.lit(window))
    return _with_bins(near.groupBy("chrom", "i").agg(F.sum(value).alias("s")), bins).select("chrom", F.col("i").alias("bin_id"), F.when(area > 0, F.col("s") / area).alias("score"))


def distance_band(pixels: DataFrame, bins: DataFrame, low: float, high: float) -> DataFrame:
    """Pixels with the distance of their bins' middles, from low to high; bins: bin_id, start, end."""
    middle = (F.col("start") + F.col("end")) / 2
    one, two = (bins.select(F.col("bin_id").alias(f"bin{i}_id"), middle.alias(f"_m{i}")) for i in (1, 2))
    return pixels.join(one, "bin1_id").join(two, "bin2_id").withColumn("distance", F.abs(F.col("_m2") - F.col("_m1"))).drop("_m1", "_m2").where(F.col("distance").between(low, high))


def quantile_filter(rows: DataFrame, part: list[str], value: str, q: float) -> DataFrame:
    """Rows of at least the q-th quantile of their part."""
    cut = rows.groupBy(*part).agg(F.percentile(value, F.lit(q)).alias("_cut"))
    return rows.join(F.broadcast(cut), part).where(F.col(value) >= F.col("_cut")).drop("_cut")


def blocks_of(pixels: DataFrame, d: int) -> DataFrame:
    """Pixels dealt to tiles [0, 5d], [4d, 10d], [9d, 15d], ... of which both bins lie in the tile; own is true in the tile that reports it (the first)."""
    first = lambda b: F.when(b == 0, 0).otherwise(5 * d * b - d)
    low = lambda c: F.greatest(F.ceil((F.col(c) - 5 * d) / (5 * d)), F.lit(0))
    high = lambda c: F.when(F.col(c) <= 5 * d, F.when(F.col(c) >= 4 * d, 1).otherwise(0)).otherwise(F.floor((F.col(c) + d) / (5 * d)))
    from_, to = F.greatest(low("bin1_id"), low("bin2_id")), F.least(high("bin1_id"), high("bin2_id"))
    dealt = pixels.where(from_ <= to).withColumn("block", F.explode(F.sequence(from_, to))).withColumn("own", F.col("block") == from_)
    return dealt.where((F.col("bin1_id") >= first(F.col("block"))) & (F.col("bin2_id") <= 5 * d * (F.col("block") + 1)))


def tiles_of(pixels: DataFrame, bins: DataFrame, reach: float) -> DataFrame:
    """Pixels within reach (bases between their bins' middles) dealt to tiles of six times reach, of which each shares one with the next, by where their bins end: chrom, block, bin1_id, bin2_id, cnt, near, low, high, behind as
    kernels.blobs_in_tiles() takes them. bins: chrom, bin_id, start, end. The tiles' bins are one row a tile."""
    end, middle = F.col("end"), (F.col("start") + F.col("end")) / 2
    first = lambda e: F.greatest(F.floor(e / (5 * reach)), F.lit(0))  # noqa: E731  tile k is from 5k - 1 (or 0) to 5k + 5 reaches
    last = lambda e: F.floor((e / reach + 1) / 5)
    dealt = bins.select("chrom", "bin_id", F.explode(F.sequence(first(end).cast("bigint"), F.greatest(last(end), first(end)).cast("bigint"))).alias("block"))
    edges = dealt.groupBy("chrom", "block").agg(F.min("bin_id").alias("low"), F.max("bin_id").alias("high"))
    before = edges.select("chrom", (F.col("block") + 1).alias("block"), F.col("high").alias("behind"))
    edges = edges.join(before, ["chrom", "block"], "left").withColumn("behind", F.coalesce("behind", F.lit(-1).cast("bigint")))
    one, two = (bins.select("chrom", F.col("bin_id").alias(f"bin{i}_id"), middle.alias(f"_m{i}"), end.alias(f"_e{i}")) for i in (1, 2))
    far = F.abs(F.col("_m2") - F.col("_m1"))
    near = pixels.where("cnt > 0").join(one, ["chrom", "bin1_id"]).join(two, ["chrom", "bin2_id"]).where(far <= reach)
    low, high = first(F.greatest("_e1", "_e2")), F.greatest(last(F.least("_e1", "_e2")), first(F.least("_e1", "_e2")))
    shared = near.where(low <= high).withColumn("block", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    return shared.join(edges, ["chrom", "block"]).select("chrom", "block", "bin1_id", "bin2_id", "cnt", (far < reach).alias("near"), "low", "high", "behind")


def expected_pairs(bins: DataFrame, width: int, steps: int) -> DataFrame:
    """How many pairs of bins could lie at each distance step: pairs of rounded middles, counted by how often each middle occurs."""
    m = bins.groupBy("chrom", F.floor((F.col("start") + F.col("end")) / 2 / width).alias("m")).agg(F.count("*").alias("n"))
    ahead = m.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("to", F.col("m") + F.col("step"))
    other = m.select("chrom", F.col("m").alias("to"), F.col("n").alias("n2"))
    n, n2 = F.col("n"), F.col("n2")
    return ahead.join(other, ["chrom", "to"]).groupBy("chrom", "step").agg(F.sum(F.when(F.col("step") == 0, n * (n + 1) / 2).otherwise(n * n2)).cast("bigint").alias("pairs"))
