"""Balancing symmetric maps: factors for which every row sum meets its target.

Chromosomes with few pixels are solved each in a task (kernels.balance). For others the same Newton steps on logarithms, solved by conjugate gradients, run on tables: each product of the matrix and a vector is a join of the pixels, which are
bucketed by their columns once, with a row a bin, and a sum over rows. A round writes one table with a row a bin and reads one row a chromosome from it, so plans don't grow and no task holds a chromosome."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators.matrix import _both_ways
from tessera.tables import forget, keep, shared_dir

ALONE = 5_000_000  # pixels of a chromosome that one task may hold
TOLERANCE = 1e-8
MOST = 1500  # products
EPS = float(np.finfo(np.float32).eps)  # a little of the identity, for components without a diagonal
BIN = ["chrom", "bin_id"]


def balance_map(pixels: DataFrame, targets: DataFrame | None = None, alone: int = ALONE) -> DataFrame:
    """chrom, bin_id, bias of each chromosome's balanced map; targets: chrom, bin_id, target (1 where none is given)."""
    pixels = keep(pixels.select("chrom", "bin1_id", "bin2_id", "cnt"), "map")
    want = pixels.select("chrom", F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id")).distinct()
    want = want.withColumn("target", F.lit(1.0)) if targets is None else want.join(targets, BIN, "left").withColumn("target", F.coalesce("target", F.lit(1.0)))
    want = keep(want, "targets")
    large = pixels.groupBy("chrom").count().where(F.col("count") > alone).select("chrom")  # a row a chromosome
    large = [r.chrom for r in large.collect()]
    if not large:
        return kernels.balance_alone(pixels, want)
    inside = F.col("chrom").isin(large)
    return kernels.balance_alone(pixels.where(~inside), want.where(~inside)).unionByName(balance_wide(pixels.where(inside), want.where(inside)))


class _Matrix:
    """The symmetric matrix of all chromosomes as a table bucketed by columns."""

    def __init__(self, pixels: DataFrame):
        self.spark = pixels.sparkSession
        self.name = f"entries_{uuid.uuid4().hex}"
        both = _both_ways(pixels, "cnt").select("chrom", F.col("bin1_id").alias("row"), F.col("bin2_id").alias("bin_id"), F.col("cnt").cast("double").alias("cnt"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_dir(self.spark)}/{self.name}"
        both.repartition(buckets, *BIN).write.bucketBy(buckets, *BIN).sortBy(*BIN).option("path", path).saveAsTable(self.name)

    def times(self, state: DataFrame, vector: str, out: str) -> DataFrame:
        """state with a column for the product of the matrix and one of its columns."""
        entries = self.spark.table(self.name)
        sums = entries.join(state.select(*BIN, vector), BIN).groupBy("chrom", F.col("row").alias("bin_id")).agg(F.sum(F.col("cnt") * F.col(vector)).alias(out))
        return state.join(sums, BIN, "left").withColumn(out, F.coalesce(out, F.lit(0.0)) + EPS * F.col(vector))

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{self.name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def balance_wide(pixels: DataFrame, want: DataFrame, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """As kernels.balance, for all chromosomes at once and without one in a task."""
    spark = pixels.sparkSession
    matrix = _Matrix(pixels)
    products = 0

    def by_chrom(values: dict[str, dict[str, float]]) -> DataFrame:
        """A row a chromosome."""
        names = list(values)
        rows = [(c, *(float(values[n].get(c, 0.0)) for n in names)) for c in {c for v in values.values() for c in v}]
        return F.broadcast(spark.createDataFrame(rows, "chrom string, " + ", ".join(f"{n} double" for n in names)))

    def written(df: DataFrame, *old: DataFrame) -> DataFrame:
        out = keep(df, "balance")
        forget(*old)
        return out

    one = written(matrix.times(want.select(*BIN, F.col("target").alias("goal")).withColumn("one", F.lit(1.0)), "one", "first"))
    held = F.col("first") > EPS
    x = F.when(held, F.sqrt(F.greatest("goal", F.lit(1e-12)) / F.col("first"))).otherwise(1.0)
    state = written(one.select(*BIN, F.when(held, F.col("goal")).otherwise(0.0).alias("goal"), held.alias("held"), x.alias("x")), one)
    while True:
        s = F.col("x") * F.col("ax")
        fresh = matrix.times(state, "x", "ax").select(*BIN, "goal", "held", "x", s.alias("s"), F.when(F.col("held"), F.col("goal") - s).otherwise(0.0).alias("r"))
        fresh = fresh.withColumns({"g": F.when(F.col("held"), 2 * F.col("s")).otherwise(1.0), "d": F.lit(0.0)}).withColumn("p", F.col("r") / F.col("g"))
        state = written(fresh, state)
        products += 1
        sums = {r.chrom: r for r in state.groupBy("chrom").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("goal") * F.col("goal")).alias("gg"), F.sum(F.col("r") * F.col("p")).alias("rz")).collect()}
        open_ = {c for c, v in sums.items() if v.rr**0.5 > tolerance * max(1.0, v.gg**0.5)}
        if not open_ or products >= most:
            break
        rz, stop = {c: sums[c].rz for c in open_}, {c: 0.01 * sums[c].rr for c in open_}
        # chromosomes that are done stay as they are
        going = state.join(by_chrom({"go": dict.fromkeys(open_, 1.0)}), "chrom", "left").withColumn("p", F.coalesce("go", F.lit(0.0)) * F.col("p")).drop("go")
        going._kept_at, state = state._kept_at, going
        while rz and products < most:
            u = state.withColumn("u", F.col("x") * F.col("p"))
            q = F.when(F.col("held"), F.col("s") * F.col("p") + F.col("x") * F.col("au")).otherwise(0.0)
            state = written(matrix.times(u, "u", "au").withColumn("q", q).drop("u", "au"), state)
            products += 1
            r, g, p, q = (F.col(c) for c in "rgpq")
            got = state.groupBy("chrom").agg(F.sum(p * q).alias("pq"), F.sum(r * r / g).alias("rz"), F.sum(r * q / g).alias("rq"), F.sum(q * q / g).alias("qq"), F.sum(r * r).alias("r2"), F.sum(r * q).alias("r1"), F.sum(q * q).alias("r0")).collect()
            step, beta, left = {}, {}, {}
            for v in got:
                if v.chrom not in rz or v.pq <= 0:
                    continue
                a = step[v.chrom] = rz[v.chrom] / v.pq
                new = v.rz - 2 * a * v.rq + a * a * v.qq
                if v.r2 - 2 * a * v.r1 + a * a * v.r0 > stop[v.chrom]:
                    beta[v.chrom], left[v.chrom] = new / rz[v.chrom], new
            rz = left
            moved = state.join(by_chrom({"step": step, "beta": beta, "more": dict.fromkeys(left, 1.0)}), "chrom", "left").fillna(0.0, ["step", "beta", "more"]) if step else state.withColumns({c: F.lit(0.0) for c in ("step", "beta", "more")})
            moved = moved.withColumns({"d": F.col("d") + F.col("step") * F.col("p"), "r": F.col("r") - F.col("step") * F.col("q")})
            state_next = moved.withColumn("p", F.col("more") * (F.col("r") / F.col("g") + F.col("beta") * F.col("p"))).drop("q", "step", "beta", "more")
            state_next._kept_at = getattr(state, "_kept_at", None)  # it is read from there, until the next table is written
            state = state_next
        change = F.exp(F.greatest(F.least("d", F.lit(1.0)), F.lit(-1.0)))
        state = written(state.select(*BIN, "goal", "held", F.when(F.col("held"), F.col("x") * change).otherwise(1.0).alias("x")), state)
    matrix.drop()
    return state.select(*BIN, F.col("x").alias("bias"))
