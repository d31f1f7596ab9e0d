"""The benchmark tables as a genome: event types are chromosomes, seconds since 2024-01-01 positions, consecutive events of a user read pairs, and bins of varying width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.intervals import best_match, overlap_join, self_pairs
from tessera.operators.matrix import from_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, chrom, pos, value."""
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("chrom"), second.alias("pos"), "value")


def bins(spark: SparkSession, wide: bool = False) -> DataFrame:
    """bin_id, bs, be: 720 bins of an hour less up to half of it, or 120 of six hours."""
    width, step, n = (21600, 1800, 120) if wide else (3600, 300, 720)
    return spark.range(n).selectExpr("id bin_id", f"{width} * id bs", f"{width} * id + {width} - (id % 7) * {step} be")


def pairs(rows: DataFrame, ahead: int) -> DataFrame:
    """pair_id, chrom1, p1, chrom2, p2: each event with the one `ahead` of it of the same user."""
    w = Window.partitionBy("user_id").orderBy("pos", "event_id")
    return rows.select(F.col("event_id").alias("pair_id"), F.col("chrom").alias("chrom1"), F.col("pos").alias("p1"), F.lead("chrom", ahead).over(w).alias("chrom2"), F.lead("pos", ahead).over(w).alias("p2"))


def hits(rows: DataFrame, places: DataFrame, read: int, width: int) -> DataFrame:
    """rows (pair_id, chrom, s) met with the bins that their reads [s, s + read) overlap. The bins are a table of fixed size and are broadcast."""
    met = overlap_join(rows.withColumn("e", F.col("s") + read), places, [], "s", "e", "bs", "be", width, hint="broadcast")
    return met.select("pair_id", "chrom", "bin_id", "olp")


def contact_hits(spark: SparkSession, sf_dir: str, ahead: int = 1, wide: bool = False) -> DataFrame:
    """pair_id, chrom, b1, b2, olp_sum of both ends' hits."""
    read, width = (5400, 21600) if wide else (900, 3600)
    p, b = pairs(events(spark, sf_dir), ahead).where("chrom1 = chrom2"), bins(spark, wide)
    one = hits(p.select("pair_id", F.col("chrom1").alias("chrom"), F.col("p1").alias("s")), b, read, width)
    two = hits(p.select("pair_id", F.col("chrom2").alias("chrom"), F.col("p2").alias("s")), b, read, width)
    return self_pairs(one, two)


def contact_map(spark: SparkSession, sf_dir: str, ahead: int = 1, wide: bool = False) -> DataFrame:
    """chrom, bin1_id, bin2_id, cnt of best matches."""
    found = contact_hits(spark, sf_dir, ahead, wide)
    best = best_match(found, ["pair_id", "chrom"], [-F.col("olp_sum"), F.col("b1"), F.col("b2")], ["b1", "b2"])
    return from_pairs(best)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, hour, n, value of all 720 hours of each chromosome, also the empty ones (value is then null)."""
    e = events(spark, sf_dir)
    seen = e.groupBy("chrom", F.floor(F.col("pos") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    grid = e.select("chrom").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(719).cast("bigint"))))
    return grid.join(seen, ["chrom", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
