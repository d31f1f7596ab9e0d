"""Runs of rows in an order: run lengths, tolerant zero runs, regions of allowed ids, groups of near pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scans import RANGE, carried, numbered

PIXEL_RANGE = 256  # rows of a map


def with_runs(rows: DataFrame, part: list[str], order: list[str], value: str, name: str = "run", width: int = RANGE) -> DataFrame:
    """Numbers of runs of equal values (nulls are equal) from 1."""
    v = F.col(value)
    seen = carried(rows, part, order, before={"_before": F.struct(v.alias("v"))}, width=width)
    changed = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(v)
    return carried(seen.withColumn("_c", changed.cast("int")), part, order, sums={name: F.col("_c")}, width=width).drop("_before", "_c")


def run_lengths(rows: DataFrame, part: list[str], index: str, value: str, width: int = RANGE) -> DataFrame:
    """part, value, first, last and n of each run of equal values."""
    slim = rows.select(*part, index, value)
    return with_runs(slim, part, [index], value, width=width).groupBy(*part, "run", value).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))


def zero_runs(rows: DataFrame, part: list[str], index: str, value: str, tolerance: int = 2, least: int = 10, width: int = RANGE) -> DataFrame:
    """Runs of zeros of a track without holes in its index, with at least `least` zeros; up to `tolerance` other values in a row inside don't end a run."""
    runs = run_lengths(rows.withColumn("_zero", (F.col(value) == 0)), part, index, "_zero", width)
    # what ends a run of zeros is a longer run of other values; shorter ones belong to the run around
    ends = (~F.col("_zero") & (F.col("n") > tolerance)).cast("int")
    marked = carried(runs, part, ["first"], sums={"_g": ends}, width=width).where(F.col("_zero") | (F.col("n") <= tolerance))
    zero = F.col("_zero")
    out = marked.groupBy(*part, "_g").agg(F.min(F.when(zero, F.col("first"))).alias("first"), F.max(F.when(zero, F.col("last"))).alias("last"), F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("zeros"))
    return out.where(F.col("zeros") >= least).drop("_g")


def regions_of_ids(ids: DataFrame, part: list[str], index: str, least: int = 3, width: int = RANGE) -> DataFrame:
    """Runs of consecutive ids with last - first >= least."""
    runs = numbered(ids, part, [index], "_no", width).groupBy(*part, (F.col(index) - F.col("_no")).alias("_g")).agg(F.min(index).alias("first"), F.max(index).alias("last"))
    return runs.where(F.col("last") - F.col("first") >= least).drop("_g")


def pixel_groups(pixels: DataFrame, part: list[str], x: str, y: str, window: int, most: int | None = None, width: int = PIXEL_RANGE) -> DataFrame:
    """Pixels in order; one farther than window from the one before, in either axis, begins a group, and groups are split at `most` pixels (2 * window^2)."""
    most = 2 * window * window if most is None else most
    near = carried(pixels, part, [x, y], before={"_px": F.col(x), "_py": F.col(y)}, width=width)
    far = (F.abs(F.col(x) - F.col("_px")) > window) | (F.abs(F.col(y) - F.col("_py")) > window)
    begins = F.coalesce(far, F.lit(True)).cast("int")
    grouped = carried(near.withColumn("_c", begins), part, [x, y], sums={"group": F.col("_c"), "_no": F.lit(1)}, width=width)
    # the number of the group's first pixel, which is the last one that begins a group
    with_first = carried(grouped, part, [x, y], latest={"_first": F.when(F.col("_c") == 1, F.col("_no"))}, width=width)
    return with_first.withColumn("split", F.floor((F.col("_no") - F.col("_first")) / most)).drop("_px", "_py", "_c", "_no", "_first")


def peaks(grouped: DataFrame, part: list[str], x: str, y: str, value: str) -> DataFrame:
    """The pixel with the largest value of each group; of equal ones the first."""
    best = F.max_by(F.struct(x, y, value), F.struct(F.col(value), -F.col(x), -F.col(y)))
    return grouped.groupBy(*part, "group", "split").agg(best.alias("_b")).select(*part, "group", "split", F.col("_b")[x].alias(x), F.col("_b")[y].alias(y), F.col("_b")[value].alias(value))


def local_maxima(rows: DataFrame, part: list[str], index: str, value: str, width: int = RANGE) -> DataFrame:
    """Plateaus that are higher than what stands on both sides: first, last and value."""
    runs = carried(run_lengths(rows, part, index, value, width), part, ["first"], before={"_left": F.col(value)}, after={"_right": F.col(value)}, width=width)
    return runs.where((F.col(value) > F.col("_left")) & (F.col(value) > F.col("_right"))).select(*part, "first", "last", value)


def local_minima(rows: DataFrame, part: list[str], index: str, value: str) -> DataFrame:
    """Plateaus that are lower than what stands on both sides: first, last and value."""
    return local_maxima(rows.withColumn(value, -F.col(value)), part, index, value).withColumn(value, -F.col(value))


def negative_runs(rows: DataFrame, part: list[str], index: str, value: str, width: int = RANGE) -> DataFrame:
    """Runs of negative values between sign changes; zeros don't count."""
    signed = rows.where(F.col(value) != 0).withColumn("_s", F.signum(value))
    return run_lengths(signed, part, index, "_s", width).where("_s < 0").select(*part, "first", "last")
