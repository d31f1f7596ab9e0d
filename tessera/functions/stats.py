"""Robust statistics, ranks, false-discovery control and interpolation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scans import RANGE, carried, numbered
from tessera.tables import keep


#: The sketch's error of a rank, as a share of the rows, is one by this.
ACCURACY = 10_000


def quantiles(rows: DataFrame, part: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A row a part with exact quantiles, name -> (expression, share from 0 to 1), interpolated as percentile() does; null without values.

    percentile() hands the counts of all distinct values of a part to one task. Here a sketch first brackets each quantile by two values, five errors off on either side; rows below the bracket are counted, and only values inside it, a few
    thousandths of the rows or equal ones, are brought together, with their counts. A bracket that missed its quantile would be an error, not a result."""
    at = {n: F.when(~F.isnan(x.cast("double")), x.cast("double")).otherwise(F.when(x.isNotNull(), F.lit(float("inf")))) for n, (x, _) in wanted.items()}  # NaN is largest
    edge = lambda q: min(max(q, 0.0), 1.0)
    held = rows.select(*part, *[F.struct(at[n].alias("a"), x.cast("double").alias("x")).alias(f"_{i}") for i, (n, (x, _)) in enumerate(wanted.items())])
    numbers = [f"_{i}" for i in range(len(wanted))]
    sketch = held.groupBy(*part).agg(*[F.percentile_approx(f"{c}.a", [edge(q - 5 / ACCURACY), edge(q + 5 / ACCURACY)], ACCURACY).alias(f"{c}b") for c, (_, q) in zip(numbers, wanted.values(), strict=True)], *[F.count(f"{c}.a").alias(f"{c}n") for c in numbers])
    sketch = keep(sketch, "brackets")
    same = [F.col(f"_p{i}").eqNullSafe(F.col(c)) for i, c in enumerate(part)]
    known = F.broadcast(sketch.withColumnsRenamed({c: f"_p{i}" for i, c in enumerate(part)}))
    met = held.join(known, on=functools.reduce(lambda x, y: x & y, same), how="inner") if part else held.crossJoin(known)
    low, inside = (lambda c: F.col(f"{c}.a") < F.col(f"{c}b")[0]), (lambda c: (F.col(f"{c}.a") >= F.col(f"{c}b")[0]) & (F.col(f"{c}.a") <= F.col(f"{c}b")[1]))
    below = met.groupBy(*part).agg(*[F.count(F.when(low(c), 1)).alias(c) for c in numbers])
    below = below.select(*part, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(-1).alias("s"), F.lit(None).cast("double").alias("x"), F.col(c).alias("c")) for i, c in enumerate(numbers)])).alias("e")).select(*part, "e.*")
    some = met.where(functools.reduce(lambda x, y: x | y, [inside(c) for c in numbers]))  # few rows, so what follows is cheap
    marked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(0).alias("s"), F.col(f"{c}.x").alias("x"), inside(c).alias("in")) for i, c in enumerate(numbers)]))
    counts = some.select(*part, marked.alias("e")).where("e.in").select(*part, "e.i", "e.s", "e.x").groupBy(*part, "i", "s", "x").agg(F.count("*").alias("c")).unionByName(below)
    upto = F.sum("c").over(Window.partitionBy(*part, "i").orderBy("s", "x").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sketch.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], *[f"{c}n" for c in numbers])
    placed = counts.withColumn("u", upto)
    placed = placed.join(F.broadcast(sizes), on=functools.reduce(lambda x, y: x & y, same), how="inner") if part else placed.crossJoin(F.broadcast(sizes))
    ranks = {c: (F.col(f"{c}n") - 1) * F.lit(q) for c, (_, q) in zip(numbers, wanted.values(), strict=True)}
    at_rank = lambda i, k: F.max(F.when((F.col("i") == i) & (F.col("s") == 0) & (F.col("u") > k) & (F.col("u") - F.col("c") <= k), F.col("x")))
    picks = placed.groupBy(*part).agg(*[at_rank(i, f(r)).alias(f"{c}{k}") for i, (c, r) in enumerate(ranks.items()) for k, f in (("l", F.floor), ("h", F.ceil))])
    picks = picks.withColumnsRenamed({c: f"_p{i}" for i, c in enumerate(part)})
    joined = sketch.join(picks, on=functools.reduce(lambda x, y: x & y, same), how="left") if part else sketch.crossJoin(picks)
    out = []
    for name, (c, r) in zip(wanted, ranks.items(), strict=True):
        low, high = F.col(f"{c}l"), F.col(f"{c}h")
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        line = F.when((F.floor(r) == F.ceil(r)) | (low == high), low).otherwise((F.ceil(r) - r) * low + (r - F.floor(r)) * high)
        out.append(F.when(F.col(f"{c}n") > 0, F.when(low.isNull() | high.isNull(), missed).otherwise(line)).alias(name))
    return joined.select(*part, *out)


def fences(rows: DataFrame, part: list[str], wanted: dict[str, Column]) -> DataFrame:
    """A row a part with q75 + 1.5 * (q75 - q25) of each expression."""
    found = quantiles(rows, part, {f"{n}_{k}": (x, q) for n, x in wanted.items() for k, q in (("low", 0.25), ("high", 0.75))})
    return found.select(*part, *[(F.col(f"{n}_high") + 1.5 * (F.col(f"{n}_high") - F.col(f"{n}_low"))).alias(n) for n in wanted])


def with_median(rows: DataFrame, part: list[str], value: str) -> DataFrame:
    """rows with _median and _mad (median absolute deviation) of their part. Two aggregates joined back: a window would hold a part in one task."""
    m = rows.groupBy(*part).agg(F.median(value).alias("_median"))
    near = rows.join(F.broadcast(m), part)
    mad = near.groupBy(*part).agg(F.median(F.abs(F.col(value) - F.col("_median"))).alias("_mad"))
    return near.join(F.broadcast(mad), part)


def outliers(rows: DataFrame, part: list[str], value: str, threshold: float = 5.0) -> DataFrame:
    """rows with outlier: modified z-score above threshold; zeros are left out of the statistics and are no outliers; false where the deviation is 0."""
    stats = with_median(rows.where(F.col(value) != 0).select(*part, value), part, value).select(*part, "_median", "_mad").distinct()
    joined = rows.join(F.broadcast(stats), part, "left")
    score = 0.6745 * F.abs(F.col(value) - F.col("_median")) / F.col("_mad")
    return joined.withColumn("outlier", F.when((F.col(value) != 0) & (F.col("_mad") > 0), score > threshold).otherwise(False)).drop("_median", "_mad")


def mad_band(rows: DataFrame, part: list[str], value: str, n: float) -> DataFrame:
    """rows with inside: within n deviations of the median."""
    return with_median(rows, part, value).withColumn("inside", F.abs(F.col(value) - F.col("_median")) <= n * F.col("_mad")).drop("_median", "_mad")


def bh(rows: DataFrame, part: list[str], p: str, order: list[str]) -> DataFrame:
    """rows with q, the Benjamini-Hochberg value of p (from 0 to 1) within the part; null where p is.

    Rows are dealt to ranges of p that get narrower towards 0, so a part is no task: ranks begin after the rows of the ranges below, and the smallest value behind a row is that in its range or in a range above.
    Windows hold one range, or the ranges of a part, of which there are a few ten thousand at most."""
    span = F.when(F.col(p) > 0, F.floor(-64 * F.log2(F.col(p)))).otherwise(F.lit(1 << 20))  # 0 where p is 1
    dealt = rows.withColumn("_s", span.cast("long"))
    across = Window.partitionBy(*part).orderBy(F.desc("_s"))  # ranges by rising p
    counts = dealt.where(F.col(p).isNotNull()).groupBy(*part, "_s").agg(F.count("*").alias("_n"))
    sizes = counts.withColumn("_below", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*part)))
    own = Window.partitionBy(*part, "_s").orderBy(F.desc(p), *[F.desc(c) for c in order])  # the last comes first
    joined = dealt.join(sizes, [*part, "_s"], "left")
    raw = joined.withColumn("_q", F.col(p) * F.col("_all") / (F.col("_below") + F.col("_n") + 1 - F.row_number().over(own)))
    least = raw.groupBy(*part, "_s").agg(F.min("_q").alias("_m"))
    above = least.withColumn("_above", F.min("_m").over(Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    behind = F.least(F.min("_q").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_above", F.lit(1.0))  # least() leaves nulls out
    out = raw.join(above, [*part, "_s"], "left").withColumn("q", F.when(F.col(p).isNotNull(), behind))
    return out.drop("_s", "_n", "_below", "_all", "_q", "_above")


def average_rank(rows: DataFrame, part: list[str], value: str) -> DataFrame:
    """rows with avg_rank, the mean of the ranks that equal values share."""
    ties = rows.groupBy(*part, value).agg(F.count("*").alias("_t"))
    below = F.coalesce(F.sum("_t").over(Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(ties.withColumn("avg_rank", below + (F.col("_t") + 1) / 2), [*part, value]).drop("_t")


def equal_mass(rows: DataFrame, part: list[str], order: list[str], mass: str, bins: int) -> DataFrame:
    """rows with mass_bin from 0: where the running sum stands among `bins` equal shares of the total."""
    ranges = [F.col(order[0]), *[F.floor(F.col(c) / RANGE) for c in order[1:2]]]  # the first order column alone may hold a large share
    summed = carried(rows, part, order, sums={"_upto": F.col(mass)}, ranges=ranges)
    total = rows.groupBy(*part).agg(F.sum(mass).alias("_total"))  # a row a part
    before = F.col("_upto") - F.col(mass)
    return summed.join(F.broadcast(total), part).withColumn("mass_bin", F.least(F.floor(before * bins / F.col("_total")), F.lit(bins - 1))).drop("_upto", "_total")


def regression(rows: DataFrame, part: list[str], y: str, x: str) -> DataFrame:
    return rows.groupBy(*part).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def interpolate(rows: DataFrame, part: list[str], index: str, value: str) -> DataFrame:
    """rows with filled: missing values on the line between the known ones around, by row number; flat at the ends."""
    known = F.when(F.col(value).isNotNull(), F.struct("_r", value))
    both = carried(numbered(rows, part, [index], "_r"), part, [index], latest={"_a": known}, coming={"_b": known})
    span = F.col("_b._r") - F.col("_a._r")
    line = F.col(f"_a.{value}") + (F.col(f"_b.{value}") - F.col(f"_a.{value}")) * (F.col("_r") - F.col("_a._r")) / span
    filled = F.when(F.col("_a").isNull(), F.col(f"_b.{value}")).when(F.col("_b").isNull(), F.col(f"_a.{value}")).when(span == 0, F.col(value)).otherwise(line)
    return both.withColumn("filled", filled).drop("_r", "_a", "_b")


def positioning(rows: DataFrame, width: str, height: str, area: str, peak: str, valley: str) -> DataFrame:
    """rows with position_score: heights, areas and p-values, each over its fence, by three widths over theirs; valleys above their fence are first set to the mean valley."""
    rows = keep(rows, "rows")  # read by each of the steps
    first = fences(rows, [], {"_fv0": F.col(valley)}).crossJoin(rows.agg(F.avg(valley).alias("_mv")))
    cut = rows.join(F.broadcast(first)).withColumn("_v", F.when(F.col(valley) > F.col("_fv0"), F.col("_mv")).otherwise(F.col(valley)))
    found = fences(cut, [], {"_fw": F.col(width), "_fh": F.col(height), "_fa": F.col(area), "_fp": F.col(peak), "_fv": F.col("_v")})
    s = (F.col(height) / F.col("_fh") + F.log2(F.col(peak) / F.col("_fp") * F.col("_v") / F.col("_fv") + 1) + F.col(area) / F.col("_fa")) / (3 * F.col(width) / F.col("_fw"))
    scored = cut.join(F.broadcast(found)).withColumn("_s", s)  # one row each
    last = fences(scored, [], {"_fs": F.col("_s")})
    return scored.join(F.broadcast(last)).withColumn("position_score", 20 * F.col("_s") / F.col("_fs")).select(*rows.columns, "position_score")


def md(a: Column, b: Column) -> Column:
    return F.log2((a + 1) / (b + 1))


def md_pairs(rows: DataFrame, samples: list[str]) -> DataFrame:
    """rows with one_to_two, ... for every pair of sample columns: the M value of the first against the second."""
    return rows.withColumns({f"{x}_to_{y}": md(F.col(x), F.col(y)) for i, x in enumerate(samples) for y in samples[i + 1 :]})


def natural_key(name: str) -> list[Column]:
    """Sort keys by which chr2 comes before chr10."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return [F.regexp_replace(name, r"\d.*$", ""), F.coalesce(digits.try_cast("bigint"), F.lit(1 << 40)), F.col(name)]


def zeros_after_point(smallest: Column) -> Column:
    """10^(zeros behind the decimal point of a positive number below 1, plus 1), 1 for others: the factor that makes intensities whole numbers."""
    return F.when((smallest > 0) & (smallest < 1), F.pow(F.lit(10.0), F.ceil(-F.log10(smallest)))).otherwise(1.0)


def qc_report(stats: DataFrame) -> DataFrame:
    """metric, n and percent (of the total) from one row of named counts with a column total."""
    names = [c for c in stats.columns if c != "total"]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("n"), F.round(100.0 * F.col(c) / F.col("total"), 2).alias("percent")) for c in names]))
    return stats.select(rows.alias("r")).select("r.*")
