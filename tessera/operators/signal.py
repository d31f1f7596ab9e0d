"""Tracks of values at equally spaced slots: pile-up, smoothing, background."""

from __future__ import annotations

from math import exp, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scans import nearby


def covered_single(rows: DataFrame) -> DataFrame:
    """first, last (inclusive) and center of single-end tags (start, end, strand): 76 positions around the middle of 150."""
    forward = F.col("strand") == "+"
    return rows.withColumns({"first": F.when(forward, F.col("start") + 37).otherwise(F.col("end") - 112), "last": F.when(forward, F.col("start") + 112).otherwise(F.col("end") - 37), "center": F.when(forward, F.col("start") + 75).otherwise(F.col("end") - 75)})


def covered_paired(rows: DataFrame, least: int = 100, most: int = 200) -> DataFrame:
    """first, last and center of the inner half of paired tags of least to most bases; rounded half to even."""
    n = F.col("end") - F.col("start")
    kept = rows.where((n + 1).between(least, most))
    whole = lambda x: F.bround(x).cast("bigint")
    return kept.withColumns({"first": whole(F.col("start") + 0.25 * n), "last": whole(F.col("end") - 0.25 * n), "center": whole((F.col("start") + F.col("end")) / 2)})


def pileup(rows: DataFrame, part: list[str], first: str, last: str, slot: int = 10) -> DataFrame:
    """part, slot and score: 1 / slot for each covered position [first, last], positions from 1."""
    a, b = F.floor((F.col(first) - 1) / slot), F.floor((F.col(last) - 1) / slot)
    dealt = rows.where((F.col(first) <= F.col(last)) & (F.col(first) >= 1)).withColumn("slot", F.explode(F.sequence(a, b)))
    covered = F.least(F.col(last), (F.col("slot") + 1) * slot) - F.greatest(F.col(first), F.col("slot") * slot + 1) + 1
    return dealt.groupBy(*part, "slot").agg(F.sum(covered / slot).alias("score"))


def gaussian(sigma: float, derivative: int = 0) -> list[tuple[int, float]]:
    """Offsets and weights of a Gaussian, or its first to third derivative, out to three sigmas."""
    out = []
    for o in range(-int(3 * sigma), int(3 * sigma) + 1):
        g = exp(-o * o / (2 * sigma * sigma)) / (sigma * sqrt(2 * pi))
        out.append((o, g * {0: 1.0, 1: -o / sigma**2, 2: (o * o - sigma**2) / sigma**4, 3: -(o**3 - 3 * sigma**2 * o) / sigma**6}[derivative]))
    return out


def convolve(track: DataFrame, part: list[str], index: str, value: str, kernel: list[tuple[int, float]], name: str = "smooth") -> DataFrame:
    """The sum of weight * value over the slots around each slot of the track; what lies beyond its ends is left out.

    Each value is dealt to the slots that it reaches, so the shuffle is by slot, whatever a part's length."""
    weights = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel])
    reach = track.select(*part, F.col(index).alias("_i"), F.col(value).alias("_v"), F.explode(weights).alias("k")).select(*part, (F.col("_i") + F.col("k.o")).alias(index), (F.col("_v") * F.col("k.w")).alias("_p"))
    return track.select(*part, index).join(reach, [*part, index]).groupBy(*part, index).agg(F.sum("_p").alias(name))


def background(track: DataFrame, part: list[str], index: str, value: str, reaches: list[int]) -> DataFrame:
    """Sums over the slots within each reach, and the largest and smallest of their means."""
    frames = {f"sum_{r}": (lambda w, r=r: F.sum(value).over(w.rangeBetween(-r, r))) for r in reaches} | {f"_m{r}": (lambda w, r=r: F.avg(value).over(w.rangeBetween(-r, r))) for r in reaches}
    out = nearby(track, part, index, max(reaches), frames)
    means = [F.col(f"_m{r}") for r in reaches]
    return out.withColumns({"most": F.greatest(*means) if len(means) > 1 else means[0], "least": F.least(*means) if len(means) > 1 else means[0]}).drop(*[f"_m{r}" for r in reaches])


def profile_over(ranges: DataFrame, track: DataFrame, part: list[str], ids: list[str], first: str, last: str, index: str, value: str) -> DataFrame:
    """height (largest) and area (sum) of the track in the slots [first, last] of each range, by an equi-join on the slots."""
    slots = ranges.withColumn(index, F.explode(F.sequence(F.col(first), F.col(last))))
    return slots.join(track, [*part, index]).groupBy(*part, *ids).agg(F.max(value).alias("height"), F.sum(value).alias("area"))


def shape_over(ranges: DataFrame, track: DataFrame, part: list[str], ids: list[str], first: str, last: str, index: str, raw: str, smooth: str) -> DataFrame:
    """height (largest raw value), correlation of raw and smooth values and concavity of the track in the slots [first, last] of each range; small constants keep them defined on flat ranges.

    concavity is the sum of the smooth values above their least one by that of the straight line that rises from the first value by (last - first) / n a slot."""
    slots = ranges.withColumn(index, F.explode(F.sequence(F.col(first), F.col(last)))).join(track, [*part, index])
    x, y = F.col(raw), F.col(smooth)
    n = F.count("*")
    sums = slots.groupBy(*part, *ids).agg(n.alias("_n"), F.max(raw).alias("height"), F.covar_pop(x, y).alias("_xy"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"), F.sum(y).alias("_s"), F.min(y).alias("_low"), F.min_by(y, F.col(index)).alias("_a"), F.max_by(y, F.col(index)).alias("_b"))
    c = {k: F.col(f"_{k}") for k in ("n", "xy", "xx", "yy", "s", "low", "a", "b")}
    correlation = (c["n"] * c["xy"] + 1e-8) / F.sqrt((c["n"] * c["xx"] + 1e-8) * (c["n"] * c["yy"] + 1e-8))
    line = c["n"] * c["a"] + (c["b"] - c["a"]) / c["n"] * c["n"] * (c["n"] - 1) / 2
    concavity = (c["s"] - c["n"] * c["low"] + 1e-7) / (line - c["n"] * c["low"] + 1e-7)
    return sums.withColumns({"correlation": correlation, "concavity": concavity}).drop(*[f"_{k}" for k in c])


STIRLING = 64  # counts from which on the factorial's logarithm is a series; its error there is below 1e-15


def poisson_tail(observed: Column, mean: Column, upper: bool = True) -> Column:
    """-log10 of the Poisson tail P(X >= observed), or P(X <= observed); 0 for the upper tail at 0.

    Terms are summed in a log scale away from the mean, where they fall, over 12 deviations and 40 terms more, beyond which nothing is left. A tail that holds
    the mean is 1 less the other one."""
    far = observed >= mean if upper else observed <= mean
    rises = far if upper else ~far
    k = observed + F.when(far, 0).otherwise(-1 if upper else 1)
    # the ratio of each term to the first is a product of mean / k, or k / mean
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(a: Column, i: Column) -> Column:
        ratio = F.when(rises, mean / (k + i + 1)).otherwise(F.greatest(k - i, F.lit(0)) / mean)
        return F.struct((a["term"] * ratio).alias("term"), (a["total"] + a["term"]).alias("total"))

    terms = F.sequence(F.lit(0), F.ceil(12 * F.sqrt(mean)).cast("int") + 40)
    few = F.greatest(F.least(k, F.lit(STIRLING)).cast("int"), F.lit(1))
    whole = k.cast("double")
    series = whole * F.log(whole) - whole + 0.5 * F.log(2 * F.lit(pi) * whole) + 1 / (12 * whole) - 1 / (360 * whole**3) + 1 / (1260 * whole**5)
    log_factorial = F.when(k > STIRLING, series).otherwise(F.aggregate(F.sequence(F.lit(1), few), F.lit(0.0), lambda a, i: a + F.log(i)))
    tail = k * F.log(mean) - mean - log_factorial + F.log(F.aggregate(terms, start, step, lambda a: a["total"]))
    score = F.round(F.when(far, -tail).otherwise(-F.log1p(-F.exp(tail))) / F.log(F.lit(10.0)), 8)
    return F.when(mean > 0, F.when(observed == 0, 0.0).otherwise(score) if upper else score)
