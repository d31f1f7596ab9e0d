"""Positions of peaks on a track: pairs of inflections on the smoothed track are matched with its maxima, shoulders are set against their neighbours, borders are moved to the inflections of a finer track, twins are joined and noise is left out.

A track is chrom, slot, raw; slots without a row are 0. Everything is joins on slots, windows over ranges of slots (scans.carried) and windows over the few inflection pairs of one peak; a chromosome is never a task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import signal
from tessera.operators.intervals import overlap_join
from tessera.operators.scans import RANGE, carried, nearby
from tessera.tables import keep

PART = ["chrom"]
BUCKET = 64  # slots
DEAL = 4096  # slots that are made together
PLACES = 9  # decimals of a smoothed track, so that what cancels out is zero


@dataclass(frozen=True)
class Limits:
    """Fixed values of the method."""

    # (correlation above, concavity above, gap below, height ratio at least) of a shoulder that belongs to its neighbour
    together: tuple[tuple[float, float, float, float], ...] = ((0.8, 0.8, 100, 0), (0.2, 0.8, 10, 0.2), (-0.5, 0.8, 6, 0.4), (-1, 0.8, 20, 0.5), (-1, 0, 6, 0.7), (-1, 0, 10, 0.8))
    border_gap: float = 9  # slots to a neighbour that moves a border, and between both middles
    border_middles: float = 13
    twin_middles: float = 150  # bases
    twin_low: float = 5  # height that parts low twins from high ones
    # (height ratio above, gap of bases at most, depth share above) of low twins, high twins and either
    twins_low: tuple[float, float, float] = (0.80, 50, 0.75)
    twins_high: tuple[float, float, float] = (0.80, 70, 0.75)
    twins: tuple[tuple[float, float, float], ...] = ((0.90, 70, 0.60), (0.60, 40, 0.70))
    # noise: a mean curvature above the last number, and (area below, longest bent stretch at most), (slots at most), (height at most) or (longest bent stretch at most)
    noise_area: tuple[float, int, float] = (11, 5, -0.06)
    noise_slots: tuple[int, float] = (5, -0.03)
    noise_height: tuple[float, float] = (3, -0.01)
    noise_bent: tuple[tuple[int, float], ...] = ((2, -100.0), (3, -0.5), (4, -0.15))


def profile(track: DataFrame, sigma: float = 3.0, fine: float = 1.0) -> DataFrame:
    """chrom, slot, raw, smooth, slope, bend, third and fine_bend of all slots from a chromosome's first to its last: the track, its Gaussian smoothing with first to third derivative, and the second one of a finer smoothing.

    Neighbouring values come from one window over ranges of slots with a margin; each row is shuffled once."""
    ends = track.groupBy("chrom").agg(F.min("slot").alias("_a"), F.max("slot").alias("_z"))
    deals = ends.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / DEAL), F.floor(F.col("_z") / DEAL))))
    every = deals.select("chrom", F.col("_a").alias("origin"), F.explode(F.sequence(F.greatest("_a", F.col("_k") * DEAL), F.least("_z", (F.col("_k") + 1) * DEAL - 1))).alias("slot"))
    dense = every.join(track.select("chrom", "slot", F.col("raw").cast("double").alias("raw")), ["chrom", "slot"], "left").fillna(0.0, ["raw"])
    reach = int(3 * sigma)
    near = nearby(dense, PART, "slot", reach, {"_near": lambda w: F.array(*[F.coalesce(F.lag("raw", o).over(w), F.lit(0.0)) for o in range(-reach, reach + 1)])})

    def blurred(width: float, derivative: int) -> Column:
        return F.round(sum((F.col("_near")[o + reach] * F.lit(w) for o, w in signal.gaussian(width, derivative)), F.lit(0.0)), PLACES)

    curves = {"smooth": blurred(sigma, 0), "slope": blurred(sigma, 1), "bend": blurred(sigma, 2), "third": blurred(sigma, 3), "fine_bend": blurred(fine, 2)}
    return near.withColumns(curves).drop("_near")


CURVES = ["slope", "bend", "third", "fine_bend"]


def turns(profiled: DataFrame) -> DataFrame:
    """chrom, curve, slot, sign, behind (the last slot with the other sign before it), opened (where that began), closed (the last slot of this sign) and next (the first one behind it of the other sign) of each change of sign of a
    curve. Zeros don't count, and neither does a chromosome's first slot."""
    stacked = profiled.where("slot > origin").select("chrom", "slot", F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.signum(c).cast("int").alias("sign")) for c in CURVES])).alias("c")).select("chrom", "slot", "c.*").where("sign <> 0")
    key = [*PART, "curve"]
    seen = carried(stacked, key, ["slot"], before={"_last": F.struct("slot", "sign")}, width=RANGE)
    changes = seen.where("_last is null or _last.sign <> sign").select(*key, "slot", "sign", F.col("_last.slot").alias("behind"))
    near = carried(changes, key, ["slot"], before={"opened": F.col("slot")}, after={"_next": F.struct("slot", "behind")}, width=RANGE)
    ends = stacked.groupBy(*key).agg(F.max("slot").alias("_end"))  # four rows a chromosome
    return near.join(ends, key).select(*key, "slot", "sign", "behind", "opened", F.coalesce("_next.behind", "_end").alias("closed"), F.col("_next.slot").alias("next"))


def maxima(turned: DataFrame) -> DataFrame:
    """chrom, peak (where it begins), top_left, top_right, peak_end, and the peaks before and behind, of each rise and the fall after it."""
    falls = turned.where("curve = 'slope' and sign = -1 and opened is not null")
    flat = F.col("slot") - F.col("behind") > 1
    found = falls.select("chrom", F.col("opened").alias("peak"), F.when(flat, F.col("behind") + 1).otherwise(F.col("behind")).alias("top_left"), F.when(flat, F.col("behind") + 1).otherwise(F.col("slot")).alias("top_right"), F.col("closed").alias("peak_end"))
    return carried(found, PART, ["peak"], before={"peak_before": F.col("peak")}, after={"peak_behind": F.col("peak")})


def inflections(turned: DataFrame, curve: str) -> DataFrame:
    """chrom, first, last: from where a curve turns negative to where it turns positive; a stretch that doesn't end is none."""
    return turned.where((F.col("curve") == curve) & (F.col("sign") == -1) & F.col("next").isNotNull()).select("chrom", F.col("slot").alias("first"), (F.col("next") - 1).alias("last"))


def middles(turned: DataFrame) -> DataFrame:
    """chrom, m_first, m_last: the two slots around each place where the third derivative turns positive; zeros are between them."""
    gap = F.col("slot") - F.col("behind") > 1
    return turned.where("curve = 'third' and sign = 1 and behind is not null").select("chrom", F.when(gap, F.col("behind") + 1).otherwise(F.col("behind")).alias("m_first"), F.col("slot").alias("m_last"))


def touching(a: DataFrame, b: DataFrame, fa: str, la: str, fb: str, lb: str) -> DataFrame:
    """Pairs of rows on a chromosome whose closed ranges share a slot."""
    left, right = a.withColumn("_ea", F.col(la) + 1), b.withColumn("_eb", F.col(lb) + 1)
    return overlap_join(left, right, PART, fa, "_ea", fb, "_eb", BUCKET).drop("_ea", "_eb", "olp")


def over(ranges: DataFrame, profiled: DataFrame, ids: list[str], first: str, last: str, **sums: Column) -> DataFrame:
    """chrom, ids and aggregates of the profile's slots in the closed range of each row, by an equi-join on slots."""
    slots = ranges.select("chrom", *ids, F.explode(F.sequence(F.col(first), F.col(last))).alias("slot"))
    return slots.join(profiled, ["chrom", "slot"]).groupBy("chrom", *ids).agg(*[e.alias(n) for n, e in sums.items()])


def candidates(pairs: DataFrame, peaks: DataFrame) -> DataFrame:
    """chrom, first, last, main and the peak's columns: inflection pairs that touch one peak only and lie in it. main: they hold its top, else they are shoulders, of which those whose peak has a main one count."""
    met = touching(pairs, peaks, "first", "last", "peak", "peak_end")
    alone = met.withColumn("_n", F.count("*").over(Window.partitionBy("chrom", "first"))).where("_n = 1 and first >= peak and last <= peak_end").drop("_n")  # a window over the peaks of a pair
    main = F.col("top_left").between(F.col("first"), F.col("last")) | F.col("top_right").between(F.col("first"), F.col("last"))
    held = F.max(F.when(F.col("main"), F.struct("first", "last"))).over(Window.partitionBy("chrom", "peak"))  # a window over the pairs of a peak
    return alone.withColumn("main", main).withColumn("_main", held).where("_main is not null and (not main or first = _main.first)").withColumn("side", F.when(F.col("main"), 0).when(F.col("first") > F.col("_main.last"), 1).otherwise(-1)).drop("_main")


def grouped(found: DataFrame, mids: DataFrame, profiled: DataFrame, limits: Limits) -> DataFrame:
    """Candidates with what belongs together joined: first, last, kind (main, integrated, shoulder) and the peak's columns.

    A shoulder belongs to its neighbour towards the peak's top by the correlation of raw and smooth track and the concavity from its middles to that neighbour, their distance and the ratio of their heights."""
    tall = over(found, profiled, ["first"], "first", "last", own_height=F.max("raw"))
    w = Window.partitionBy("chrom", "peak").orderBy("first")  # the pairs of a peak
    inward = lambda c: F.when(F.col("side") == -1, F.lead(c).over(w)).when(F.col("side") == 1, F.lag(c).over(w))
    rows = keep(found.join(tall, ["chrom", "first"]).withColumns({"n_first": inward("first"), "n_last": inward("last"), "n_height": inward("own_height")}), "candidates")
    shoulders = rows.where("side <> 0")
    inside = touching(shoulders.select("chrom", "first", "last"), mids, "first", "last", "m_first", "m_last").groupBy("chrom", "first").agg(F.array_distinct(F.flatten(F.collect_list(F.array("m_first", "m_last")))).alias("_m"))
    each = shoulders.join(inside, ["chrom", "first"], "left").withColumn("m", F.explode(F.coalesce("_m", F.array_distinct(F.array("first", "last")))))
    left = F.col("side") == -1
    parts = each.select("chrom", "first", "m", F.when(left, F.col("m")).otherwise(F.col("n_last") + 1).alias("f"), F.when(left, F.col("n_first") - 1).otherwise(F.col("m")).alias("l"))
    shapes = signal.shape_over(parts, profiled.select("chrom", "slot", "raw", "smooth"), PART, ["first", "m"], "f", "l", "slot", "raw", "smooth")
    shapes = shapes.groupBy("chrom", "first").agg(F.min("correlation").alias("_r"), F.max("concavity").alias("_c"))
    gap = F.when(left, F.col("n_first") - F.col("last")).otherwise(F.col("first") - F.col("n_last"))
    ratio = F.when(F.col("n_height") > 0, F.col("own_height") / F.col("n_height")).otherwise(0.0)
    fits = F.lit(False)
    for r, c, far, share in limits.together:
        fits = fits | ((F.col("_r") > r) & (F.col("_c") > c) & (gap < far) & (ratio >= share))
    judged = rows.join(shapes, ["chrom", "first"], "left").withColumn("_belongs", F.coalesce(fits, F.lit(False)))
    # joined to the pair before: that is a shoulder on the left which belongs inward, or this is one on the right
    with_before = ((F.lag("side").over(w) == -1) & F.lag("_belongs").over(w)) | ((F.col("side") == 1) & F.col("_belongs"))
    numbered = judged.withColumn("_new", F.when(F.coalesce(with_before, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    kind = F.when(F.max("main") & (F.count("*") > 1), "integrated").when(F.max("main"), "main").otherwise("shoulder")
    return numbered.groupBy("chrom", "peak", "top_left", "top_right", "peak_end", "peak_before", "peak_behind", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), kind.alias("kind")).drop("_g")


def with_borders(rows: DataFrame, peaks: DataFrame, fine: DataFrame, profiled: DataFrame, limits: Limits) -> DataFrame:
    """rows with borders moved towards a near neighbour that is at least as high: to the farthest border of a finer inflection pair in the near half of the gap, out of those in the peaks before, of and behind the row's own (not the one
    behind a chromosome's last main peak); the first and last of these pairs are left out."""
    tops = over(rows, profiled, ["first"], "first", "last", height=F.max("raw"), rise=F.max("smooth"))
    placed = rows.join(tops, ["chrom", "first"])
    own = [F.col(c) for c in ("first", "last", "kind", "top_left", "top_right", "height", "rise")]
    near = carried(placed, PART, ["first"], before={"_b": F.struct(*own)}, after={"_a": F.struct(*own)})
    half = lambda f, l: (f + l) / 2  # noqa: E731, E741
    starts = lambda p: F.when(p("kind") == "shoulder", half(p("first"), p("last"))).otherwise(p("top_left"))  # noqa: E731  the middle of the row on the right, and on the left
    ends = lambda p: F.when(p("kind") == "shoulder", half(p("first"), p("last"))).otherwise(p("top_right"))
    me, before, behind = (lambda prefix: lambda c: F.col(f"{prefix}{c}"))(""), lambda c: F.col(f"_b.{c}"), lambda c: F.col(f"_a.{c}")
    higher = lambda p: (p("height") >= me("height")) & (p("rise") >= me("rise"))
    close = lambda gap, apart: (gap <= limits.border_gap) & (apart <= limits.border_middles)
    pulled_left = higher(before) & close(me("first") - before("last"), starts(me) - ends(before))
    pulled_right = higher(behind) & close(behind("first") - me("last"), starts(behind) - ends(me))
    near = keep(near.withColumns({"_left": F.coalesce(pulled_left, F.lit(False)), "_right": F.coalesce(pulled_right, F.lit(False)), "_next": F.col("_a.first")}).drop("_a", "_b"), "borders")
    last_main = near.groupBy("chrom").agg(F.max("peak").alias("_last_main"))  # a row a chromosome
    moved = near.where("_left or _right").join(F.broadcast(last_main), "chrom")
    behind_too = (F.col("peak") < F.col("_last_main")) | F.col("peak_before").isNull()
    asked = moved.select("chrom", "first", F.explode(F.array_compact(F.array("peak_before", "peak", F.when(behind_too, F.col("peak_behind"))))).alias("_p"))
    held = touching(fine.select("chrom", F.col("first").alias("f"), F.col("last").alias("l")), peaks.select("chrom", "peak", "peak_end"), "f", "l", "peak", "peak_end").select("chrom", F.col("peak").alias("_p"), "f", "l")
    choices = asked.join(held, ["chrom", "_p"]).groupBy("chrom", "first").agg(F.sort_array(F.collect_set(F.struct("f", "l"))).alias("_c"))  # of three peaks
    rows = near.join(choices, ["chrom", "first"], "left")
    others = lambda skip_first: F.slice("_c", 2 if skip_first else 1, F.greatest(F.size("_c") - 1, F.lit(0)))
    to_right = F.array_max(F.transform(F.filter(others(False), lambda c: (c["l"] > F.col("last")) & (c["l"] < half(F.col("last"), F.col("_next")))), lambda c: c["l"]))
    rows = rows.withColumn("_last", F.coalesce(F.when(F.col("_right"), to_right), "last"))
    rows = carried(rows, PART, ["first"], before={"_end": F.col("_last")})
    to_left = F.array_min(F.transform(F.filter(others(True), lambda c: (c["f"] < F.col("first")) & (c["f"] > half(F.col("_end"), F.col("first")))), lambda c: c["f"]))
    rows = rows.withColumn("_first", F.coalesce(F.when(F.col("_left"), to_left), "first"))
    return rows.select("chrom", F.col("_first").alias("first"), F.col("_last").alias("last"), "kind")


def with_twins(rows: DataFrame, profiled: DataFrame, limits: Limits) -> DataFrame:
    """rows with two neighbours of like height and a shallow valley between them as one, of kind twin_main or twin_shoulder; one that could join either side takes the shallower valley, or else the shorter gap, or neither."""
    stats = over(rows, profiled, ["first"], "first", "last", height=F.max("raw"), rise=F.max("smooth"))
    placed = rows.join(stats, ["chrom", "first"])
    pairs = carried(placed, PART, ["first"], after={"_a": F.struct("first", "last", "height", "rise", "kind")})
    gap = 10 * (F.col("_a.first") - F.col("last"))
    apart = 5 * (F.col("_a.first") + F.col("_a.last") - F.col("first") - F.col("last"))
    pairs = keep(pairs.withColumn("gap", gap).withColumn("_near", F.coalesce(apart < limits.twin_middles, F.lit(False))), "pairs")
    valleys = over(pairs.where("_near").select("chrom", "first", (F.col("last") + 1).alias("f"), (F.col("_a.first") - 1).alias("l")), profiled, ["first"], "f", "l", depth=F.min("smooth"))
    pairs = pairs.join(valleys, ["chrom", "first"], "left")
    low, high = F.least("height", "_a.height"), F.greatest("height", "_a.height")
    ratio = F.when(high > 0, low / high).otherwise(0.0)
    share = 2 * F.col("depth") / (F.col("rise") + F.col("_a.rise"))
    rule = lambda r: (ratio > r[0]) & (F.col("gap") <= r[1]) & (share > r[2])
    fits = F.when(high < limits.twin_low, rule(limits.twins_low)).otherwise(rule(limits.twins_high))
    for r in limits.twins:
        fits = fits | rule(r)
    pairs = pairs.withColumn("_join", F.col("_near") & F.coalesce(fits, F.lit(False)))
    pairs = carried(pairs, PART, ["first"], before={"_b": F.struct("_join", "depth", "gap")})
    ahead, back = F.col("_join"), F.coalesce(F.col("_b._join"), F.lit(False))
    to_right = (F.col("depth") > F.col("_b.depth")) | ((F.col("depth") == F.col("_b.depth")) & (F.col("gap") < F.col("_b.gap")))
    to_left = (F.col("depth") < F.col("_b.depth")) | ((F.col("depth") == F.col("_b.depth")) & (F.col("gap") > F.col("_b.gap")))
    choice = F.when(ahead & (~back | to_right), 1).when(back & (~ahead | to_left), -1).otherwise(0)
    pairs = carried(pairs.withColumn("_go", choice), PART, ["first"], before={"_go_before": F.col("_go")}, after={"_go_behind": F.col("_go")})
    twin = (F.col("_go") == 1) & (F.col("_go_behind") == -1)
    taken = (F.col("_go") == -1) & (F.col("_go_before") == 1)
    main = (F.col("kind") != "shoulder") | (F.col("_a.kind") != "shoulder")
    kind = F.when(F.coalesce(twin, F.lit(False)), F.when(main, "twin_main").otherwise("twin_shoulder")).otherwise(F.col("kind"))
    return pairs.where(~F.coalesce(taken, F.lit(False))).select("chrom", "first", F.when(F.coalesce(twin, F.lit(False)), F.col("_a.last")).otherwise(F.col("last")).alias("last"), kind.alias("kind"))


def without_noise(rows: DataFrame, profiled: DataFrame, limits: Limits) -> DataFrame:
    """chrom, first, last, kind, height and area of the rows that aren't noise: too small, short or flat for their curvature."""
    in_order = F.sort_array(F.collect_list(F.struct("slot", (F.col("bend") < 0).alias("bent"))))  # of one row's slots
    stats = over(rows, profiled, ["first"], "first", "last", n=F.count("*"), height=F.max("raw"), area=F.sum("raw"), curve=F.avg("bend"), _s=in_order)
    step = lambda a, x: F.struct(F.when(x["bent"], a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["most"], F.when(x["bent"], a["now"] + 1).otherwise(0)).alias("most"))
    longest = F.aggregate("_s", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])
    stats = stats.withColumn("bent", longest).drop("_s")
    curve = F.col("curve")
    noise = (F.col("area") < limits.noise_area[0]) & (F.col("bent") <= limits.noise_area[1]) & (curve > limits.noise_area[2])
    noise = noise | ((F.col("n") <= limits.noise_slots[0]) & (curve > limits.noise_slots[1])) | ((F.col("height") <= limits.noise_height[0]) & (curve > limits.noise_height[1]))
    for bent, least in limits.noise_bent:
        noise = noise | ((F.col("bent") <= bent) & (curve > least))
    return rows.join(stats, ["chrom", "first"]).where(~noise).select("chrom", "first", "last", "kind", "height", "area")


#: The property of a called position by its kind.
PROPERTIES = {"main": "MainPeak", "integrated": "MainPeak+Shoulder", "shoulder": "Shoulder", "twin_main": "MainPeak:doublet", "twin_shoulder": "Shoulder:doublet"}


def precise(track: DataFrame, limits: Limits | None = None, filtered: bool = True) -> DataFrame:
    """chrom, first, last, height, area, property of the positions called on a track (chrom, slot, raw). filtered: twins are joined and noise is left out.

    A peak of the smoothed track that a chromosome's last slot cuts off, on its way up, is none; one that ends with the chromosome counts. Without candidates for a border it stays. Of a chromosome with one position none is joined."""
    limits = limits or Limits()
    profiled = keep(profile(track), "profile")
    turned = keep(turns(profiled), "turns")
    peaks = keep(maxima(turned), "peaks")
    found = candidates(inflections(turned, "bend"), peaks)
    rows = keep(grouped(found, middles(turned), profiled, limits), "groups")
    rows = keep(with_borders(rows, peaks, inflections(turned, "fine_bend"), profiled, limits), "positions")
    if filtered:
        rows = without_noise(keep(with_twins(rows, profiled, limits), "twins"), profiled, limits)
    else:
        rows = rows.join(over(rows, profiled, ["first"], "first", "last", height=F.max("raw"), area=F.sum("raw")), ["chrom", "first"])
    named = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in PROPERTIES.items()])
    return rows.select("chrom", "first", "last", "height", "area", named.alias("property"))
