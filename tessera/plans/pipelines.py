"""Compositions: bins from nucleosomes, the merged map, segments, the region map, and loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels, stats
from tessera.functions.spline import smoothed
from tessera.operators import intervals, islands, loops, matrix, segments
from tessera.operators.balancing import balance_map
from tessera.operators.scans import RANGE, carried, numbered
from tessera.tables import keep


def build_bins(nucleosomes: DataFrame, genes: DataFrame, chroms: DataFrame, score_cut: float | None = None) -> DataFrame:
    """chrom, start, end, kind, spacing, positioning, nuc and dense bin_id from nucleosomes (chrom, start, end, height, auc, property, nlp_peak, nlp_valley), genes and chromosome lengths (chrom, length).

    Cores are spaced and scored; shoulders below score_cut (where the density of their areas first reaches 3/4 of its peak, if none is given) go; the others are extended and moved apart; what lies between is filtered, annotated, filtered
    again in genes, typed and cut into pieces."""
    width = F.col("end") - F.col("start")
    nucleosomes = keep(nucleosomes, "nucleosomes")  # each of the tables below is made once
    n = nucleosomes.withColumn("width", width)
    n = stats.positioning(n, "width", "height", "auc", "nlp_peak", "nlp_valley").withColumnRenamed("position_score", "positioning")
    n = n.withColumn("_m", ((F.col("start") + F.col("end")) / 2).cast("bigint"))
    n = intervals.spacing(n, ["chrom"], ["start", "end"], "_m")
    if score_cut is None:
        score_cut = kernels.area_cut(nucleosomes.where("property = 'Shoulder'"), "auc")
    if score_cut is not None:
        n = n.where((F.col("property") != "Shoulder") | (F.col("auc") >= score_cut))
    n = intervals.deoverlap(intervals.extend_short(n, "start", "end"), ["chrom"], ["start", "end"], "start", "end")
    cores = keep(n.select("chrom", "start", "end", F.lit("nucleosome").alias("kind"), F.col("spacing").cast("double").alias("spacing"), "positioning", F.lit(1).alias("nuc"), "nlp_valley").where("start < end"), "cores")
    gaps = intervals.complement(cores, ["chrom"], "start", "end", chroms, "length").withColumnsRenamed({"gap_start": "start", "gap_end": "end"})
    left = cores.select("chrom", F.col("end").alias("start"), F.col("nlp_valley").alias("left_valley")).dropDuplicates(["chrom", "start"])
    right = cores.select("chrom", F.col("start").alias("end"), F.col("nlp_valley").alias("right_valley")).dropDuplicates(["chrom", "end"])
    gaps = keep(gaps.join(left, ["chrom", "start"], "left").join(right, ["chrom", "end"], "left").fillna(20.0, ["left_valley", "right_valley"]), "gaps")
    cut, mad = gap_measures(gaps)
    near = keep(interval_filter(gaps.withColumn("cut", F.lit(cut).cast("double")), "cut", mad=mad), "near")
    known = keep(intervals.annotate(near, intervals.gene_regions(genes), ["chrom"], ["chrom", "start", "end"], "start", "end", 50_000).drop("genes"), "known")
    known = genebody_filter(known, mad)
    typed = known.withColumn("kind", intervals.interval_type(F.col("left_valley"), F.col("right_valley"), F.col("cut"), F.col("region"), F.col("end") - F.col("start")))
    pieces = intervals.subdivide(typed, "start", "end").select("chrom", F.col("piece_start").alias("start"), F.col("piece_end").alias("end"), "kind", F.lit(0.0).alias("spacing"), F.lit(0.0).alias("positioning"), F.lit(0).alias("nuc"))
    return intervals.number_bins(cores.drop("nlp_valley").unionByName(pieces), "chrom", ["start", "end"])


def gap_measures(gaps: DataFrame) -> tuple[float | None, float]:
    """Two deviations (MAD) of the left valleys above 1/32 of all gaps but the first, None if there are none, and the MAD of the gaps' lengths."""
    size = F.col("end") - F.col("start")
    at = F.struct("chrom", "start")
    first, middle = gaps.agg(F.min(at), F.median(size)).first()
    if first is None:
        return None, 0.0
    valley = F.when(((F.col("chrom") != first.chrom) | (F.col("start") != first.start)) & (F.col("left_valley") > 0.03125), F.col("left_valley"))
    usual, mad = gaps.agg(F.median(valley), F.median(F.abs(size - middle))).first()
    return (None if usual is None else 2 * gaps.agg(F.median(F.abs(valley - usual))).first()[0]), mad


def interval_filter(gaps: DataFrame, cut: str, least: int = 70, mad: float | None = None) -> DataFrame:
    """Intervals longer than `least` of which not both a valley is at most cut and the length at most five deviations (or `least`). mad: the lengths' deviation, where it is known."""
    size = F.col("end") - F.col("start")
    if mad is None:
        m = gaps.agg(F.median(size).alias("_md"))
        gaps = gaps.join(F.broadcast(gaps.join(F.broadcast(m)).agg(F.median(F.abs(size - F.col("_md"))).alias("_mad"))))
    else:
        gaps = gaps.withColumn("_mad", F.lit(mad))
    shallow = (F.col("left_valley") <= F.col(cut)) | (F.col("right_valley") <= F.col(cut))
    return gaps.where((size > least) & ~(shallow & (size <= F.greatest(5 * F.col("_mad"), F.lit(float(least)))))).drop("_mad")


def genebody_filter(known: DataFrame, mad: float, least: int = 90) -> DataFrame:
    """Intervals but those in gene bodies that are shorter than three deviations (mad) of all gaps' lengths (or `least`)."""
    return known.where((F.col("region") != "Genebody") | (F.col("end") - F.col("start") >= max(3 * mad, least)))


def merge_maps(a: DataFrame, b: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The integrated map and its balancing weights: both maps' marginals are normalised against each other by the number of sites of a bin, each map is balanced to its new marginals, b is cut to pixels
    with a site, and a goes before b. sites: bin_id, sites."""
    a, b, sites = keep(a, "map"), keep(b, "map"), keep(sites, "sites")  # each is read several times
    marg = [matrix.marginals(m).withColumnRenamed("marginal", n) for m, n in ((a, "a"), (b, "b"))]
    both = marg[0].join(marg[1], ["chrom", "bin_id"], "full").fillna(0).join(sites, "bin_id", "left").fillna(0, ["sites"])
    norm = keep(kernels.normalise_marginals(both.select("chrom", "bin_id", "a", "b", "sites")), "norm")
    out = []
    for m, n in ((a, "norm_a"), (b, "norm_b")):
        target = norm.select("chrom", "bin_id", F.greatest(F.col(n), F.lit(1e-6)).alias("target"))
        out.append(matrix.bias_multiply(m, balance_map(m, target), "bias").select(*matrix.PIXEL, "cnt"))
    merged = keep(matrix.union_priority(out[0], matrix.drop_unsupported(out[1], sites, "sites")), "merged")
    return merged, balance_map(merged)


def segment(pixels: DataFrame, bins: DataFrame, window: int = 10, tolerance: int = 3, zeros: int = 10, regions_map: bool = False) -> DataFrame:
    """Domains, boundaries and gaps of each chromosome: chrom, tag, first, last, start, end, score, nuc. bins: chrom, bin_id, start, end, nuc.

    Extremes of the diamond means are sought in the runs of bins between the greedy gaps; minima with a small rank-test p on the scaled map (cells without a pixel included) are boundary bins, of which two
    in a row make a boundary. A domain's score is its class by its mean p. Runs of zeros on the diagonal then go before all that, domains with fewer than two nucleosomes become gaps, and small gaps boundaries.

    With regions_map, bins are segments of a map of regions and have a column kind (0 gap, 1 boundary, 2 domain): gaps are those given, the means of boundary bins are lowered by their lower quartile and what isn't above 0
    is set to their least one, p is held against 0.1, the bin behind a minimum is the boundary, one bin is enough for it, and nucleosomes aren't counted."""
    bins = keep(bins, "bins")  # what is read more than once is written once
    ext = keep(bins.groupBy("chrom").agg(F.min("bin_id").alias("_first"), F.count("*").alias("bins")), "chromosomes")  # one row a chromosome
    places = bins.join(ext.select("chrom", "_first"), "chrom").withColumn("bin_id", F.col("bin_id") - F.col("_first"))
    local = pixels.join(ext.select("chrom", "_first"), "chrom").select("chrom", (F.col("bin1_id") - F.col("_first")).alias("bin1_id"), (F.col("bin2_id") - F.col("_first")).alias("bin2_id"), "cnt")
    local = keep(local, "pixels")
    track = matrix.insulation(local, ext, window)
    if regions_map:
        p_most, gaps = 0.1, places.where("kind = 0").select("chrom", "bin_id")
        track = keep(places.select("chrom", "bin_id", "kind").join(track, ["chrom", "bin_id"], "left").fillna(0.0, ["score"]), "track")
        low = track.where("kind = 1").groupBy("chrom").agg(F.min("score").alias("_least"), F.percentile("score", F.lit(0.25)).alias("_quarter"))
        lowered = F.col("score") - F.when(F.col("kind") == 1, F.coalesce("_quarter", F.lit(0.0))).otherwise(0.0)
        track = track.join(low, "chrom", "left").select("chrom", "bin_id", F.when(lowered <= 0, F.coalesce("_least", lowered)).otherwise(lowered).alias("score"))
        override = gaps
    else:
        p_most = 0.05
        gaps = kernels.gap_bins(local.groupBy("chrom", F.col("bin1_id").alias("bin_id")).agg(F.min("bin2_id").alias("c")), ext.select("chrom", "bins"))
        on = local.where("bin1_id = bin2_id").select("chrom", F.col("bin1_id").alias("bin_id"), "cnt")
        diagonal = places.select("chrom", "bin_id").join(on, ["chrom", "bin_id"], "left").fillna(0, ["cnt"])
        gaps = keep(gaps, "gaps")
        override = islands.zero_runs(diagonal, ["chrom"], "bin_id", "cnt", tolerance, zeros).select("chrom", F.explode(F.sequence("first", "last")).alias("bin_id"))
    regions = segments.process_regions(places.select("chrom", "bin_id"), gaps)
    near = F.col("bin2_id") - F.col("bin1_id")
    z = matrix.diagonal_zscore(local, ext, window).where(near.between(1, 2 * window - 1)).unionByName(local.where(near == 0).select(*matrix.PIXEL, F.col("cnt").cast("double").alias("z")))
    called = keep(kernels.boundaries_in_regions(regions, track, z, matrix.empty_scores(local, ext, window), window, p_most), "called")
    marks = called.where("extreme = -1").select("chrom", (F.col("bin_id") + int(regions_map)).alias("bin_id"), F.lit(True).alias("_mark"))
    flagged = places.select("chrom", "bin_id").join(called, ["chrom", "bin_id"], "left").join(gaps.withColumn("_gap", F.lit(True)), ["chrom", "bin_id"], "left").join(marks, ["chrom", "bin_id"], "left")
    gap = F.col("_gap").isNotNull() if regions_map else F.col("extreme").isNull()  # short runs between gaps are gaps too
    flags = flagged.select("chrom", "bin_id", gap.alias("gap"), F.col("_mark").isNotNull().alias("boundary"), F.coalesce("p", F.lit(1.0)).alias("p"))
    kinds = keep(segments.runs_of_kinds(flags, 1 if regions_map else 2, p_most), "kinds")
    top = kinds.groupBy("chrom").agg(F.max("score").alias("_top"))
    scored = kinds.join(top, "chrom").withColumn("score", segments.score_class(F.col("score"), F.when(F.col("_top") == 0, 1.0).otherwise(F.col("_top"))))
    each = scored.select("chrom", F.explode(F.sequence("first", "last")).alias("bin_id"), "tag", F.col("score").cast("double").alias("score"))
    rows = places.select("chrom", "bin_id", "start", "end", "nuc").join(each, ["chrom", "bin_id"], "left").join(override.withColumn("_over", F.lit(True)), ["chrom", "bin_id"], "left")
    rows = rows.withColumn("score", F.when(F.col("_over"), 1.0).otherwise(F.col("score"))).drop("_over")
    out = segments.close_small_gaps(segments.override_gaps(rows, override, 0 if regions_map else 2))
    back = ext.select("chrom", "_first")
    return out.join(back, "chrom").withColumns({"first": F.col("first") + F.col("_first"), "last": F.col("last") + F.col("_first")}).drop("_first")


def transfer_boundaries(called: DataFrame, bins: DataFrame, source: DataFrame, factors: list[tuple[DataFrame, DataFrame]], bucket: int, around: int = 100) -> DataFrame:
    """Segments (chrom, first, last, start, end, tag, score) with boundaries of another cell type put in.

    source: chrom, start, end of that type's boundaries; factors: for each, by priority, the tracks (chrom, t_start, t_end, value) of both types. A boundary is a candidate where the largest value near it is at
    least the cut of the density of all of them, for both tracks; those that overlap a boundary which is there, or one that a factor before gives, are left out. bins: chrom, bin_id, start, end; a boundary is widened to its bins."""
    called = keep(called, "called")
    there = called.where("tag = 'boundary'").select("chrom", F.col("start").alias("_ts"), F.col("end").alias("_te"))
    ids = ["chrom", "start", "end"]
    rows = keep(source.select(*ids).distinct(), "source")
    levels = []
    for one, two in factors:
        held = segments.max_signal(rows, one, ids, around, bucket).withColumnRenamed("signal", "signal_1")
        both = keep(segments.max_signal(held, two, ids, around, bucket), "signals")
        cut = [kernels.signal_cut(both, c, least) for c, least in (("signal_1", 0.015), ("signal", 0.0015))]
        good = both.where((F.col("signal_1") >= cut[0]) & (F.col("signal") >= cut[1])).select(*ids, F.col("signal"))
        levels.append((keep(intervals.overlap_exists(good, there, ["chrom"], ids, "start", "end", "_ts", "_te", bucket, keep=False), "level"), cut[1]))
    chosen = keep(segments.transfer_candidates(levels, bucket).select(*ids), "chosen")
    widened = intervals.overlap_join(chosen, bins.select("chrom", "bin_id", F.col("start").alias("_bs"), F.col("end").alias("_be")), ["chrom"], "start", "end", "_bs", "_be", bucket)
    put = widened.groupBy(*ids).agg(F.min("bin_id").alias("b_first"), F.max("bin_id").alias("b_last"), F.min("_bs").alias("b_start"), F.max("_be").alias("b_end"))
    return segments.insert_boundaries(called, put.select("chrom", "b_start", "b_end", "b_first", "b_last").distinct(), bucket)


def transfer_loops(found: DataFrame, genes: DataFrame, bucket: int = 50_000) -> DataFrame:
    """Loops (chrom1, start1, end1, chrom2, start2, end2) with what lies at both ends, the class and its genes; those at promoters only."""
    ends = found.select(F.explode(F.array(*[F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end")) for i in (1, 2)])).alias("e"))
    places = ends.select("e.*").distinct()  # each place is annotated once
    annotated = keep(intervals.annotate(places, intervals.gene_regions(genes, intervals.LOOP_REGIONS), ["chrom"], ["chrom", "start", "end"], "start", "end", bucket), "annotated")
    out = found
    for i in (1, 2):
        own = annotated.select(*[F.col(c).alias(f"{c}{i}") for c in ("chrom", "start", "end")], F.col("region").alias(f"annot{i}"), F.col("genes").alias(f"detail{i}"))
        out = out.join(own, [f"chrom{i}", f"start{i}", f"end{i}"])
    kind, names = loops.loop_class(*[F.col(c) for c in ("annot1", "annot2", "detail1", "detail2")])
    return loops.promoter_loops(out.withColumns({"assigned_annotation": kind, "genes": names}))


def distance_fit(pixels: DataFrame, mass_bins: int) -> tuple[DataFrame, DataFrame]:
    """pixels (with k, the distance) and their mass_bin, and chrom, mass_bin, mean, fit: the mean of each equal-mass distance bin, and the smoothing spline through these whose squared residual is that of the smallest mean."""
    far = keep(stats.equal_mass(pixels.withColumn("k", F.col("bin2_id") - F.col("bin1_id")), ["chrom"], ["k", "bin1_id"], "cnt", mass_bins), "distances")
    means = far.groupBy("chrom", "mass_bin").agg(F.avg("cnt").alias("mean"))  # mass_bins rows a chromosome

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mass_bin")
        return part.assign(fit=smoothed(part["mean"].to_numpy(float), float(part["mean"].min()) ** 2))

    return far, means.groupBy("chrom").applyInPandas(run, "chrom string, mass_bin bigint, mean double, fit double")


def region_map(pixels: DataFrame, runs: DataFrame, mass_bins: int = 200) -> DataFrame:
    """The map of segments: pixels are divided by the fitted mean at their distance, summed over pairs of segments and divided by the segments' sizes. runs: chrom, first, last."""
    far, fit = distance_fit(pixels, mass_bins)
    flat = far.join(F.broadcast(fit), ["chrom", "mass_bin"]).withColumn("cnt", F.col("cnt") / F.col("fit")).select(*matrix.PIXEL, "cnt")
    runs = numbered(runs, ["chrom"], ["first"], "_no").withColumn("block", F.col("_no") - 1)
    blocks = keep(runs.select("chrom", "block", F.explode(F.sequence("first", "last")).alias("bin_id")), "blocks")
    sums = matrix.block_sum(flat, blocks)
    return matrix.block_mean(sums, blocks.groupBy("chrom", "block").agg(F.count("*").alias("size"))).where("block1 <= block2")


def greedy_mass_bins(pixels: DataFrame, bins: int, slack: float | None = None) -> DataFrame:
    """pixels (counts above 0) with mass_bin: walking by distance, then by row, a bin is closed by the pixel with which its own sum reaches total / bins, and the next begins at zero.

    The walk is over running sums, which are scans of ranges: a bin that begins behind the sum b closes at the first sum of at least b + target. Closing sums are looked for among the sums that lie just above b + target, b + 2 target, ... , up to
    `slack` (the largest pixel) each, a few rows a chromosome; where a close lies beyond these, the next round goes on from the last one that is known, with twice the slack if there was none. What a chromosome's task holds are these few."""
    placed = pixels.withColumn("k", F.col("bin2_id") - F.col("bin1_id"))
    summed = carried(placed, ["chrom"], ["k", "bin1_id"], sums={"_upto": F.col("cnt").cast("double")}, ranges=[F.col("k"), F.floor(F.col("bin1_id") / RANGE)])
    summed = keep(summed, "sums")
    spark = pixels.sparkSession
    state = {r.chrom: {"target": r.total / bins, "at": 0.0, "slack": slack or r.most, "closes": []} for r in summed.groupBy("chrom").agg(F.max("_upto").alias("total"), F.max(F.col("cnt").cast("double")).alias("most")).collect()}  # a row a chromosome
    open_ = {c for c, s in state.items() if s["target"] > 0}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        begin, target, wide = (float(part[c].iloc[0]) for c in ("at", "target", "slack"))
        sums, at, found, over = np.unique(part._upto.to_numpy(float)), begin, [], False
        while True:
            goal = at + target
            i = int(np.searchsorted(sums, goal))
            step = np.floor((goal - begin) / target + 1e-9)
            edge = begin + step * target + wide
            if goal > edge or i == len(sums) or sums[i] > edge:
                break
            at = float(sums[i])
            found.append(at)
        return pd.DataFrame({"chrom": [part.chrom.iloc[0]], "closes": [found]})

    while open_:
        rows = spark.createDataFrame([(c, state[c]["at"], state[c]["target"], state[c]["slack"]) for c in open_], "chrom string, at double, target double, slack double")
        ahead = F.col("_upto") - F.col("at")
        near = summed.select("chrom", "_upto").join(F.broadcast(rows), "chrom").where((ahead > 0) & (ahead - F.floor(ahead / F.col("target") + 1e-9) * F.col("target") <= F.col("slack") + 1e-9 * F.col("target")))
        got = {r.chrom: r.closes for r in near.groupBy("chrom").applyInPandas(run, "chrom string, closes array<double>").collect()}  # `bins` numbers a chromosome at most
        for c in list(open_):
            s, closes = state[c], got.get(c, [])
            s["closes"] += closes
            s["at"] = s["closes"][-1] if s["closes"] else 0.0
            if not closes:
                if s["slack"] > 2 * s["target"]:  # every sum ahead was looked at
                    open_.remove(c)
                s["slack"] *= 2
    closed = spark.createDataFrame([(c, s["closes"]) for c, s in state.items()], "chrom string, _closes array<double>")
    before = F.size(F.filter("_closes", lambda x: x < F.col("_upto")))
    return summed.join(F.broadcast(closed), "chrom").withColumn("mass_bin", before.cast("int")).drop("k", "_upto", "_closes")


def quantile_loops(pixels: DataFrame, bins: DataFrame, low: float = 100_000, high: float = 2_000_000, q: float = 0.999, window: int = 5, least_blocks: int = 10) -> DataFrame:
    """Peaks of groups of near pixels among the strongest whose bins' middles are from low to high bases apart; chromosomes of least_blocks bins or fewer are left out. bins: chrom, bin_id, start, end.

    The quantile is that of the whole symmetric matrix, so each pixel counts twice."""
    wide = bins.groupBy("chrom").agg(F.count("*").alias("_n")).where(F.col("_n") > least_blocks).select("chrom")
    middle = (F.col("start") + F.col("end")) / 2
    one, two = (bins.select("chrom", F.col("bin_id").alias(f"bin{i}_id"), middle.alias(f"_m{i}")) for i in (1, 2))
    placed = pixels.join(F.broadcast(wide), "chrom").join(one, ["chrom", "bin1_id"]).join(two, ["chrom", "bin2_id"]).where("bin1_id < bin2_id")
    near = keep(placed.where(F.abs(F.col("_m2") - F.col("_m1")).between(low, high)).select(*matrix.PIXEL, "cnt"), "near")
    cut = near.groupBy("chrom").agg(F.percentile("cnt", F.lit(q), F.lit(2)).alias("_cut"))
    strong = near.join(F.broadcast(cut), "chrom").where("cnt >= _cut").drop("_cut")
    return islands.peaks(islands.pixel_groups(strong, ["chrom"], "bin1_id", "bin2_id", window), ["chrom"], "bin1_id", "bin2_id", "cnt")


#: Settings of maps with few contacts.
LOW_DEPTH = {"q_most": 0.2, "sigma": 0.3, "reach": 1}


def call_loops(pixels: DataFrame, bins: DataFrame, low: float = 5000, high: float = 2_000_000, middle_low: float = 100_000, middle_high: float = 2_000_000, q: float | None = None, low_depth: bool = False, densities: tuple[float, ...] = (0.25, 0.75), **settings) -> DataFrame:
    """chrom, sidx, eidx, fdr, scale, intensity: blobs with each of the densities of filled cells around them, whose bins' middles are from low to high bases apart, and the strongest pixels from middle_low to middle_high, with values on
    lines fitted to the blobs; one row for each pair of ends, a blob before a strong pixel. bins: chrom, bin_id, start, end.

    low_depth takes LOW_DEPTH and a lower quantile."""
    settings = (LOW_DEPTH if low_depth else {}) | settings
    pixels, bins = keep(pixels, "map"), keep(bins.select("chrom", "bin_id", "start", "end"), "bins")
    tiles = keep(matrix.tiles_of(pixels, bins, high), "tiles")
    found = None
    for order, dense in enumerate(densities):
        own = kernels.blobs_in_tiles(tiles, dense=dense, **settings).withColumn("order", F.lit(order))
        found = own if found is None else found.unionByName(own)
    middle = (F.col("start") + F.col("end")) / 2
    one, two = (bins.select("chrom", F.col("bin_id").alias(f"bin{i}_id"), middle.alias(f"_m{i}")) for i in (1, 2))
    placed = keep(found, "blobs").join(one, ["chrom", "bin1_id"]).join(two, ["chrom", "bin2_id"]).where(F.abs(F.col("_m2") - F.col("_m1")).between(low, high))
    ends = [F.col("bin1_id").alias("sidx"), F.col("bin2_id").alias("eidx"), F.col("cnt").cast("double").alias("intensity")]
    blobs = matrix.point_lookup(placed, pixels).select("chrom", *ends, "fdr", "scale", "order")
    peaks = quantile_loops(pixels, bins, middle_low, middle_high, q or (0.995 if low_depth else 0.999)).select("chrom", *ends)
    more = loops.regress_fdr(peaks, blobs.select("chrom", "intensity", "fdr", "scale").distinct()).withColumn("order", F.lit(len(densities)))
    return loops.unique_loops(blobs.unionByName(more), best="order").drop("order")
