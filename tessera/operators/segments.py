"""Domains, boundaries and gaps along each chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import overlap_exists, overlap_join, overlap_max
from tessera.operators.islands import regions_of_ids, with_runs
from tessera.operators.scans import carried, numbered
from tessera.tables import keep


def tag_runs(rows: DataFrame, index: str = "bin_id", score: str = "score") -> DataFrame:
    """chrom, tag, first, last, start, end, score (mean) and nuc of runs of equal tags; rows: chrom, index, start, end, tag, score, nuc."""
    runs = with_runs(rows, ["chrom"], [index], "tag")
    return runs.groupBy("chrom", "run", "tag").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg(score).alias("score"), F.sum("nuc").alias("nuc")).drop("run")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs whose tag is that of the one before are joined."""
    again = with_runs(runs, ["chrom"], ["first"], "tag")
    return again.groupBy("chrom", "run", "tag").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.sum("nuc").alias("nuc")).drop("run")


def override_gaps(bins: DataFrame, gaps: DataFrame, least_nuc: int = 2) -> DataFrame:
    """Runs of tags, a bin's gap (gaps: chrom, bin_id) before its own tag, and gap where there is none; domains with fewer than least_nuc nucleosomes become gaps with score 1, and runs are joined again."""
    marked = bins.join(gaps.select("chrom", "bin_id", F.lit("gap").alias("_gap")), ["chrom", "bin_id"], "left")
    tagged = marked.withColumn("tag", F.coalesce("_gap", "tag", F.lit("gap"))).withColumn("score", F.coalesce("score", F.lit(1.0))).drop("_gap")
    poor = (F.col("tag") == "domain") & (F.col("nuc") < least_nuc)
    return merge_runs(tag_runs(tagged).withColumn("score", F.when(poor, 1.0).otherwise(F.col("score"))).withColumn("tag", F.when(poor, "gap").otherwise(F.col("tag"))))


def close_small_gaps(runs: DataFrame, most: int = 1000) -> DataFrame:
    """Gaps of at most `most` bases become boundaries, runs are joined, and the score of a domain is -1 at most."""
    small = (F.col("tag") == "gap") & (F.col("end") - F.col("start") <= most)
    out = merge_runs(runs.withColumn("tag", F.when(small, "boundary").otherwise(F.col("tag"))))
    return out.withColumn("score", F.when(F.col("tag") == "domain", F.least("score", F.lit(-1.0))).otherwise(F.col("score")))


def runs_of_kinds(bins: DataFrame, least_boundary: int = 2, p_most: float = 0.05) -> DataFrame:
    """Segments from bins (chrom, bin_id, gap and boundary flags, p): runs of gaps, of boundaries (least_boundary bins at least), and of neither as domains, which become boundaries where all p are below p_most. score
    is the mean p of a domain, 0 for others."""
    kinds = F.when(F.col("gap"), "gap").when(F.col("boundary"), "boundary").otherwise("domain")
    tagged = bins.withColumn("tag", kinds)
    runs = with_runs(tagged, ["chrom"], ["bin_id"], "tag").groupBy("chrom", "run", "tag").agg(F.min("bin_id").alias("first"), F.max("bin_id").alias("last"), F.bool_and(F.col("p") < p_most).alias("_low"), F.avg("p").alias("_p"))
    kept = runs.where((F.col("tag") != "boundary") | (F.col("last") - F.col("first") + 1 >= least_boundary))
    named = kept.withColumn("tag", F.when((F.col("tag") == "domain") & F.col("_low"), "boundary").otherwise(F.col("tag")))
    return named.withColumn("score", F.when(F.col("tag") == "domain", F.col("_p")).otherwise(0.0)).drop("run", "_low", "_p")


def process_regions(bins: DataFrame, gaps: DataFrame, least: int = 3) -> DataFrame:
    """Runs of bins that are in no gap."""
    return regions_of_ids(bins.join(gaps, ["chrom", "bin_id"], "left_anti").select("chrom", "bin_id"), ["chrom"], "bin_id", least)


def score_class(score: Column, top: Column) -> Column:
    """1 - int(score / top * 10)."""
    return 1 - (score / top * 10).cast("int")


def transfer_candidates(signals: list[tuple[DataFrame, float]], bucket: int) -> DataFrame:
    """Candidates (chrom, start, end, signal) of several factors by priority: those of at least the factor's cutoff that overlap no candidate of a factor before. They carry the factor's number."""
    out = None
    for i, (rows, cut) in enumerate(signals):
        held = rows.where(F.col("signal") >= cut).withColumn("factor", F.lit(i))
        if out is not None:
            held = overlap_exists(held, out.select("chrom", F.col("start").alias("_s"), F.col("end").alias("_e")), ["chrom"], ["chrom", "start", "end"], "start", "end", "_s", "_e", bucket, keep=False)
        out = held if out is None else out.unionByName(held.select(*out.columns))
    return out


def max_signal(sites: DataFrame, track: DataFrame, ids: list[str], around: int, bucket: int) -> DataFrame:
    """sites with the largest value of the track (chrom, t_start, t_end, value) within `around` of them; null where there is none."""
    wide = sites.select(*ids, "chrom", (F.col("start") - around).alias("_s"), (F.col("end") + around).alias("_e"))
    most = overlap_max(wide, track, ["chrom"], "_s", "_e", "t_start", "t_end", "value", bucket)
    best = wide.join(most, ["chrom", "_s", "_e"]).groupBy(*ids).agg(F.max("value").cast(track.schema["value"].dataType).alias("signal"))
    return sites.join(best, ids, "left")


def split_domains(domains: DataFrame, boundaries: DataFrame, bucket: int) -> DataFrame:
    """Domains (chrom, dom_id, start, end) cut at the boundaries (chrom, b_start, b_end) inside them: pieces of domains and, between them, boundaries."""
    hits = overlap_join(domains, boundaries, ["chrom"], "start", "end", "b_start", "b_end", bucket)
    inside = hits.groupBy("chrom", "dom_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.greatest("start", "b_start").alias("s"), F.least("end", "b_end").alias("e")))).alias("cuts"))
    rows = domains.join(inside.select("chrom", "dom_id", "cuts"), ["chrom", "dom_id"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    n = F.size("cuts")
    last = lambda i: F.array_max(F.transform(F.slice("cuts", F.lit(1), i), lambda c: c["e"]))
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.lit("domain").alias("tag"), F.when(i == 0, F.col("start")).otherwise(last(i)).cast("bigint").alias("s"), F.when(i == n, F.col("end")).otherwise(F.get("cuts", i)["s"]).cast("bigint").alias("e")))
    marks = F.transform("cuts", lambda c: F.struct(F.lit("boundary").alias("tag"), c["s"].cast("bigint").alias("s"), c["e"].cast("bigint").alias("e")))
    out = rows.select("chrom", "dom_id", F.explode(F.concat(pieces, marks)).alias("p")).select("chrom", "dom_id", "p.tag", F.col("p.s").alias("start"), F.col("p.e").alias("end"))
    return out.where("start < end")


def make_consecutive(rows: DataFrame, shift: int = 0) -> DataFrame:
    """Segments (chrom, start, end, tag, in the order of start and end) whose edges are made to meet.

    Gaps and boundaries take the edges of the domains beside them. Where two others don't meet, a boundary keeps its start, which the one before takes as its end, and a gap begins where the one before ended. What still doesn't begin at
    the end before it does then, and a start behind its own end becomes that; both are repeated until nothing changes. Chromosomes of three segments or fewer stay as they are. At last boundaries, and what meets them, are moved back by
    `shift`. Equal segments are one after the other in an order that stays open."""
    order = ["no"]
    counts = rows.groupBy("chrom").agg(F.count("*").alias("_n"))  # a row a chromosome
    now = numbered(rows, ["chrom"], ["start", "end"], "no").join(F.broadcast(counts), "chrom")
    few = now.where("_n <= 3")
    domain = lambda c: F.col(c) == "domain"
    step = carried(now.where("_n > 3"), ["chrom"], order, before={"_bt": F.col("tag"), "_be": F.col("end")}, after={"_at": F.col("tag"), "_as": F.col("start")})
    start = F.when(~domain("tag") & domain("_bt"), F.col("_be")).otherwise(F.col("start"))
    end = F.when(~domain("tag") & domain("_at"), F.col("_as")).otherwise(F.col("end"))
    step = step.withColumns({"_s": start, "_e": end}).drop("start", "end", "_bt", "_be", "_at", "_as").withColumnsRenamed({"_s": "start", "_e": "end"})
    step = carried(step, ["chrom"], order, before={"_be": F.col("end")}, after={"_at": F.col("tag"), "_as": F.col("start")})
    start = F.when((F.col("tag") == "gap") & (F.col("_be") != F.col("start")), F.col("_be")).otherwise(F.col("start"))
    end = F.when((F.col("_at") == "boundary") & (F.col("_as") != F.col("end")), F.col("_as")).otherwise(F.col("end"))
    step = step.withColumns({"_s": start, "_e": end}).drop("start", "end", "_be", "_at", "_as").withColumnsRenamed({"_s": "start", "_e": "end"})
    while True:
        step = keep(carried(step, ["chrom"], order, before={"_be": F.col("end")}), "segments")
        forced = F.coalesce("_be", "start")
        met = F.when(forced > F.col("end"), F.col("end")).otherwise(forced)
        changed = step.where(met != F.col("start")).limit(1).count()
        step = step.withColumn("_s", met).drop("start", "_be").withColumnRenamed("_s", "start")
        if not changed:
            break
    out = step.select("no", *rows.columns, "_n").unionByName(few.select("no", *rows.columns, "_n"))
    if shift:
        out = carried(out, ["chrom"], order, before={"_bt": F.col("tag")}, after={"_at": F.col("tag")})
        mark = lambda c: F.coalesce(F.col(c) == "boundary", F.lit(False))
        out = out.withColumns({"start": F.col("start") - F.when(mark("tag") | mark("_bt"), shift).otherwise(0), "end": F.col("end") - F.when(mark("tag") | mark("_at"), shift).otherwise(0)})
    return out.select(*rows.columns)


_PIECE = "array<struct<tag:string,start:bigint,end:bigint,first:bigint,last:bigint,score:double>>"


def insert_boundaries(segments: DataFrame, boundaries: DataFrame, bucket: int) -> DataFrame:
    """segments (chrom, first, last, start, end, tag, score) with boundaries (chrom, b_start, b_end, b_first, b_last) put into their domains, and the neighbours' edges made to meet.

    A domain that lies inside a boundary stays as it is, and so do other segments. One boundary across an edge cuts the domain there; one inside makes domain, boundary, domain, where a part
    without bins of its own goes to the boundary; several are put in one after the other, cut to the domain. A segment that no longer begins where the one before ends: a domain moves that end, others their own start."""
    placed = keep(numbered(segments, ["chrom"], ["start", "first"], "no"), "segments")
    hits = overlap_join(placed.where("tag = 'domain'"), boundaries, ["chrom"], "start", "end", "b_start", "b_end", bucket).where("not (start >= b_start and end <= b_end)")
    cuts = hits.groupBy("chrom", "no").agg(F.array_sort(F.collect_set(F.struct(F.col("b_start").alias("s"), F.col("b_end").alias("e"), F.col("b_first").alias("f"), F.col("b_last").alias("l")))).alias("cuts"))
    rows = placed.join(cuts, ["chrom", "no"], "left")
    s, e, first, last, score = (F.col(c) for c in ("start", "end", "first", "last", "score"))

    def piece(tag: str, a: Column, b: Column, f: Column, t: Column, value: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), f.cast("bigint").alias("first"), t.cast("bigint").alias("last"), value.cast("double").alias("score"))

    one = F.get("cuts", F.lit(0))
    left_empty, right_empty = first == one["f"], last == one["l"]
    inner = piece("boundary", F.when(left_empty, s).otherwise(one["s"]), F.when(right_empty, e).otherwise(one["e"]), F.when(left_empty, first).otherwise(one["f"]), F.when(right_empty, last).otherwise(one["l"]), F.lit(1.0))
    before, after = piece("domain", s, one["s"], first, one["f"], score), piece("domain", one["e"], e, one["l"], last, score)
    none = F.array().cast(_PIECE)
    inside = F.concat(F.when(left_empty, none).otherwise(F.array(before)), F.array(inner), F.when(right_empty, none).otherwise(F.array(after)))
    single = F.when(one["s"] < s, F.array(after)).when(one["e"] > e, F.array(before)).otherwise(inside)

    def put(a: Column, c: Column) -> Column:
        begin, stop = F.greatest(a["at"], c["s"]), F.least(e, c["e"])
        more = F.concat(F.when(a["at"] < begin, F.array(piece("domain", a["at"], begin, a["f"], c["f"], score))).otherwise(none), F.array(piece("boundary", begin, stop, c["f"], c["l"], F.lit(1.0))))
        return F.struct(stop.cast("bigint").alias("at"), c["l"].cast("bigint").alias("f"), F.concat(a["out"], more).alias("out"))

    start = F.struct(s.cast("bigint").alias("at"), first.cast("bigint").alias("f"), none.alias("out"))
    many = F.aggregate("cuts", start, put, lambda a: F.concat(a["out"], F.when(a["at"] < e, F.array(piece("domain", a["at"], e, a["f"], last, score))).otherwise(none)))
    whole = F.array(F.struct(F.col("tag"), s.cast("bigint"), e.cast("bigint"), first.cast("bigint"), last.cast("bigint"), score.cast("double"))).cast(_PIECE)
    pieces = F.when(F.col("cuts").isNull(), whole).when(F.size("cuts") == 1, single).otherwise(many)
    out = rows.select("chrom", "no", F.posexplode(pieces).alias("piece", "p")).select("chrom", "no", "piece", "p.*")
    near = carried(out, ["chrom"], ["no", "piece"], before={"_behind": F.col("end")}, after={"_ahead": F.col("start"), "_tag": F.col("tag")})
    behind, ahead, tag = (F.col(c) for c in ("_behind", "_ahead", "_tag"))
    met = near.withColumns({"_s": F.when((F.col("tag") != "domain") & (behind != F.col("start")), behind).otherwise(F.col("start")), "_e": F.when((tag == "domain") & (ahead != F.col("end")), ahead).otherwise(F.col("end"))})
    return met.where("_s <> _e").select("chrom", "first", "last", F.col("_s").alias("start"), F.col("_e").alias("end"), "tag", "score")
