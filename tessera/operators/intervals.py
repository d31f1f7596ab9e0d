"""Operators on half-open intervals."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.kernels import largest_over
from tessera.operators.scans import carried, numbered
from tessera.tables import keep


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], sa: str, ea: str, sb: str, eb: str, bucket: int, hint: str | None = None, reach: int | None = None) -> DataFrame:
    """All pairs of rows with equal keys whose intervals [sa, ea) and [sb, eb) overlap, with olp, the overlap's length.

    Both sides are dealt to the buckets of width `bucket` that they touch and meet there by an equi-join; a pair that shares several buckets is
    taken in the one where the overlap begins. So neither side is compared with a whole chromosome, and a chromosome is not a task.
    With reach, which no row of a is longer than, a row of a is in the bucket where it begins only, so that all its pairs are made in one task; they have that bucket as _k."""
    left, right = dealt(a, sa, ea, bucket, reach is not None), dealt(b, sb, eb, bucket, reach=reach or 0)
    if hint:
        right = right.hint(hint)
    begin = F.greatest(sa, sb)
    met = left.join(right, [*keys, "_k"]).where((F.col(sa) < F.col(eb)) & (F.col(ea) > F.col(sb)))
    if reach is None:
        met = met.where(F.col("_k") == F.floor(begin / bucket)).drop("_k")
    return met.withColumn("olp", F.least(ea, eb) - begin)


def dealt(x: DataFrame, s: str, e: str, bucket: int, whole: bool = False, reach: int = 0) -> DataFrame:
    """The rows of x that aren't empty in each bucket _k that they touch, or whole in the one where they begin; with reach also in those from which a row so long may touch them."""
    place = lambda at: F.floor(at / bucket)
    x = x.where(F.col(s) < F.col(e))
    return x.withColumn("_k", place(F.col(s)) if whole else F.explode(F.sequence(place(F.col(s) - reach), place(F.col(e) - 1))))


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str], id_columns: list[str], sa: str, ea: str, sb: str, eb: str, bucket: int, name: str = "n") -> DataFrame:
    """a with the number of rows of b that each row overlaps, 0 where none does."""
    counts = overlap_join(a.select(*{*keys, *id_columns, sa, ea}), b.select(*keys, sb, eb), keys, sa, ea, sb, eb, bucket).groupBy(*id_columns).agg(F.count("*").alias(name))
    return a.join(counts, id_columns, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def overlap_max(a: DataFrame, b: DataFrame, keys: list[str], sa: str, ea: str, sb: str, eb: str, value: str, bucket: int) -> DataFrame:
    """keys, sa, ea of the distinct intervals of a that overlap rows of b, with the largest `value` of those, a double that isn't null.

    Pairs aren't made: in a bucket, whose distinct intervals a task holds, starts are sorted and largest values of ranges of them are looked up (kernels.largest_over)."""
    place = lambda x: F.floor(x / bucket)
    deal = lambda x, s, e: x.where(F.col(s) < F.col(e)).withColumn("_k", F.explode(F.sequence(place(F.col(s)), place(F.col(e) - 1))))
    left = deal(a.select(*keys, F.col(sa).alias("_sa"), F.col(ea).alias("_ea")), "_sa", "_ea").distinct()
    right = b.select(*keys, F.col(sb).alias("_sb"), F.col(eb).alias("_eb"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    right = deal(right, "_sb", "_eb").groupBy(*keys, "_k", "_sb", "_eb").agg(F.max("_v").alias("_v"))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        v, hit = largest_over(*[one[c].to_numpy() for c in ("_sa", "_ea")], *[two[c].to_numpy() for c in ("_sb", "_eb", "_v")])
        return one[hit].assign(_v=v[hit])

    found = left.groupBy(*keys, "_k").cogroup(right.groupBy(*keys, "_k")).applyInPandas(run, T.StructType([*left.schema.fields, T.StructField("_v", T.DoubleType())]))
    return found.groupBy(*keys, F.col("_sa").alias(sa), F.col("_ea").alias(ea)).agg(F.max("_v").alias(value))


def overlap_exists(a: DataFrame, b: DataFrame, keys: list[str], id_columns: list[str], sa: str, ea: str, sb: str, eb: str, bucket: int, keep: bool = True) -> DataFrame:
    """Rows of a that overlap some row of b (keep), or none."""
    hit = overlap_max(a, b.withColumn("_any", F.lit(1.0)), keys, sa, ea, sb, eb, "_any", bucket)
    hits = a.select(*{*keys, *id_columns, sa, ea}).join(hit, [*keys, sa, ea]).select(*id_columns).distinct()
    return a.join(hits, id_columns, "left_semi" if keep else "left_anti")


def best_match(hits: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group in a total order; an aggregate, so rows are compared before the shuffle."""
    return hits.groupBy(*group).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_best")).select(*group, *[F.col("_best")[c].alias(c) for c in columns])


def self_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Hits of both ends of a pair within one chromosome, as bins in upper-triangle order with the summed overlap."""
    r1 = one.select("pair_id", "chrom", F.col("bin_id").alias("b1"), F.col("olp").alias("o1"))
    r2 = two.select("pair_id", "chrom", F.col("bin_id").alias("b2"), F.col("olp").alias("o2"))
    return r1.join(r2, ["pair_id", "chrom"]).withColumn("olp_sum", F.col("o1") + F.col("o2"))


def orient(rows: DataFrame, strand: str, first: str, last: str) -> DataFrame:
    """A reverse row whose ends are reversed is turned; what is still reversed goes. Judged row by row."""
    turn = (F.col(strand) == "-") & (F.col(last) < F.col(first))
    f, l = F.when(turn, F.col(last)).otherwise(F.col(first)), F.when(turn, F.col(first)).otherwise(F.col(last))  # noqa: E741
    return rows.withColumns({first: f, last: l}).where(F.col(first) <= F.col(last))


def spacing(rows: DataFrame, part: list[str], order: list[str], middle: str, cap: int = 10_000) -> DataFrame:
    """Distance to the middle before. One that isn't positive takes the next one's; the first takes the second's; none is above cap."""
    step = carried(rows, part, order, before={"_m0": F.col(middle)}).withColumn("_d", F.col(middle) - F.col("_m0")).drop("_m0")
    value = F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.col("_d1"))
    return carried(step, part, order, after={"_d1": F.col("_d")}).withColumn("spacing", F.least(value, F.lit(cap))).drop("_d", "_d1")


def extend_short(rows: DataFrame, start: str, end: str, width: int = 150, by: int = 35) -> DataFrame:
    short = F.col(end) - F.col(start) < width
    return rows.withColumns({start: F.when(short, F.col(start) - by).otherwise(F.col(start)), end: F.when(short, F.col(end) + by).otherwise(F.col(end))})


def deoverlap(rows: DataFrame, part: list[str], order: list[str], start: str, end: str, least: int = 10) -> DataFrame:
    """Neighbours closer than `least` are drawn to 5 on either side of the middle between them (whole numbers, towards zero); decided on the original ends."""
    rows = carried(rows, part, order, before={"_before": F.col(end)}, after={"_after": F.col(start)})
    before, after = F.col("_before"), F.col("_after")
    middle = lambda x, y: ((x + y) / 2).cast("bigint")
    new_start = F.when(F.col(start) - before < least, middle(before, F.col(start)) + 5).otherwise(F.col(start))
    new_end = F.when(after - F.col(end) < least, middle(F.col(end), after) - 5).otherwise(F.col(end))
    return rows.withColumns({"_s": new_start, "_e": new_end}).drop(start, end, "_before", "_after").withColumnsRenamed({"_s": start, "_e": end})


def complement(rows: DataFrame, part: list[str], start: str, end: str, length: DataFrame, size: str) -> DataFrame:
    """Gaps between intervals and at both ends of each part, whose sizes are in length(part, size)."""
    far = carried(rows.select(*part, start, end), part, [start, end], most={"_far": F.col(end)})
    inner = far.select(*part, F.coalesce("_far", F.lit(0)).alias("gap_start"), F.col(start).alias("gap_end"))
    last = length.join(rows.groupBy(*part).agg(F.max(end).alias("_far")), part, "left").select(*part, F.coalesce("_far", F.lit(0)).alias("gap_start"), F.col(size).cast("bigint").alias("gap_end"))
    return inner.unionByName(last).where("gap_start < gap_end")


def subdivide(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Pieces: one below 300, two halves below 600, pieces of 300 below 30,000 (the last two of equal length), else 100 equal ones. piece counts from 0."""
    s, n = F.col(start), F.col(end) - F.col(start)
    many = F.when(n < 300, 1).when(n < 600, 2).when(n < 30_000, F.ceil(n / 300)).otherwise(100).cast("bigint")

    def edge(k: Column) -> Column:
        """Where piece k begins."""
        by_300 = F.when(k == many, n).when(k == many - 1, (300 * (many - 2) + (n - 300 * (many - 2)) / 2).cast("bigint")).otherwise(300 * k)
        return F.when(k == 0, 0).when(n < 600, F.when(k == many, n).otherwise((n / 2).cast("bigint"))).when(n < 30_000, by_300).otherwise((n * k / 100).cast("bigint"))

    k = F.col("piece")
    return rows.where(n > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1))).withColumns({"piece_start": s + edge(k), "piece_end": s + edge(k + 1)})


def number_bins(rows: DataFrame, part: str, order: list[str], name: str = "bin_id") -> DataFrame:
    """Dense numbers over all parts: a row number in each part plus the rows of the parts before, so that no window holds a part."""
    counts = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a chromosome
    return numbered(rows, [part], order, "_r").join(F.broadcast(before), part).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_r", "_before")


#: Parameters [p0, p1, p2, p3] of the region kinds, and their bits: the highest wins.
REGIONS = {"Promoter": (-1000, -1000, 1000, 1000), "TTS": (-1000, -1000, 1000, 1000), "Genebody": (1000, -1000, 0, 0), "Proximal": (-10000, 1000, -1000, 10000), "Distal": (-250000, 10000, -10000, 250000)}
LOOP_REGIONS = {"Promoter": (-5000, -1000, 1000, 5000), "Genebody": (1000, 0, 0, 0), "Distal": (-250000, 5000, -5000, 250000)}
PRIORITY = {"Promoter": 32, "TTS": 16, "Genebody": 8, "Proximal": 4, "Distal": 2}


def gene_regions(genes: DataFrame, regions: dict[str, tuple] = REGIONS, bidirect: bool = True) -> DataFrame:
    """chrom, region, gene, start, end around the genes (chrom, start, end, strand, gene), by strand; below 0 becomes 1, and a region that ends before it begins matches nothing."""
    forward = F.col("strand") == "+"
    s, e = F.col("start"), F.col("end")

    def one(kind: str, plus: tuple[Column, Column], minus: tuple[Column, Column], suffix: str = "") -> Column:
        a, b = (F.when(forward, x).otherwise(y) for x, y in zip(plus, minus, strict=True))
        positive = lambda x: F.when(x < 0, 1).otherwise(x)
        return F.struct(F.lit(kind).alias("region"), F.concat(F.col("gene"), F.lit(suffix)).alias("gene"), positive(a).alias("start"), positive(b).alias("end"))

    all_regions = []
    for kind, p in regions.items():
        if kind == "Genebody":
            all_regions.append(one(kind, (s + p[0], e + p[1]), (s + p[0], e + p[1])))
        elif kind == "TTS":
            all_regions.append(one(kind, (e + p[0], e + p[2]), (s + p[1], s + p[3])))
        else:
            all_regions.append(one(kind, (s + p[0], s + p[2]), (e + p[1], e + p[3])))
            if bidirect and kind in ("Proximal", "Distal"):
                all_regions.append(one(kind, (s - p[2], s - p[0]), (e - p[3], e - p[1]), "_bi"))
    out = genes.withColumn("_r", F.explode(F.array(*all_regions)))
    return out.select("chrom", "_r.region", "_r.gene", "_r.start", "_r.end").where("start < end")


def region_of(bits: Column) -> Column:
    """The region of the highest bit that is set; Desert if none is."""
    out = F.lit("Desert")
    for kind, bit in sorted(PRIORITY.items(), key=lambda x: x[1]):
        out = F.when(bits.bitwiseAND(F.lit(bit)) != 0, kind).otherwise(out)
    return out


def annotate(rows: DataFrame, regions: DataFrame, keys: list[str], id_columns: list[str], start: str, end: str, bucket: int) -> DataFrame:
    """rows with region (by priority over all that overlap) and genes of that region, sorted and joined by commas.

    Kinds are met from the highest on, each with the rows that no higher one overlaps, so only pairs that are reported are made: where promoters lie close, the wide regions behind them meet few rows. Of the pairs only the rows that have any
    leave a task. Lists of genes, which grow faster than the input where genes lie closer, are made last, where a row meets the regions of its bucket as an array, and are neither shuffled nor written.
    Buckets are four times as wide as a kind's regions, or the rows, are on average, and `bucket`, or once the regions' width, at most. Rows longer than a bucket lie in several, and only their pairs are shuffled; id_columns tell these rows apart."""
    regions = keep(regions.where(F.col("region").isin(*PRIORITY)).withColumnsRenamed({"start": "_rs", "end": "_re"}), "regions")
    left = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    columns = [*rows.columns, "genes", "region"]
    length = F.col(end) - F.col(start)
    own = left.where(F.col(start) < F.col(end)).agg(F.avg(length).alias("n"), F.max(length).alias("most")).first()
    sizes = {r.region: r.n for r in regions.where("_rs < _re").groupBy("region").agg(F.avg(F.col("_re") - F.col("_rs")).alias("n")).collect()}  # a row a kind
    over = lambda x: (x["_rs"] < F.col(end)) & (x["_re"] > F.col(start))
    listed = lambda genes: F.array_join(F.array_sort(genes), ",").alias("genes")
    out = []
    for kind in sorted(sizes, key=PRIORITY.get, reverse=True):
        there = regions.where(F.col("region") == kind).drop("region")
        width = max(int(max(min(bucket, 4 * max(sizes[kind], own.n or 0)), sizes[kind])), 1)
        reach = min(int(own.most or 0), width)
        is_long = F.coalesce(length > width, F.lit(False))
        short, long = left.where(~is_long), left.where(is_long)
        near = dealt(there, "_rs", "_re", width, reach=reach).groupBy(*keys, "_k").agg(F.collect_list(F.struct("_rs", "_re", "gene")).alias("_near"))
        found = dealt(short, start, end, width, whole=True).join(near, [*keys, "_k"]).where(F.exists("_near", over))
        out.append(found.withColumns({"genes": listed(F.array_distinct(F.transform(F.filter("_near", over), lambda x: x["gene"]))), "region": F.lit(kind)}).select(*columns))
        hit = overlap_join(short.select(*keys, "_row", start, end), there.drop("gene"), keys, start, end, "_rs", "_re", width, reach=reach).select(*keys, "_k", "_row").distinct().select("_row")
        if (own.most or 0) > width:
            genes = overlap_join(long.select(*dict.fromkeys([*keys, *id_columns, start, end])), there, keys, start, end, "_rs", "_re", width).groupBy(*id_columns).agg(listed(F.collect_set("gene")))
            out.append(long.join(genes, id_columns).withColumn("region", F.lit(kind)).select(*columns))
            hit = hit.unionByName(overlap_exists(long, there, keys, ["_row"], start, end, "_rs", "_re", width).select("_row"))
        left = keep(left.join(hit, "_row", "left_anti"), "level")
    none = left.withColumns({"genes": F.lit(""), "region": F.lit("Desert")}).select(*columns)
    return reduce(DataFrame.unionByName, out, none)


def interval_type(left_valley: Column, right_valley: Column, cut: Column, region: Column, length: Column) -> Column:
    """NLIR where a valley is shallow; DR (desert, or above 5000) before it; else NDG for long ones at genes, NFR for the rest."""
    dr = (region == "Desert") | (length > 5000)
    return F.when(dr, "DR").when((left_valley < cut) | (right_valley < cut), "NLIR").when(region.isin("Distal", "Proximal", "Genebody") & (length > 500), "NDG").otherwise("NFR")


def sites_of_fragments(fragments: DataFrame) -> DataFrame:
    """Two-base windows around the end of each fragment but a chromosome's last."""
    behind = carried(fragments, ["Chromosome"], ["Start"], after={"_more": F.lit(True)})
    return behind.where("_more").select(F.col("Chromosome").alias("chrom"), (F.col("End") - 1).alias("site_start"), (F.col("End") + 1).alias("site_end"))


def _with_cuts(rows: DataFrame, text: str, motif: str) -> DataFrame:
    """rows with _cuts: the places at which a motif such as A^AGCTT cuts the text (^: the cut; N: any base), also where motifs overlap.

    A pattern that only looks ahead is found at every place, in time that grows with the text."""
    cut = motif.index("^")
    pattern = re.compile(f"(?={motif.replace('^', '').replace('N', '[ACGT]')})")

    @F.pandas_udf("array<int>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [m.start() + cut for m in pattern.finditer(x)])

    return rows.withColumn("_cuts", cuts(F.col(text)))


def digest(rows: DataFrame, text: str, ids: list[str], motif: str) -> DataFrame:
    """Fragments between the cuts of a motif in texts that are a row each. Empty fragments are left out."""
    cut = _with_cuts(rows.withColumn("_n", F.char_length(text)), text, motif).select(*ids, "_n", "_cuts")
    inside = F.filter("_cuts", lambda x: x < F.col("_n"))
    bounds = cut.select(*ids, F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.col("_n")), inside))).alias("_b"))
    n = F.greatest(F.size("_b") - 1, F.lit(0))
    pieces = F.arrays_zip(F.slice("_b", F.lit(1), n).alias("start"), F.slice("_b", F.lit(2), n).alias("end"))  # a fragment's row holds its own two ends only
    return bounds.select(*ids, F.posexplode(pieces).alias("fragment", "_p")).select(*ids, "fragment", F.col("_p")["start"].alias("start"), F.col("_p")["end"].alias("end")).where("start < end")


def digest_chunks(chunks: DataFrame, ids: list[str], motif: str, size: int) -> DataFrame:
    """The same fragments from texts in chunks, so that no task holds a text: ids, fragment, start, end.

    chunks: ids, offset, sequence, as formats.read_fasta_chunks and formats.chunked give them: the size letters from offset on and at least as many of the next chunk as the motif has letters but one. A cut counts in the chunk in which its motif
    begins. Texts without letters give none; a null sequence is left out. ids have no nulls."""
    overlap = len(motif) - 2
    kept = keep(chunks.where(F.col("sequence").isNotNull()).select(*ids, "offset", "sequence"), "chunks")
    own = F.least(F.char_length("sequence"), F.lit(size))
    ends = kept.groupBy(*ids).agg(F.max(F.col("offset") + own).alias("_n"))  # a row a text
    marks = _with_cuts(kept.withColumn("sequence", F.substring("sequence", 1, size + overlap)), "sequence", motif)
    marks = marks.select(*ids, F.explode(F.transform("_cuts", lambda x: F.col("offset") + x)).alias("end")).distinct()
    bounds = marks.join(ends, ids).where("end < _n and end > 0").select(*ids, "end").unionByName(ends.select(*ids, F.explode(F.array(F.lit(0).cast("bigint"), F.col("_n"))).alias("end")).distinct())
    out = carried(bounds, ids, ["end"], sums={"fragment": F.lit(1)}, before={"start": F.col("end")})
    return out.where("start is not null").select(*ids, (F.col("fragment") - 2).alias("fragment"), "start", "end")


def consecutive(rows: DataFrame, part: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """Each start becomes the end before it; the first stays."""
    behind = carried(rows, part, order, before={"_e0": F.col(end)})
    return behind.withColumn("_s", F.coalesce("_e0", F.col(start))).drop(start, "_e0").withColumnRenamed("_s", start)


def neighbour_extend(rows: DataFrame, bins: DataFrame, index: str) -> DataFrame:
    """rows with start and end stretched over the bins before and after, as far as there are any. bins: chrom, idx, start, end."""
    near = carried(bins.select("chrom", "idx", "start", "end"), ["chrom"], ["idx"], before={"_s": F.col("start")}, after={"_e": F.col("end")})
    near = near.select("chrom", F.col("idx").alias(index), F.coalesce("_s", "start").alias("ext_start"), F.coalesce("_e", "end").alias("ext_end"))
    return rows.join(near, ["chrom", index], "left")
