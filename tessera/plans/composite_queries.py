"""Queries on compositions, and on the smaller operators that are one expression of Spark's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import kernels, stats
from tessera.operators import islands, matrix, signal
from tessera.plans import pipelines
from tessera.plans.interval_queries import _genes
from tessera.plans.registry import Registry
from tessera.plans.sequence_queries import _tagged
from tessera.sources import formats, views
from tessera.tables import scratch

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("SELECT event_id FROM ev WHERE event_id * 2654435761 % 1000 < 250")
def hash_sample(spark, sf_dir):
    """A quarter of the rows, the same on every run: sampling is what this operator does."""
    return views.events(spark, sf_dir).where("event_id * 2654435761 % 1000 < 250").select("event_id")


@query("SELECT chrom, bin1_id, bin2_id, cnt FROM map6_a WHERE cnt >= 2 AND bin2_id - bin1_id <= 40")
def intensity_floor(spark, sf_dir):
    m = views.contact_map(spark, sf_dir, wide=True)
    return m.where((F.col("cnt") >= 2) & (F.col("bin2_id") - F.col("bin1_id") <= 40))


@query(""", g AS (SELECT event_id, CAST(event_id * 37 % 400 AS BIGINT) AS n, event_id % 50 / 10.0 AS lv, event_id % 70 / 10.0 AS rv FROM ev), m AS (SELECT median(n) AS md FROM g), d AS (SELECT median(abs(n - md)) AS mad FROM g, m)
SELECT event_id FROM g, d WHERE n > 70 AND NOT ((lv <= 1.5 OR rv <= 1.5) AND n <= greatest(5 * mad, 70))""")
def interval_filters(spark, sf_dir):
    k = F.col("event_id")
    g = views.events(spark, sf_dir).select("event_id", F.lit(0).alias("start"), (k * 37 % 400).alias("end"), (k % 50 / 10.0).alias("left_valley"), (k % 70 / 10.0).alias("right_valley"), F.lit(1.5).alias("cut"))
    return pipelines.interval_filter(g, "cut").select("event_id")


@query("SELECT chrom, bin1_id, bin2_id, cnt, x.bs AS start1, y.be AS end2, y.bs - x.be AS apart FROM map6_a JOIN bins6 x ON x.bin_id = bin1_id JOIN bins6 y ON y.bin_id = bin2_id")
def bin_lookup(spark, sf_dir):
    b = views.bins(spark, True)
    one, two = b.toDF("bin1_id", "start1", "_e1"), b.toDF("bin2_id", "_s2", "end2")
    j = views.contact_map(spark, sf_dir, wide=True).join(F.broadcast(one), "bin1_id").join(F.broadcast(two), "bin2_id")
    return j.select("chrom", "bin1_id", "bin2_id", "cnt", "start1", "end2", (F.col("_s2") - F.col("_e1")).alias("apart"))


@query("SELECT event_id, pos, value FROM ev WHERE chrom = 'click' UNION ALL SELECT event_id, pos, value FROM ev WHERE chrom = 'view'")
def gathered(spark, sf_dir):
    e = views.events(spark, sf_dir)
    return e.where("chrom = 'click'").unionByName(e.where("chrom = 'view'")).select("event_id", "pos", "value")


@query("SELECT DISTINCT chrom, pos // 7200 AS block FROM ev")
def distinct_blocks(spark, sf_dir):
    return views.events(spark, sf_dir).select("chrom", F.floor(F.col("pos") / 7200).alias("block")).distinct()


@query("SELECT bin_id FROM bins WHERE bin_id NOT IN (SELECT bin1_id FROM map_a) AND bin_id NOT IN (SELECT bin2_id FROM map_a)")
def bins_without_contacts(spark, sf_dir):
    m = views.contact_map(spark, sf_dir).select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"))
    return views.bins(spark).join(m, "bin_id", "left_anti").select("bin_id")


@query("""SELECT chrom, round(corr(n, m), 6) AS r FROM (SELECT chrom, hour, n, lead(n) OVER (PARTITION BY chrom ORDER BY hour) AS m FROM hours) GROUP BY chrom""")
def neighbour_correlation(spark, sf_dir):
    h = views.hours(spark, sf_dir)
    after = h.select("chrom", (F.col("hour") - 1).alias("hour"), F.col("n").alias("m"))
    return h.join(after, ["chrom", "hour"]).groupBy("chrom").agg(F.round(F.corr("n", "m"), 6).alias("r"))


@query(""", k AS (SELECT range - 9 AS o, -((range - 9) * (range - 9) * (range - 9) - 27 * (range - 9)) / 729.0 * exp(-(range - 9) * (range - 9) / 18.0) / (3 * sqrt(2 * pi())) AS w FROM range(19)),
t AS (SELECT a.chrom, a.hour, round(sum(b.n * w), 9) AS v FROM hours a JOIN hours b ON a.chrom = b.chrom AND abs(a.hour - b.hour) <= 9 JOIN k ON o = a.hour - b.hour GROUP BY ALL),
c AS (SELECT chrom, hour, v, lag(v) OVER (PARTITION BY chrom ORDER BY hour) AS p FROM t) SELECT chrom, hour FROM c WHERE p < 0 AND v > 0""")
def third_derivative_crossings(spark, sf_dir):
    """Slots where the third derivative of the smoothed track turns from below zero to above."""
    from pyspark.sql import Window

    h = views.hours(spark, sf_dir).select("chrom", "hour", F.col("n").cast("double").alias("n"))
    t = signal.convolve(h, ["chrom"], "hour", "n", signal.gaussian(3.0, 3), "v").withColumn("v", F.round("v", 9))
    before = F.lag("v").over(Window.partitionBy("chrom").orderBy("hour"))
    return t.withColumn("p", before).where("p < 0 and v > 0").select("chrom", "hour")


@query("""SELECT chrom, hour, row_number() OVER (PARTITION BY chrom, side ORDER BY d, hour) AS place, side FROM (SELECT h.chrom, h.hour, abs(h.hour - m.hour) AS d, CAST(sign(h.hour - m.hour) AS INTEGER) AS side FROM hours h JOIN (SELECT chrom, min(hour) AS hour FROM (SELECT chrom, hour, n, max(n) OVER (PARTITION BY chrom) AS top FROM hours) WHERE n = top GROUP BY chrom) m ON m.chrom = h.chrom WHERE h.hour <> m.hour AND abs(h.hour - m.hour) <= 20)""")
def outward_from_peak(spark, sf_dir):
    from pyspark.sql import Window

    h = views.hours(spark, sf_dir)
    top = h.groupBy("chrom").agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("m"))
    d = F.col("hour") - F.col("m")
    near = h.join(F.broadcast(top), "chrom").where((d != 0) & (F.abs(d) <= 20)).withColumn("side", F.signum(d).cast("int")).withColumn("d", F.abs(d))
    w = Window.partitionBy("chrom", "side").orderBy("d", "hour")
    return near.select("chrom", "hour", F.row_number().over(w).cast("bigint").alias("place"), "side")


@query(""", s AS (SELECT chrom, bin1_id, bin2_id, cnt, sum(cnt) OVER (PARTITION BY chrom ORDER BY bin2_id - bin1_id, bin1_id) AS c, sum(cnt) OVER (PARTITION BY chrom) / 20.0 AS target FROM map6_a),
w AS (SELECT chrom, 0 AS n, CAST(0 AS DOUBLE) AS c, min(target) AS target FROM s GROUP BY chrom UNION ALL SELECT w.chrom, w.n + 1, CAST((SELECT min(s.c) FROM s WHERE s.chrom = w.chrom AND s.c >= w.c + w.target) AS DOUBLE), w.target FROM w WHERE w.c IS NOT NULL)
SELECT s.chrom, bin1_id, bin2_id, cnt, CAST((SELECT count(*) FROM w WHERE w.chrom = s.chrom AND w.n > 0 AND w.c < s.c) AS INTEGER) AS mass_bin FROM s""", recursive=True)
def greedy_mass_bins(spark, sf_dir):
    return pipelines.greedy_mass_bins(views.contact_map(spark, sf_dir, wide=True), 20)


@query(""", fc AS (SELECT chrom, bin1_id AS b, min(bin2_id) AS c FROM map_a GROUP BY ALL), sx AS (SELECT x.chrom, r.range AS i, min(coalesce(c, 720)) OVER (PARTITION BY x.chrom ORDER BY r.range ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM (SELECT DISTINCT chrom FROM map_a) x CROSS JOIN range(720) r LEFT JOIN fc ON fc.chrom = x.chrom AND b = r.range),
gw AS (SELECT chrom, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT chrom FROM map_a) UNION ALL SELECT gw.chrom, CASE WHEN t - 1 >= gw.i + 1 THEN t ELSE gw.i + 1 END FROM gw JOIN sx ON sx.chrom = gw.chrom AND sx.i = gw.i)
SELECT gw.chrom, unnest(range(gw.i, least(t, 720))) AS bin_id FROM gw JOIN sx ON sx.chrom = gw.chrom AND sx.i = gw.i WHERE t - 1 >= gw.i + 1""", recursive=True)
def greedy_gap_regions(spark, sf_dir):
    """Bins in gaps by the greedy jump over the first columns of the rows."""
    first = views.contact_map(spark, sf_dir).groupBy("chrom", F.col("bin1_id").alias("bin_id")).agg(F.min("bin2_id").alias("c"))
    return kernels.gap_bins(first, first.select("chrom").distinct().withColumn("bins", F.lit(720)))


@query(""", ed AS (SELECT chrom, bin1_id AS a, bin2_id AS b FROM map_a UNION SELECT chrom, bin2_id, bin1_id FROM map_a), rc AS (SELECT chrom, a AS o, a AS t FROM ed UNION SELECT rc.chrom, rc.o, ed.b FROM rc JOIN ed ON ed.chrom = rc.chrom AND ed.a = rc.t)
SELECT chrom, o AS bin_id, min(t) AS comp FROM rc GROUP BY chrom, o""", recursive=True)
def connected_components(spark, sf_dir):
    """The smallest bin that each bin of a map can reach."""

    def run(part):
        import numpy as np
        import pandas as pd

        ids = np.unique(np.concatenate([part.bin1_id, part.bin2_id]))
        label = kernels.connected_labels(len(ids), np.searchsorted(ids, part.bin1_id), np.searchsorted(ids, part.bin2_id))
        return pd.DataFrame({"chrom": part.chrom.iloc[0], "bin_id": ids, "comp": ids[label]})

    return views.contact_map(spark, sf_dir).groupBy("chrom").applyInPandas(run, "chrom string, bin_id bigint, comp bigint")


@query()
def merged_map(spark, sf_dir):
    from tessera.plans.interval_queries import overlap_count_left

    sites = overlap_count_left(spark, sf_dir).groupBy(F.floor(F.col("bin_id") / 6).alias("bin_id")).agg(F.sum("n").alias("sites"))
    merged, weights = pipelines.merge_maps(views.contact_map(spark, sf_dir, 1, True), views.contact_map(spark, sf_dir, 2, True), sites)
    one, two = (weights.select("chrom", F.col("bin_id").alias(f"bin{i}_id"), F.col("bias").alias(f"weight{i}")) for i in (1, 2))
    return merged.join(one, ["chrom", "bin1_id"]).join(two, ["chrom", "bin2_id"]).select("chrom", "bin1_id", "bin2_id", F.round("cnt", 6).alias("cnt"), F.round("weight1", 6).alias("weight1"), F.round("weight2", 6).alias("weight2"))


def _six_bins(spark, sf_dir):
    chroms = views.events(spark, sf_dir).select("chrom").distinct()
    return chroms.crossJoin(views.bins(spark, True)).select("chrom", "bin_id", F.col("bs").alias("start"), F.col("be").alias("end"), F.lit(1).alias("nuc"))  # chromosomes x fixed bins


@query()
def called_segments(spark, sf_dir):
    return pipelines.segment(views.contact_map(spark, sf_dir, wide=True), _six_bins(spark, sf_dir), window=5, zeros=4).withColumn("score", F.round("score", 6))


@query()
def called_segments_of_regions(spark, sf_dir):
    """Domains of a map whose bins are regions: gaps and boundaries are known."""
    b = F.col("bin_id")
    kinds = _six_bins(spark, sf_dir).withColumn("kind", F.when(b % 23 == 11, 0).when(b % 5 == 2, 1).otherwise(2))
    return pipelines.segment(views.contact_map(spark, sf_dir, wide=True), kinds, window=5, regions_map=True).withColumn("score", F.round("score", 6))


def _transfer(spark, sf_dir):
    """Segments and bins of hours, boundaries of another type at errors, and two pairs of tracks."""
    e = views.events(spark, sf_dir)
    chroms = e.select("chrom").distinct()
    bins = chroms.crossJoin(views.bins(spark)).select("chrom", "bin_id", F.col("bs").alias("start"), F.col("be").alias("end"))  # chromosomes x fixed bins
    hour = F.col("hour")
    tags = views.hours(spark, sf_dir).withColumn("tag", F.when(hour % 12 < 2, "boundary").when(hour % 37 < 4, "gap").otherwise("domain"))
    runs = islands.run_lengths(tags, ["chrom"], "hour", "tag")
    called = runs.select("chrom", "first", "last", (F.col("first") * 3600).alias("start"), ((F.col("last") + 1) * 3600).alias("end"), "tag", F.lit(-2.0).alias("score"))
    k = F.col("event_id")
    source = e.where(k % 6 == 0).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 600 + k % 5 * 1500).alias("end"))

    def track(a: int, b: int):
        return e.where(k % a != 0).select("chrom", F.col("pos").alias("t_start"), (F.col("pos") + 900).alias("t_end"), (F.col("value") * b).alias("value"))

    return called, bins, source, [(track(5, 1), track(7, 2)), (track(3, 3), track(2, 1))]


@query()
def transferred_boundaries(spark, sf_dir):
    return pipelines.transfer_boundaries(*_transfer(spark, sf_dir), 14_400)


_LOOP_GENES = """, genes AS (SELECT 'g' || c_custkey AS gene, c_mktsegment AS chrom, CAST(c_custkey * 7919 % 200000000 AS BIGINT) AS s, CAST(c_custkey * 7919 % 200000000 + 500 + c_custkey % 5 * 1000 AS BIGINT) AS e, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM customer),
r0 AS (SELECT chrom, 'Promoter' AS region, 32 AS bit, gene, CASE WHEN strand = '+' THEN s - 5000 ELSE e - 1000 END AS a, CASE WHEN strand = '+' THEN s + 1000 ELSE e + 5000 END AS b FROM genes
UNION ALL SELECT chrom, 'Genebody', 8, gene, s + 1000, e FROM genes
UNION ALL SELECT chrom, 'Distal', 2, gene, CASE WHEN strand = '+' THEN s - 250000 ELSE e + 5000 END, CASE WHEN strand = '+' THEN s - 5000 ELSE e + 250000 END FROM genes
UNION ALL SELECT chrom, 'Distal', 2, gene || '_bi', CASE WHEN strand = '+' THEN s + 5000 ELSE e - 250000 END, CASE WHEN strand = '+' THEN s + 250000 ELSE e - 5000 END FROM genes),
regions AS (SELECT chrom, region, bit, gene, CASE WHEN a < 0 THEN 1 ELSE a END AS s, CASE WHEN b < 0 THEN 1 ELSE b END AS e FROM r0 WHERE (CASE WHEN a < 0 THEN 1 ELSE a END) < (CASE WHEN b < 0 THEN 1 ELSE b END)),
lp AS (SELECT c_custkey AS k, c_mktsegment AS chrom, CAST(c_custkey * 7919 % 200000000 + c_custkey % 3 * 40000 AS BIGINT) AS s1, CAST(c_custkey * 7919 % 200000000 + c_custkey % 7 * 90000 AS BIGINT) AS s2 FROM customer),
pl AS (SELECT DISTINCT chrom, s1 AS p FROM lp UNION SELECT DISTINCT chrom, s2 FROM lp),
hit AS (SELECT pl.chrom, p, bit, region, gene FROM pl JOIN regions r ON r.chrom = pl.chrom AND p < r.e AND p + 300 > r.s), tp AS (SELECT chrom, p, max(bit) AS bit FROM hit GROUP BY ALL),
an AS (SELECT pl.chrom, pl.p, coalesce(max(region), 'Desert') AS annot, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene), '') AS detail FROM pl LEFT JOIN tp ON tp.chrom = pl.chrom AND tp.p = pl.p LEFT JOIN hit ON hit.chrom = tp.chrom AND hit.p = tp.p AND hit.bit = tp.bit GROUP BY ALL),
l AS (SELECT lp.*, x.annot AS a1, x.detail AS g1, y.annot AS a2, y.detail AS g2 FROM lp JOIN an x ON x.chrom = lp.chrom AND x.p = s1 JOIN an y ON y.chrom = lp.chrom AND y.p = s2),
c AS (SELECT *, CASE a1 WHEN 'Distal' THEN 'D1' WHEN 'Promoter' THEN 'P1' WHEN 'Genebody' THEN 'G1' ELSE a1 END AS c1, CASE a2 WHEN 'Distal' THEN 'D1' WHEN 'Promoter' THEN 'P1' WHEN 'Genebody' THEN 'G1' ELSE a2 END AS c2,
list_sort(list_distinct(list_filter(list_intersect([replace(x, '_bi', '') FOR x IN string_split(g1, ',')], [replace(x, '_bi', '') FOR x IN string_split(g2, ',')]), lambda x: x <> ''))) AS common FROM l),
d AS (SELECT *, least(c1, c2) || ' ' || greatest(c1, c2) AS kk FROM c),
o AS (SELECT k, a1, g1, a2, g2, CASE WHEN len(common) > 0 THEN (CASE kk WHEN 'D1 P1' THEN 'D1P1' WHEN 'D1 G1' THEN 'D1G1' WHEN 'D1 D1' THEN 'D1D1' WHEN 'G1 G1' THEN 'G1G1' WHEN 'G1 P1' THEN 'P1G1' ELSE 'unknown' END)
WHEN kk = 'P1 P1' THEN 'P2P1' WHEN 'P1' IN (c1, c2) THEN 'D1P1' ELSE 'other' END AS assigned_annotation, CASE WHEN len(common) > 0 THEN array_to_string(common, ',') WHEN kk = 'P1 P1' THEN g1 || ';' || g2 WHEN c1 = 'P1' THEN g1 ELSE g2 END AS genes FROM d)"""


@query(_LOOP_GENES + " SELECT k, a1 AS annot1, g1 AS detail1, a2 AS annot2, g2 AS detail2, assigned_annotation, genes FROM o WHERE contains(assigned_annotation, 'P1')")
def transferred_loops(spark, sf_dir):
    """Loops between places near and far from genes, with what lies at both ends, where one is a promoter."""
    k = F.col("c_custkey")
    s1, s2 = k * 7919 % 200_000_000 + k % 3 * 40_000, k * 7919 % 200_000_000 + k % 7 * 90_000
    chrom = F.col("c_mktsegment")
    found = views.table(spark, sf_dir, "customer").select(k.alias("k"), chrom.alias("chrom1"), s1.alias("start1"), (s1 + 300).alias("end1"), chrom.alias("chrom2"), s2.alias("start2"), (s2 + 300).alias("end2"))
    return pipelines.transfer_loops(found, _genes(spark, sf_dir)).select("k", "annot1", "detail1", "annot2", "detail2", "assigned_annotation", "genes")


@query("SELECT name FROM (SELECT DISTINCT 'chr' || p_size || CASE WHEN p_partkey % 7 = 0 THEN '_random' WHEN p_partkey % 11 = 0 THEN '_chrUn' WHEN p_partkey % 13 = 0 THEN '_chrEBV' ELSE '' END AS name FROM part) WHERE NOT contains(name, '_')", plain=True)
def regular_chromosomes(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("chr"), F.col("p_size"), F.when(k % 7 == 0, "_random").when(k % 11 == 0, "_chrUn").when(k % 13 == 0, "_chrEBV").otherwise(""))
    return formats.regular_chromosomes(views.table(spark, sf_dir, "part").select(name.alias("name")).distinct(), "name")


@query("SELECT b.chrom, b.bin1_id, b.bin2_id, round(log2((coalesce(a.cnt, 0) + 1) / (b.cnt + 1)), 6) AS a_to_b, round(log2((coalesce(a.cnt, 0) + 1) / (b.cnt * 2 + 1)), 6) AS a_to_c, round(log2((b.cnt + 1) / (b.cnt * 2 + 1)), 6) AS b_to_c FROM map6_b b LEFT JOIN map6_a a USING (chrom, bin1_id, bin2_id)")
def md_of_all_pairs(spark, sf_dir):
    """M values of every pair of three samples."""
    a, b = (views.contact_map(spark, sf_dir, k, wide=True).withColumnRenamed("cnt", n) for k, n in ((1, "a"), (2, "b")))
    rows = b.join(a, ["chrom", "bin1_id", "bin2_id"], "left").fillna(0, ["a"]).withColumn("c", F.col("b") * 2)
    out = stats.md_pairs(rows, ["a", "b", "c"])
    return out.select("chrom", "bin1_id", "bin2_id", *[F.round(c, 6).alias(c) for c in ("a_to_b", "a_to_c", "b_to_c")])


@query(", z AS (SELECT chrom, hour, n, row_number() OVER (ORDER BY chrom, hour) AS r FROM hours), y AS (SELECT chrom, hour, n, row_number() OVER (ORDER BY chrom, hour) AS r FROM hours WHERE hour % 2 = 0) SELECT z.chrom, z.hour, z.n, y.chrom AS chrom_2, y.hour AS hour_2, y.n AS n_2 FROM z JOIN y USING (r)")
def zipped_rows(spark, sf_dir):
    h = views.hours(spark, sf_dir).select("chrom", "hour", "n")
    return formats.zipped(h, h.where("hour % 2 = 0"), "chrom", ["hour"])


@query("SELECT b.chrom, b.bin_id, m.marginal FROM (SELECT DISTINCT chrom, bin_id FROM (SELECT DISTINCT chrom FROM ev) CROSS JOIN bins6) b LEFT JOIN (SELECT chrom, bin_id, CAST(marginal AS BIGINT) AS marginal FROM marg6) m ON m.chrom = b.chrom AND m.bin_id = b.bin_id")
def bin_column(spark, sf_dir):
    """Bins with a column replaced."""
    old = _six_bins(spark, sf_dir).select("chrom", "bin_id", F.lit(-1).alias("marginal"))
    return formats.with_bin_column(old, "marginal", matrix.marginals(views.contact_map(spark, sf_dir, wide=True)))


@query("SELECT chrom, bin1_id, bin2_id, CAST(cnt AS DOUBLE) AS cnt FROM map_a WHERE chrom = 'click' AND bin1_id >= 100 AND bin2_id <= 400")
def region_fetch(spark, sf_dir):
    """A region of a map that is stored in tiles."""
    m = views.contact_map(spark, sf_dir)
    bins = m.select("chrom").distinct().crossJoin(views.bins(spark))  # chromosomes x fixed bins
    path = scratch(spark, "map")
    formats.write_tiles(bins, m, path, side=128)
    return formats.read_region(spark, path, "click", 100, 400, side=128)[1].select("chrom", "bin1_id", "bin2_id", F.col("cnt").cast("double").alias("cnt"))


@query()
def region_map(spark, sf_dir):
    runs = islands.run_lengths(_tagged(spark, sf_dir), ["chrom"], "hour", "tag").where("tag = 'domain'").select("chrom", "first", "last")
    return pipelines.region_map(views.contact_map(spark, sf_dir), runs, 20).withColumn("mean", F.round("mean", 6))


@query()
def called_loops(spark, sf_dir):
    bins = _six_bins(spark, sf_dir)
    return pipelines.call_loops(views.contact_map(spark, sf_dir, wide=True), bins, 43_200, 432_000, 43_200, 1_296_000, q=0.9, least=500, densities=(0.05, 0.1), dense_wide=0.05, q_most=0.9)


@query()
def nucleosome_bins(spark, sf_dir):
    """Bins from customers as nucleosomes, each 90 to 189 bases wide, on chromosomes of their segment."""
    k = F.col("c_custkey")
    start = k * 104729 % 230_000_000
    n = views.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("chrom"), start.alias("start"), (start + 90 + k % 100).alias("end"), (1 + k % 7).cast("double").alias("height"), (5 + k % 13).cast("double").alias("auc"), F.when(k % 9 == 0, "Shoulder").otherwise("MainPeak").alias("property"), (1 + k % 11).cast("double").alias("nlp_peak"), (k % 17 / 3.0).alias("nlp_valley"))
    chroms = n.select("chrom").distinct().withColumn("length", F.lit(231_000_000).cast("bigint"))
    return pipelines.build_bins(n, _genes(spark, sf_dir), chroms).withColumn("positioning", F.round("positioning", 6))
