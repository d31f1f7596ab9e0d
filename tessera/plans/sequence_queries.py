"""Queries on runs, tracks and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import intervals, islands, positions, segments, signal
from tessera.plans.registry import Registry
from tessera.sources import views

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_TAGGED = """, tg AS (SELECT chrom, hour, n, value, CASE WHEN n = 0 THEN 'gap' WHEN n <= 2 THEN 'boundary' ELSE 'domain' END AS tag FROM hours),
ch AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM tg), rn AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM ch),
sg AS (SELECT chrom, tag, run, min(hour) AS f, max(hour) AS l, sum(n) AS nuc, avg(coalesce(value, 1)) AS score FROM rn GROUP BY chrom, tag, run)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.hours(spark, sf_dir)
    return h.withColumn("tag", F.when(F.col("n") == 0, "gap").when(F.col("n") <= 2, "boundary").otherwise("domain"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.col("hour")
    return _tagged(spark, sf_dir).select("chrom", hour.alias("bin_id"), (hour * 600).alias("start"), (hour * 600 + 600).alias("end"), "tag", F.coalesce("value", F.lit(1.0)).alias("score"), F.col("n").alias("nuc"))


@query(_TAGGED + ' SELECT chrom, tag, f AS "first", l AS "last", l - f + 1 AS n FROM sg')
def rle_segments(spark, sf_dir):
    return islands.run_lengths(_tagged(spark, sf_dir), ["chrom"], "hour", "tag").select("chrom", "tag", "first", "last", "n")


@query(""", z AS (SELECT chrom, hour, n = 0 AS zero FROM hours), c AS (SELECT *, CASE WHEN zero IS DISTINCT FROM lag(zero) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM z), r AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM c),
g AS (SELECT chrom, run, zero, min(hour) AS f, max(hour) AS l, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, sum(CASE WHEN NOT zero AND n > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY f) AS grp FROM g)
SELECT chrom, min(CASE WHEN zero THEN f END) AS "first", max(CASE WHEN zero THEN l END) AS "last", CAST(sum(CASE WHEN zero THEN n ELSE 0 END) AS BIGINT) AS zeros FROM k WHERE zero OR n <= 10 GROUP BY chrom, grp HAVING sum(CASE WHEN zero THEN n ELSE 0 END) >= 3""")
def zero_runs_tolerant(spark, sf_dir):
    return islands.zero_runs(views.hours(spark, sf_dir), ["chrom"], "hour", "n", 10, 3)


@query(""", q AS (SELECT chrom, hour, hour - row_number() OVER (PARTITION BY chrom ORDER BY hour) AS g FROM hours WHERE n > 0) SELECT chrom, min(hour) AS "first", max(hour) AS "last" FROM q GROUP BY chrom, g HAVING max(hour) - min(hour) >= 3""")
def process_regions(spark, sf_dir):
    h = views.hours(spark, sf_dir).withColumnRenamed("hour", "bin_id")
    return segments.process_regions(h, h.where("n = 0").select("chrom", "bin_id"))


_GROUPS = """, b AS (SELECT chrom, bin1_id, bin2_id, cnt, CASE WHEN lag(bin1_id) OVER w IS NULL OR abs(bin1_id - lag(bin1_id) OVER w) > 3 OR abs(bin2_id - lag(bin2_id) OVER w) > 3 THEN 1 ELSE 0 END AS c FROM map_a WINDOW w AS (PARTITION BY chrom ORDER BY bin1_id, bin2_id)),
g AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY bin1_id, bin2_id) AS grp FROM b), s AS (SELECT *, (row_number() OVER (PARTITION BY chrom, grp ORDER BY bin1_id, bin2_id) - 1) // 4 AS split FROM g)"""


@query(_GROUPS + ' SELECT chrom, bin1_id, bin2_id, CAST(grp AS BIGINT) AS "group", split FROM s')
def pixel_groups(spark, sf_dir):
    return islands.pixel_groups(views.contact_map(spark, sf_dir), ["chrom"], "bin1_id", "bin2_id", 3, 4).select("chrom", "bin1_id", "bin2_id", "group", "split")


@query(_GROUPS + ' SELECT chrom, bin1_id, bin2_id, cnt, CAST(grp AS BIGINT) AS "group", split FROM (SELECT *, row_number() OVER (PARTITION BY chrom, grp, split ORDER BY cnt DESC, bin1_id, bin2_id) AS place FROM s) WHERE place = 1')
def pixel_group_peak(spark, sf_dir):
    return islands.peaks(islands.pixel_groups(views.contact_map(spark, sf_dir), ["chrom"], "bin1_id", "bin2_id", 3, 4), ["chrom"], "bin1_id", "bin2_id", "cnt")


_OVERRIDE = """, tg AS (SELECT chrom, hour, n, CASE WHEN hour % 50 < 3 THEN 'gap' WHEN n = 0 THEN 'gap' WHEN n <= 2 THEN 'boundary' ELSE 'domain' END AS tag, coalesce(value, 1) AS value FROM hours),
ch AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM tg), rn AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM ch),
sg AS (SELECT chrom, CASE WHEN tag = 'domain' AND sum(n) < 4 THEN 'gap' ELSE tag END AS tag, min(hour) AS f, max(hour) AS l, CASE WHEN tag = 'domain' AND sum(n) < 4 THEN 1.0 ELSE avg(value) END AS score, sum(n) AS nuc FROM rn GROUP BY chrom, tag, run),
c2 AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY chrom ORDER BY f) THEN 1 ELSE 0 END AS c FROM sg), r2 AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY f) AS run FROM c2),
ov AS (SELECT chrom, tag, min(f) AS f, max(l) AS l, 600 * min(f) AS s, 600 * max(l) + 600 AS e, avg(score) AS score, sum(nuc) AS nuc FROM r2 GROUP BY chrom, tag, run)"""


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bins(spark, sf_dir)
    return segments.override_gaps(b, b.where("bin_id % 50 < 3"), 4)


@query(_OVERRIDE + ' SELECT chrom, tag, f AS "first", l AS "last", s AS "start", e AS "end", round(score, 6) AS score, CAST(nuc AS BIGINT) AS nuc FROM ov')
def gap_override(spark, sf_dir):
    return _overridden(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_OVERRIDE + """, t3 AS (SELECT *, CASE WHEN tag = 'gap' AND e - s <= 1000 THEN 'boundary' ELSE tag END AS t FROM ov), c3 AS (SELECT *, CASE WHEN t IS DISTINCT FROM lag(t) OVER (PARTITION BY chrom ORDER BY f) THEN 1 ELSE 0 END AS c FROM t3), r3 AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY f) AS run FROM c3)
SELECT chrom, t AS tag, min(f) AS "first", max(l) AS "last", min(s) AS "start", max(e) AS "end", round(CASE WHEN t = 'domain' THEN least(avg(score), -1) ELSE avg(score) END, 6) AS score, CAST(sum(nuc) AS BIGINT) AS nuc FROM r3 GROUP BY chrom, t, run""")
def small_gap_relabel(spark, sf_dir):
    return segments.close_small_gaps(_overridden(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(""", k AS (SELECT chrom, hour, CASE WHEN n = 0 THEN 'gap' WHEN n > 3 THEN 'boundary' ELSE 'domain' END AS tag, n FROM hours), ch AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM k), rn AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM ch),
g AS (SELECT chrom, tag, min(hour) AS f, max(hour) AS l, bool_and(n / 100.0 < 0.05) AS low FROM rn GROUP BY chrom, tag, run)
SELECT chrom, f AS "first", l AS "last", CASE WHEN tag = 'domain' AND low THEN 'boundary' ELSE tag END AS tag FROM g WHERE tag <> 'boundary' OR l - f + 1 >= 2""")
def segment_kinds(spark, sf_dir):
    h = views.hours(spark, sf_dir).select("chrom", F.col("hour").alias("bin_id"), (F.col("n") == 0).alias("gap"), (F.col("n") > 3).alias("boundary"), (F.col("n") / 100.0).alias("p"))
    return segments.runs_of_kinds(h).drop("score")


@query("SELECT chrom, hour, 1 - CAST(trunc(n / greatest(m, 1) * 10) AS INT) AS class FROM (SELECT *, max(n) OVER (PARTITION BY chrom) AS m FROM hours)")
def score_classes(spark, sf_dir):
    h = views.hours(spark, sf_dir)
    top = h.groupBy("chrom").agg(F.max("n").alias("m"))
    return h.join(F.broadcast(top), "chrom").select("chrom", "hour", segments.score_class(F.col("n"), F.greatest("m", F.lit(1))).alias("class"))


@query(""", w AS (SELECT chrom, hour, sum(n) OVER (PARTITION BY chrom ORDER BY hour RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS a, avg(n) OVER (PARTITION BY chrom ORDER BY hour RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS b, sum(n) OVER (PARTITION BY chrom ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 24 FOLLOWING) AS c, avg(n) OVER (PARTITION BY chrom ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 24 FOLLOWING) AS d FROM hours)
SELECT chrom, hour, CAST(a AS BIGINT) AS sum_5, CAST(c AS BIGINT) AS sum_24, round(greatest(b, d), 6) AS most, round(least(b, d), 6) AS least FROM w""")
def rolling_background(spark, sf_dir):
    return signal.background(views.hours(spark, sf_dir).select("chrom", "hour", "n"), ["chrom"], "hour", "n", [5, 24]).select("chrom", "hour", "sum_5", "sum_24", F.round("most", 6).alias("most"), F.round("least", 6).alias("least"))


@query(""", k AS (SELECT range - 9 AS o, exp(-(range - 9) * (range - 9) / 18.0) / (3 * sqrt(2 * pi())) AS w FROM range(19))
SELECT a.chrom, a.hour, round(sum(b.n * w), 6) AS smooth FROM hours a JOIN hours b ON a.chrom = b.chrom AND abs(a.hour - b.hour) <= 9 JOIN k ON o = a.hour - b.hour GROUP BY ALL""")
def gaussian_smooth(spark, sf_dir):
    h = views.hours(spark, sf_dir).select("chrom", "hour", F.col("n").cast("double").alias("n"))
    return signal.convolve(h, ["chrom"], "hour", "n", signal.gaussian(3.0)).withColumn("smooth", F.round("smooth", 6))


_LOG = """, lg AS (SELECT chrom, hour, lag(n) OVER w - 2 * n + lead(n) OVER w AS v FROM hours WINDOW w AS (PARTITION BY chrom ORDER BY hour)), nz AS (SELECT chrom, hour, sign(v) AS s FROM lg WHERE v <> 0)"""


@query(_LOG + """, ch AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM nz), rn AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM ch)
SELECT chrom, min(hour) AS "first", max(hour) AS "last" FROM rn WHERE s < 0 GROUP BY chrom, run""")
def zero_crossings(spark, sf_dir):
    h = views.hours(spark, sf_dir).select("chrom", "hour", F.col("n").cast("double").alias("n"))
    bend = signal.convolve(h, ["chrom"], "hour", "n", [(-1, 1.0), (0, -2.0), (1, 1.0)], "v").where("hour between 1 and 718")
    return islands.negative_runs(bend, ["chrom"], "hour", "v")


@query(""", ch AS (SELECT *, CASE WHEN n IS DISTINCT FROM lag(n) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM hours), rn AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM ch), g AS (SELECT chrom, n, min(hour) AS f, max(hour) AS l FROM rn GROUP BY chrom, n, run),
w AS (SELECT *, lag(n) OVER (PARTITION BY chrom ORDER BY f) AS b, lead(n) OVER (PARTITION BY chrom ORDER BY f) AS a FROM g) SELECT chrom, f AS "first", l AS "last", n AS height FROM w WHERE n > b AND n > a""")
def local_maxima(spark, sf_dir):
    return islands.local_maxima(views.hours(spark, sf_dir).withColumnRenamed("n", "height"), ["chrom"], "hour", "height")


@query(""", ch AS (SELECT *, CASE WHEN n IS DISTINCT FROM lag(n) OVER (PARTITION BY chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM hours), rn AS (SELECT *, sum(c) OVER (PARTITION BY chrom ORDER BY hour) AS run FROM ch), g AS (SELECT chrom, n, min(hour) AS f, max(hour) AS l FROM rn GROUP BY chrom, n, run),
w AS (SELECT *, lag(n) OVER (PARTITION BY chrom ORDER BY f) AS b, lead(n) OVER (PARTITION BY chrom ORDER BY f) AS a FROM g) SELECT chrom, f AS "first", l AS "last", n AS depth FROM w WHERE n < b AND n < a""")
def local_minima(spark, sf_dir):
    return islands.local_minima(views.hours(spark, sf_dir).withColumnRenamed("n", "depth"), ["chrom"], "hour", "depth")


def _second(sigma: int) -> str:
    return f"(o * o - {sigma * sigma}) / {float(sigma ** 4)} * exp(-o * o / {2.0 * sigma * sigma}) / ({sigma} * sqrt(2 * pi()))"


_CURVED = f""", k3 AS (SELECT o, {_second(3)} AS w FROM (SELECT range - 9 AS o FROM range(19))), k1 AS (SELECT o, {_second(1)} AS w FROM (SELECT range - 3 AS o FROM range(7))),
l3 AS (SELECT a.chrom, a.hour, round(sum(b.n * w), 9) AS v FROM hours a JOIN k3 ON TRUE JOIN hours b ON b.chrom = a.chrom AND b.hour = a.hour - o GROUP BY ALL), l1 AS (SELECT a.chrom, a.hour, round(sum(b.n * w), 9) AS v FROM hours a JOIN k1 ON TRUE JOIN hours b ON b.chrom = a.chrom AND b.hour = a.hour - o GROUP BY ALL),
b AS (SELECT 3 AS sigma, chrom, hour, sign(v) AS s FROM l3 WHERE v <> 0 UNION ALL SELECT 1, chrom, hour, sign(v) FROM l1 WHERE v <> 0),
ch AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY sigma, chrom ORDER BY hour) THEN 1 ELSE 0 END AS c FROM b), rn AS (SELECT *, sum(c) OVER (PARTITION BY sigma, chrom ORDER BY hour) AS run FROM ch), rg AS (SELECT sigma, chrom, min(hour) AS f, max(hour) AS l FROM rn WHERE s < 0 GROUP BY sigma, chrom, run)"""


def _curved(spark: SparkSession, sf_dir: str, sigma: float) -> DataFrame:
    h = views.hours(spark, sf_dir).select("chrom", "hour", F.col("n").cast("double").alias("n"))
    bend = signal.convolve(h, ["chrom"], "hour", "n", signal.gaussian(sigma, 2), "v").withColumn("v", F.round("v", 9))
    return islands.negative_runs(bend, ["chrom"], "hour", "v")


@query(_CURVED + ' SELECT CAST(sigma AS INTEGER) AS sigma, chrom, f AS "first", l AS "last" FROM rg')
def curved_ranges(spark, sf_dir):
    """Ranges of negative curvature of the track smoothed with the wide and the narrow Gaussian."""
    return _curved(spark, sf_dir, 3.0).withColumn("sigma", F.lit(3)).unionByName(_curved(spark, sf_dir, 1.0).withColumn("sigma", F.lit(1)))


@query(_CURVED + """, t3 AS (SELECT range - 9 AS o, -((range - 9) * (range - 9) * (range - 9) - 27 * (range - 9)) / 729.0 * exp(-(range - 9) * (range - 9) / 18.0) / (3 * sqrt(2 * pi())) AS w FROM range(19)),
td AS (SELECT a.chrom, a.hour, round(sum(b.n * w), 9) AS v FROM hours a JOIN t3 ON TRUE JOIN hours b ON b.chrom = a.chrom AND b.hour = a.hour - o GROUP BY ALL), c3 AS (SELECT chrom, hour, v, lag(v) OVER (PARTITION BY chrom ORDER BY hour) AS p FROM td), up AS (SELECT chrom, hour FROM c3 WHERE p < 0 AND v > 0)
SELECT rg.chrom, f AS "first", l AS "last", hour AS middle FROM rg JOIN up ON up.chrom = rg.chrom AND hour BETWEEN f AND l WHERE sigma = 3""")
def crossings_in_ranges(spark, sf_dir):
    """Where the third derivative turns upwards inside the ranges of negative curvature: their middles."""
    h = views.hours(spark, sf_dir).select("chrom", "hour", F.col("n").cast("double").alias("n"))
    t = signal.convolve(h, ["chrom"], "hour", "n", signal.gaussian(3.0, 3), "v").withColumn("v", F.round("v", 9))
    before = F.lag("v").over(Window.partitionBy("chrom").orderBy("hour"))
    up = t.withColumn("p", before).where("p < 0 and v > 0").select("chrom", F.col("hour").alias("middle"), (F.col("hour") + 1).alias("_e"))
    ranges = _curved(spark, sf_dir, 3.0).withColumn("_end", F.col("last") + 1)
    return intervals.overlap_join(ranges, up, ["chrom"], "first", "_end", "middle", "_e", 48).select("chrom", "first", "last", "middle")


@query(_CURVED + """, sm AS (SELECT a.chrom, a.hour, a.n, sum(b.n * exp(-o * o / 18.0) / (3 * sqrt(2 * pi()))) AS y FROM hours a JOIN k3 ON TRUE JOIN hours b ON b.chrom = a.chrom AND b.hour = a.hour - o GROUP BY ALL),
t AS (SELECT rg.chrom, f, count(*) AS n, max(s.n) AS height, covar_pop(s.n, y) AS xy, var_pop(s.n) AS xx, var_pop(y) AS yy, sum(y) AS s, min(y) AS low, arg_min(y, hour) AS a, arg_max(y, hour) AS b FROM rg JOIN sm s ON s.chrom = rg.chrom AND hour BETWEEN f AND l WHERE sigma = 3 GROUP BY ALL)
SELECT chrom, f AS "first", height, round((n * xy + 1e-8) / sqrt((n * xx + 1e-8) * (n * yy + 1e-8)), 6) AS correlation, round((s - n * low + 1e-7) / (n * a + (b - a) / n * n * (n - 1) / 2 - n * low + 1e-7), 6) AS concavity FROM t WHERE n > 2""")
def range_shapes(spark, sf_dir):
    """Height, correlation with the smoothed track and concavity of each range of more than two slots."""
    h = views.hours(spark, sf_dir).select("chrom", "hour", F.col("n").cast("double").alias("n"))
    track = h.join(signal.convolve(h, ["chrom"], "hour", "n", signal.gaussian(3.0), "y"), ["chrom", "hour"])
    ranges = _curved(spark, sf_dir, 3.0).where("last - first > 1")
    shapes = signal.shape_over(ranges.withColumn("id", F.col("first")), track, ["chrom"], ["id"], "first", "last", "hour", "n", "y")
    return shapes.select("chrom", F.col("id").alias("first"), F.col("height").cast("bigint").alias("height"), F.round("correlation", 6).alias("correlation"), F.round("concavity", 6).alias("concavity"))


@query(_TAGGED + ' SELECT chrom, CAST(run AS BIGINT) AS run, max(n) AS height, CAST(sum(n) AS BIGINT) AS area FROM rn WHERE tag = \'domain\' GROUP BY ALL')
def profile_over(spark, sf_dir):
    t = _tagged(spark, sf_dir)
    runs = islands.run_lengths(t, ["chrom"], "hour", "tag").where("tag = 'domain'").select("chrom", F.col("run").cast("bigint").alias("run"), "first", "last")
    return signal.profile_over(runs, t.select("chrom", "hour", "n"), ["chrom"], ["run"], "first", "last", "hour", "n")


@query(_TAGGED + """, d AS (SELECT chrom, run AS dom_id, 3600 * f AS s, 3600 * (l + 1) AS e FROM sg WHERE tag = 'domain' AND l > f), m AS (SELECT chrom, 3600 * f + 1800 AS bs, 3600 * f + 2000 AS be FROM sg WHERE tag = 'domain' AND l > f AND run % 2 = 0),
j AS (SELECT d.chrom, dom_id, s, e, bs, be FROM d LEFT JOIN m ON m.chrom = d.chrom AND bs < e AND be > s)
SELECT chrom, CAST(dom_id AS BIGINT) AS dom_id, 'domain' AS tag, s AS "start", e AS "end" FROM j WHERE bs IS NULL UNION ALL SELECT chrom, CAST(dom_id AS BIGINT), 'domain', s, bs FROM j WHERE bs IS NOT NULL UNION ALL SELECT chrom, CAST(dom_id AS BIGINT), 'domain', be, e FROM j WHERE bs IS NOT NULL UNION ALL SELECT chrom, CAST(dom_id AS BIGINT), 'boundary', bs, be FROM j WHERE bs IS NOT NULL""")
def split_domains(spark, sf_dir):
    runs = islands.run_lengths(_tagged(spark, sf_dir), ["chrom"], "hour", "tag").where("tag = 'domain' and last > first")
    domains = runs.select("chrom", F.col("run").cast("bigint").alias("dom_id"), (F.col("first") * 3600).alias("start"), ((F.col("last") + 1) * 3600).alias("end"))
    marks = runs.where("run % 2 = 0").select("chrom", (F.col("first") * 3600 + 1800).alias("b_start"), (F.col("first") * 3600 + 2000).alias("b_end"))
    return segments.split_domains(domains, marks, 14_400)


@query()
def change_points(spark, sf_dir):
    """Extremes of each chromosome's hourly track."""

    def run(part):
        import pandas as pd

        part = part.sort_values("hour")
        return pd.DataFrame({"chrom": part.chrom, "hour": part.hour, "extreme": kernels.change_points(part.n.to_numpy(float))})

    return views.hours(spark, sf_dir).groupBy("chrom").applyInPandas(run, "chrom string, hour bigint, extreme int")


@query()
def precise_positions(spark, sf_dir):
    """Positions called on the hourly track of each chromosome."""
    h = views.hours(spark, sf_dir).select("chrom", F.col("hour").alias("slot"), F.col("n").cast("double").alias("raw"))
    return positions.precise(h)
