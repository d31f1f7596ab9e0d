"""Queries on statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels, stats
from tessera.operators import loops, matrix, signal
from tessera.plans.registry import Registry
from tessera.sources import views

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 6) AS fence FROM lineitem GROUP BY ALL", plain=True)
def iqr_fence(spark, sf_dir):
    found = stats.fences(views.table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"fence": F.col("l_extendedprice")})
    return found.withColumn("fence", F.round("fence", 6))


_PER_PART = "SELECT l_partkey, count(*) AS w, avg(l_quantity) AS h, sum(l_extendedprice) / 1000 AS a, 100 * avg(l_discount) + 1 AS pp, 100 * avg(l_tax) + 1 AS pv FROM lineitem GROUP BY l_partkey"


def _fence(x: str) -> str:
    return f"(quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)))"


@query(f"""WITH t AS ({_PER_PART}), f0 AS (SELECT {_fence('pv')} AS fv0, avg(pv) AS mv FROM t), c AS (SELECT t.*, CASE WHEN pv > fv0 THEN mv ELSE pv END AS v FROM t, f0),
f AS (SELECT {_fence('w')} AS fw, {_fence('h')} AS fh, {_fence('a')} AS fa, {_fence('pp')} AS fp, {_fence('v')} AS fv FROM c), s AS (SELECT l_partkey, (h / fh + log2(pp / fp * v / fv + 1) + a / fa) / (3 * w / fw) AS s FROM c, f)
SELECT l_partkey, round(20 * s / (SELECT {_fence('s')} FROM s), 6) AS position_score FROM s""", plain=True)
def positioning_score(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("w"), F.avg("l_quantity").alias("h"), (F.sum("l_extendedprice") / 1000).alias("a"), (100 * F.avg("l_discount") + 1).alias("pp"), (100 * F.avg("l_tax") + 1).alias("pv"))
    return _rounded(stats.positioning(rows, "w", "h", "a", "pp", "pv").select("l_partkey", "position_score"), "position_score")


@query(""", m AS (SELECT chrom, median(value) AS md FROM ev WHERE value <> 0 GROUP BY chrom), d AS (SELECT chrom, median(abs(value - md)) AS mad FROM ev JOIN m USING (chrom) WHERE value <> 0 GROUP BY chrom)
SELECT event_id, CASE WHEN value <> 0 AND mad > 0 THEN 0.6745 * abs(value - md) / mad > 3 ELSE false END AS outlier FROM ev LEFT JOIN m USING (chrom) LEFT JOIN d USING (chrom)""")
def mad_outliers(spark, sf_dir):
    return stats.outliers(views.events(spark, sf_dir).select("event_id", "chrom", "value"), ["chrom"], "value", 3.0).select("event_id", "outlier")


@query(""", m AS (SELECT chrom, median(value) AS md FROM ev GROUP BY chrom), d AS (SELECT chrom, median(abs(value - md)) AS mad FROM ev JOIN m USING (chrom) GROUP BY chrom)
SELECT event_id, abs(value - md) <= 2 * mad AS inside FROM ev JOIN m USING (chrom) JOIN d USING (chrom)""")
def nmad_band(spark, sf_dir):
    return stats.mad_band(views.events(spark, sf_dir).select("event_id", "chrom", "value"), ["chrom"], "value", 2.0).select("event_id", "inside")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY ALL", plain=True)
def group_regression(spark, sf_dir):
    r = stats.regression(views.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(""", p AS (SELECT event_id, chrom, (event_id * 7919 % 10007 + 1) / 10008.0 AS p FROM ev), r AS (SELECT *, p * count(*) OVER (PARTITION BY chrom) / row_number() OVER (PARTITION BY chrom ORDER BY p, event_id) AS raw FROM p)
SELECT event_id, round(least(min(raw) OVER (PARTITION BY chrom ORDER BY p, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM r""")
def bh_fdr(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", "chrom", ((F.col("event_id") * 7919 % 10007 + 1) / 10008.0).alias("p"))
    return _rounded(stats.bh(rows, ["chrom"], "p", ["event_id"]).select("event_id", "q"), "q")


@query("SELECT event_id, rank() OVER w + (count(*) OVER (PARTITION BY chrom, floor(value)) - 1) / 2.0 AS avg_rank FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY floor(value))")
def average_rank(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", "chrom", F.floor("value").alias("v"))
    return stats.average_rank(rows, ["chrom"], "v").select("event_id", F.col("avg_rank").cast("double").alias("avg_rank"))


_MASS = """, d AS (SELECT chrom, bin1_id, bin2_id, cnt, bin2_id - bin1_id AS k FROM map6_a), e AS (SELECT *, sum(cnt) OVER (PARTITION BY chrom ORDER BY k, bin1_id ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER (PARTITION BY chrom) AS total FROM d),
f AS (SELECT *, CAST(least(floor(before * 20 / total), 19) AS BIGINT) AS mass_bin FROM e)"""


def _mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.contact_map(spark, sf_dir, wide=True).withColumn("k", F.col("bin2_id") - F.col("bin1_id"))
    return stats.equal_mass(m, ["chrom"], ["k", "bin1_id"], "cnt", 20)


@query(_MASS + " SELECT chrom, bin1_id, bin2_id, mass_bin FROM f")
def equal_mass_bins(spark, sf_dir):
    return _mass(spark, sf_dir).select("chrom", "bin1_id", "bin2_id", F.col("mass_bin").cast("bigint").alias("mass_bin"))


@query(_MASS + " SELECT chrom, mass_bin, CAST(sum(cnt) AS BIGINT) AS contacts, max(k) AS far, round(avg(cnt), 6) AS avg_cc, round(avg(k), 6) AS avg_dist, round(count(*) / sum(cnt), 6) AS bias FROM f GROUP BY ALL")
def distance_decay(spark, sf_dir):
    g = _mass(spark, sf_dir).groupBy("chrom", F.col("mass_bin").cast("bigint").alias("mass_bin"))
    return _rounded(g.agg(F.sum("cnt").alias("contacts"), F.max("k").alias("far"), F.avg("cnt").alias("avg_cc"), F.avg("k").alias("avg_dist"), (F.count("*") / F.sum("cnt")).alias("bias")), "avg_cc", "avg_dist", "bias")


@query("SELECT a.chrom, a.bin1_id, a.bin2_id, round(log2((a.cnt + 1) / (b.cnt + 1)), 6) AS m FROM map6_a a JOIN map6_b b USING (chrom, bin1_id, bin2_id)")
def md_statistic(spark, sf_dir):
    a, b = (views.contact_map(spark, sf_dir, k, wide=True).withColumnRenamed("cnt", n) for k, n in ((1, "a"), (2, "b")))
    return a.join(b, matrix.PIXEL).select(*matrix.PIXEL, F.round(stats.md(F.col("a"), F.col("b")), 6).alias("m"))


@query(""", h AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN hour END) OVER (PARTITION BY chrom ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, min(CASE WHEN value IS NOT NULL THEN hour END) OVER (PARTITION BY chrom ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM hours)
SELECT h.chrom, h.hour, round(CASE WHEN b IS NULL THEN y.value WHEN a IS NULL THEN x.value WHEN a = b THEN h.value ELSE x.value + (y.value - x.value) * (h.hour - b) / (a - b) END, 6) AS filled FROM h LEFT JOIN hours x ON x.chrom = h.chrom AND x.hour = b LEFT JOIN hours y ON y.chrom = h.chrom AND y.hour = a""")
def interp_by_row(spark, sf_dir):
    return _rounded(stats.interpolate(views.hours(spark, sf_dir), ["chrom"], "hour", "value").select("chrom", "hour", "filled"), "filled")


@query(""", s AS (SELECT count(*) AS total, count(*) FILTER (WHERE chrom1 = chrom_a) AS cis, count(*) FILTER (WHERE chrom1 <> chrom_a) AS trans, count(*) FILTER (WHERE chrom1 = chrom_a AND abs(p_a - p1) >= 1000) AS cis_1kb, count(*) FILTER (WHERE chrom_a IS NULL) AS unpaired FROM nxt)
SELECT metric, n, round(100.0 * n / total, 2) AS percent FROM (SELECT total, unnest(['cis', 'trans', 'cis_1kb', 'unpaired']) AS metric, unnest([cis, trans, cis_1kb, unpaired]) AS n FROM s)""")
def qc_report(spark, sf_dir):
    p = views.pairs(views.events(spark, sf_dir), 1)
    same = F.col("chrom1") == F.col("chrom2")
    n = lambda c: F.count(F.when(c, 1))
    return stats.qc_report(p.agg(F.count("*").alias("total"), n(same).alias("cis"), n(~same).alias("trans"), n(same & (F.abs(F.col("p2") - F.col("p1")) >= 1000)).alias("cis_1kb"), n(F.col("chrom2").isNull()).alias("unpaired")))


@query(""", k AS (SELECT chrom, value AS intensity, value / 9973 AS fdr, (event_id % 17) / 10.0 AS scale FROM ev WHERE event_id % 3 = 0 AND chrom <> 'view'), l AS (SELECT chrom, min(value) AS least FROM ev WHERE event_id % 3 = 1 GROUP BY chrom), f AS (SELECT chrom, regr_slope(fdr, x) AS a, regr_intercept(fdr, x) AS b, regr_slope(scale, x) AS c, regr_intercept(scale, x) AS d, avg(CASE WHEN x IS NOT NULL THEN fdr END) AS mf, avg(CASE WHEN x IS NOT NULL THEN scale END) AS ms, TRUE AS known
  FROM (SELECT k.*, CASE WHEN intensity >= least THEN intensity END AS x FROM k JOIN l USING (chrom)) GROUP BY chrom)
SELECT event_id, round(greatest(coalesce(a * value + b, mf, CASE WHEN known THEN 0.01 ELSE 0.00001 END), 0), 5) AS fdr, round(coalesce(c * value + d, ms, 0.6155), 5) AS scale FROM ev LEFT JOIN f USING (chrom) WHERE event_id % 3 = 1""")
def regression_fdr(spark, sf_dir):
    e = views.events(spark, sf_dir).withColumnRenamed("value", "intensity")
    known = e.where("event_id % 3 = 0 and chrom <> 'view'").select("chrom", "intensity", (F.col("intensity") / 9973).alias("fdr"), ((F.col("event_id") % 17) / 10.0).alias("scale"))
    return loops.regress_fdr(e.where("event_id % 3 = 1"), known).select("event_id", "fdr", "scale")


@query("""SELECT event_id, CASE WHEN v > 0 AND v < 1 THEN pow(10, ceil(-log10(v))) ELSE 1.0 END AS factor FROM (SELECT event_id, value / 1000 AS v FROM ev)""")
def intensity_scale(spark, sf_dir):
    return views.events(spark, sf_dir).select("event_id", stats.zeros_after_point(F.col("value") / 1000).alias("factor"))


@query(""", u AS (SELECT chrom, hour % 24 AS sidx, hour // 24 AS eidx, n / 10.0 AS fdr, hour FROM hours) SELECT chrom, sidx, eidx // 5 AS eidx, round(min(fdr), 6) AS fdr FROM u GROUP BY ALL""")
def unique_loops(spark, sf_dir):
    u = views.hours(spark, sf_dir).select("chrom", (F.col("hour") % 24).alias("sidx"), F.floor(F.col("hour") / 120).alias("eidx"), (F.col("n") / 10.0).alias("fdr"), "hour")
    return loops.unique_loops(u).select("chrom", "sidx", "eidx", F.round("fdr", 6).alias("fdr"))


def _tail(low: str, high: str) -> str:
    return f"round(-log10(list_sum([exp(k * ln(m) - m - lgamma(k + 1)) FOR k IN range({low}, {high})])) + 0.0, 8)"


@query(f", h AS (SELECT chrom, hour, n, avg(n) OVER (PARTITION BY chrom) AS m FROM hours) SELECT chrom, hour, CASE WHEN n = 0 THEN 0.0 ELSE {_tail('n', 'n + 400')} END AS upper, {_tail('0', 'n + 1')} AS lower FROM h")
def poisson_tail(spark, sf_dir):
    """-log10 of both tails of each hour's count under the chromosome's mean."""
    h = views.hours(spark, sf_dir)
    mean = h.groupBy("chrom").agg(F.avg("n").alias("mean"))
    return h.join(F.broadcast(mean), "chrom").select("chrom", "hour", signal.poisson_tail(F.col("n"), F.col("mean")).alias("upper"), signal.poisson_tail(F.col("n"), F.col("mean"), upper=False).alias("lower"))


@query()
def kde_cut(spark, sf_dir):
    """The elbow behind the mode of each chromosome's hourly counts, from their histogram's values."""

    def run(part):
        import pandas as pd

        return pd.DataFrame({"chrom": [part.chrom.iloc[0]], "cut": [round(kernels.kde_cut(part.n.to_numpy(float)), 6)]})

    return views.hours(spark, sf_dir).groupBy("chrom").applyInPandas(run, "chrom string, cut double")
