"""Queries on contact maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import matrix
from tessera.operators.balancing import balance_map
from tessera.plans.registry import Registry
from tessera.sources import views

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _six(spark: SparkSession, sf_dir: str, ahead: int = 1) -> DataFrame:
    return views.contact_map(spark, sf_dir, ahead, wide=True)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("SELECT chrom, bin_id, CAST(marginal AS BIGINT) AS marginal FROM marg6")
def marginals_symmetric(spark, sf_dir):
    return matrix.marginals(_six(spark, sf_dir))


@query("SELECT chrom, i AS bin1_id, j AS bin2_id, cnt FROM full6")
def mirror_symmetric(spark, sf_dir):
    return matrix.mirror(_six(spark, sf_dir))


@query("SELECT * FROM map6_a WHERE bin2_id - bin1_id >= 2")
def upper_triangle(spark, sf_dir):
    return matrix.triangle(_six(spark, sf_dir), 2)


@query("SELECT chrom, bin1_id, bin2_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM maps6 GROUP BY ALL")
def add_maps(spark, sf_dir):
    return matrix.add(_six(spark, sf_dir), _six(spark, sf_dir, 2))


@query("SELECT chrom, round(1 - count(*) / 14400.0, 6) AS sparsity FROM full6 GROUP BY chrom")
def matrix_sparsity(spark, sf_dir):
    return _rounded(matrix.sparsity(_six(spark, sf_dir), 120), "sparsity")


@query("SELECT p.chrom, bin1_id, bin2_id, round(cnt / (a.marginal * b.marginal), 9) AS cnt FROM map6_a p JOIN marg6 a ON a.chrom = p.chrom AND a.bin_id = bin1_id JOIN marg6 b ON b.chrom = p.chrom AND b.bin_id = bin2_id")
def bias_multiply(spark, sf_dir):
    m = _six(spark, sf_dir)
    bias = matrix.marginals(m).select("chrom", "bin_id", (1 / F.col("marginal")).alias("bias"))
    return matrix.bias_multiply(m, bias, "bias").withColumn("cnt", F.round("cnt", 9))


@query("SELECT p.chrom, bin1_id, bin2_id, round(cnt * (bin1_id + 1) * (bin2_id + 1) / 1e4, 6) AS cnt FROM map6_a p WHERE chrom = 'click'")
def balanced_fetch(spark, sf_dir):
    m = _six(spark, sf_dir).where("chrom = 'click'")
    weights = views.bins(spark, True).select(F.lit("click").alias("chrom"), "bin_id", ((F.col("bin_id") + 1) / 100).alias("weight"))
    return _rounded(matrix.bias_multiply(m, weights, "weight"), "cnt")


@query("SELECT chrom, bin_id, round(1 / sqrt(marginal), 9) AS bias FROM marg6")
def sinkhorn_step(spark, sf_dir):
    return matrix.sinkhorn_step(_six(spark, sf_dir)).withColumn("bias", F.round("bias", 9))


_BLOCK_SUM = "SELECT chrom, least(bin1_id // 7, bin2_id // 7) AS block1, greatest(bin1_id // 7, bin2_id // 7) AS block2, CAST(sum(cnt) AS BIGINT) AS total FROM map6_a GROUP BY ALL"


def _blocks(spark: SparkSession, m: DataFrame) -> DataFrame:
    return m.select("chrom").distinct().crossJoin(views.bins(spark, True)).select("chrom", "bin_id", F.floor(F.col("bin_id") / 7).alias("block"))  # chromosomes x fixed bins


@query(_BLOCK_SUM)
def block_sum(spark, sf_dir):
    m = _six(spark, sf_dir)
    return matrix.block_sum(m, _blocks(spark, m))


@query(f""", s AS ({_BLOCK_SUM}), z AS (SELECT bin_id // 7 AS block, count(*) AS size FROM bins6 GROUP BY ALL), m AS (SELECT chrom, block1, block2, round(total / (x.size * y.size), 6) AS mean FROM s JOIN z x ON x.block = block1 JOIN z y ON y.block = block2)
SELECT * FROM m UNION ALL SELECT chrom, block2, block1, mean FROM m WHERE block1 <> block2""")
def block_mean_scaled(spark, sf_dir):
    m = _six(spark, sf_dir)
    blocks = _blocks(spark, m)
    return _rounded(matrix.block_mean(matrix.block_sum(m, blocks), blocks.groupBy("chrom", "block").agg(F.count("*").alias("size"))), "mean")


@query("SELECT chrom, bin1_id // 4 AS bin1_id, bin2_id // 4 AS bin2_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM map6_a GROUP BY ALL")
def coarsen_k(spark, sf_dir):
    return matrix.coarsen(_six(spark, sf_dir), 4)


@query("SELECT bin_id // 5 AS bin_id, min(bs) AS \"start\", max(be) AS \"end\" FROM bins GROUP BY ALL")
def coarsen_bins(spark, sf_dir):
    rows = views.bins(spark).select(F.lit("x").alias("chrom"), "bin_id", F.col("bs").alias("start"), F.col("be").alias("end"))
    return matrix.coarsen_bins(rows, 5).drop("chrom")


@query("SELECT * FROM map_a UNION ALL SELECT * FROM map_b b WHERE NOT EXISTS (SELECT 1 FROM map_a a WHERE a.chrom = b.chrom AND a.bin1_id = b.bin1_id AND a.bin2_id = b.bin2_id)")
def union_priority(spark, sf_dir):
    return matrix.union_priority(views.contact_map(spark, sf_dir, 1), views.contact_map(spark, sf_dir, 2))


@query(", held AS (SELECT DISTINCT bin_id FROM bins JOIN sites ON s < be AND e > bs) SELECT * FROM map_a WHERE bin1_id IN (SELECT bin_id FROM held) OR bin2_id IN (SELECT bin_id FROM held)")
def drop_unsupported_pixels(spark, sf_dir):
    from tessera.plans.interval_queries import overlap_count_left

    return matrix.drop_unsupported(views.contact_map(spark, sf_dir), overlap_count_left(spark, sf_dir), "n")


_DIAG = """, dg AS (SELECT chrom, bin2_id - bin1_id AS k, sum(cnt) AS s, sum(cnt * cnt) AS q, 120 - (bin2_id - bin1_id) AS n FROM map6_a WHERE bin2_id - bin1_id BETWEEN 1 AND 19 GROUP BY ALL),
st AS (SELECT chrom, k, n, s / n AS mean, sqrt(greatest((q - n * (s / n) * (s / n)) / (n - 1), 0)) AS sd FROM dg)"""


@query(_DIAG + " SELECT chrom, k, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM st")
def diag_stats(spark, sf_dir):
    return _rounded(matrix.diagonal_stats(_six(spark, sf_dir), 120, 10), "mean", "sd")


@query(_DIAG + " SELECT p.chrom, bin1_id, bin2_id, round((cnt - mean) / sd, 6) AS z FROM map6_a p JOIN st ON st.chrom = p.chrom AND k = bin2_id - bin1_id WHERE sd > 0")
def diag_zscore(spark, sf_dir):
    return _rounded(matrix.diagonal_zscore(_six(spark, sf_dir), 120, 10), "z")


@query("SELECT chrom, bin2_id - bin1_id AS k, round(avg(cnt), 6) AS mean FROM map6_a GROUP BY ALL")
def diag_nonzero_mean(spark, sf_dir):
    return _rounded(matrix.diagonal_mean(_six(spark, sf_dir)), "mean")


@query(""", i AS (SELECT chrom, cnt, bin1_id AS r, bin2_id AS c, unnest(range(greatest(bin1_id, bin2_id - 5), least(bin1_id + 4, bin2_id - 1) + 1)) AS i FROM map6_a WHERE bin2_id - bin1_id BETWEEN 1 AND 9)
SELECT chrom, i AS bin_id, round(sum(cnt) / (least(i + 1, 5) * least(119 - i, 5)), 6) AS score FROM i GROUP BY chrom, i""")
def insulation_score(spark, sf_dir):
    return _rounded(matrix.insulation(_six(spark, sf_dir), 120, 5), "score")


@query("""SELECT chrom, bin1_id, bin2_id, cnt, abs((b.bs + b.be) / 2 - (a.bs + a.be) / 2) AS distance FROM map6_a JOIN bins6 a ON a.bin_id = bin1_id JOIN bins6 b ON b.bin_id = bin2_id WHERE abs((b.bs + b.be) / 2 - (a.bs + a.be) / 2) BETWEEN 20000 AND 400000""")
def distance_band(spark, sf_dir):
    b = views.bins(spark, True).toDF("bin_id", "start", "end")
    return matrix.distance_band(_six(spark, sf_dir), b, 20_000, 400_000)


@query("SELECT b.chrom, b.bin1_id, b.bin2_id, coalesce(a.cnt, 0) AS cnt FROM map6_b b LEFT JOIN map6_a a USING (chrom, bin1_id, bin2_id)")
def point_lookup(spark, sf_dir):
    return matrix.point_lookup(_six(spark, sf_dir, 2).drop("cnt"), _six(spark, sf_dir))


@query(", q AS (SELECT chrom, quantile_cont(cnt, 0.9) AS cut FROM map6_a GROUP BY chrom) SELECT map6_a.* FROM map6_a JOIN q USING (chrom) WHERE cnt >= cut")
def quantile_filter(spark, sf_dir):
    return matrix.quantile_filter(_six(spark, sf_dir), ["chrom"], "cnt", 0.9)


@query(""", t AS (SELECT range AS block, CASE WHEN range = 0 THEN 0 ELSE 20 * range - 4 END AS lo, 20 * (range + 1) AS hi FROM range(12)), h AS (SELECT chrom, bin1_id, bin2_id, cnt, block FROM map6_a JOIN t ON bin1_id >= lo AND bin2_id <= hi)
SELECT *, block = min(block) OVER (PARTITION BY chrom, bin1_id, bin2_id) AS own FROM h""")
def block_tiling(spark, sf_dir):
    return matrix.blocks_of(_six(spark, sf_dir), 4)


@query("""SELECT chrom, y.m - x.m AS step, CAST(sum(CASE WHEN y.m = x.m THEN x.n * (x.n + 1) // 2 ELSE x.n * y.n END) AS BIGINT) AS pairs FROM (SELECT (bs + be) // 2 // 7200 AS m, count(*) AS n FROM bins GROUP BY ALL) x JOIN (SELECT (bs + be) // 2 // 7200 AS m, count(*) AS n FROM bins GROUP BY ALL) y ON y.m - x.m BETWEEN 0 AND 29 CROSS JOIN (SELECT 'x' AS chrom) GROUP BY ALL""")
def expected_pairs(spark, sf_dir):
    rows = views.bins(spark).select(F.lit("x").alias("chrom"), F.col("bs").alias("start"), F.col("be").alias("end"))
    return matrix.expected_pairs(rows, 7200, 30).withColumn("step", F.col("step").cast("bigint"))


@query()
def kr_balance(spark, sf_dir):
    """Bias of every bin, and its balanced marginal: 1 up to the tolerance."""
    m = _six(spark, sf_dir)
    bias = balance_map(m)
    balanced = matrix.marginals(matrix.bias_multiply(m, bias, "bias"))
    return bias.join(balanced, ["chrom", "bin_id"]).select("chrom", "bin_id", F.round("bias", 6).alias("bias"), F.round("marginal", 4).alias("marginal"))


@query("SELECT chrom, bin_id, 1.0 AS marginal FROM marg6")
def balanced_marginals(spark, sf_dir):
    """Row sums of the balanced map, with one contact more on the diagonal, so that there is a balance: 1 for every bin."""
    m = _six(spark, sf_dir)
    ends = m.select("chrom", F.explode(F.array("bin1_id", "bin2_id")).alias("bin1_id")).distinct()
    m = matrix.add(m, ends.select("chrom", "bin1_id", F.col("bin1_id").alias("bin2_id"), F.lit(1).cast("bigint").alias("cnt")))
    return _rounded(matrix.marginals(matrix.bias_multiply(m, balance_map(m), "bias")), "marginal")


@query()
def lowess_norm(spark, sf_dir):
    a, b = (matrix.marginals(_six(spark, sf_dir, k)).withColumnRenamed("marginal", n) for k, n in ((1, "a"), (2, "b")))
    rows = a.join(b, ["chrom", "bin_id"], "full").fillna(0).withColumn("sites", F.col("bin_id") % 3 + 1)
    return _rounded(kernels.normalise_marginals(rows), "norm_a", "norm_b")


@query()
def mann_whitney_domains(spark, sf_dir):
    """Extremes of the diamond means of each chromosome and the rank test's p of its bins."""
    m = _six(spark, sf_dir)
    near = F.col("bin2_id") - F.col("bin1_id")
    z = matrix.diagonal_zscore(m, 120, 10).unionByName(m.where(near == 0).select(*matrix.PIXEL, F.col("cnt").cast("double").alias("z")))
    regions = m.groupBy("chrom").agg(F.min("bin1_id").alias("first"), F.max("bin2_id").alias("last"))
    return _rounded(kernels.boundaries_in_regions(regions, matrix.insulation(m, 120, 10), z, matrix.empty_scores(m, 120, 10), 10), "p")


@query(_DIAG + """, g AS (SELECT DISTINCT p.chrom, i.range AS bin1_id, i.range + d.range + 1 AS bin2_id, d.range + 1 AS k FROM (SELECT DISTINCT chrom FROM map6_a) p CROSS JOIN range(120) i CROSS JOIN range(19) d WHERE i.range + d.range + 1 < 120)
SELECT g.chrom, g.bin1_id, g.bin2_id, round((coalesce(cnt, 0) - mean) / sd, 6) AS z FROM g JOIN st ON st.chrom = g.chrom AND st.k = g.k LEFT JOIN map6_a m ON m.chrom = g.chrom AND m.bin1_id = g.bin1_id AND m.bin2_id = g.bin2_id WHERE sd > 0""")
def diag_zscore_band(spark, sf_dir):
    """z of all cells of the band, those without a pixel too."""
    m = _six(spark, sf_dir)
    fill = matrix.empty_scores(m, 120, 10).select("chrom", F.posexplode("fill").alias("k", "z")).where("k > 0 and z <> 0")
    spots = fill.withColumn("bin1_id", F.explode(F.sequence(F.lit(0).cast("bigint"), 119 - F.col("k").cast("bigint")))).select("chrom", "bin1_id", (F.col("bin1_id") + F.col("k")).alias("bin2_id"), F.col("z").alias("_f"))
    return _rounded(spots.join(matrix.diagonal_zscore(m, 120, 10), matrix.PIXEL, "left").select(*matrix.PIXEL, F.coalesce("z", "_f").alias("z")), "z")


@query()
def dog_blobs(spark, sf_dir):
    m = _six(spark, sf_dir)
    bins = m.select("chrom").distinct().crossJoin(views.bins(spark, True)).toDF("chrom", "bin_id", "start", "end")  # chromosomes x fixed bins
    return _rounded(kernels.blobs_in_tiles(matrix.tiles_of(m, bins, 432_000), least=500, dense=0.05, dense_wide=0.05, q_most=0.9), "fdr", "scale")
