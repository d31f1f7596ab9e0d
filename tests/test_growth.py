"""What the work of a step grows with."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import kernels, stats
from tessera.operators import intervals, segments
from tessera.plans import pipelines


def pairs_made(monkeypatch, make):
    """The rows of make() and how many pairs its overlap joins gave."""
    join, made = intervals.overlap_join, []

    def counted(*a, **k):
        out = join(*a, **k)
        made.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(intervals, "overlap_join", counted)
        m.setattr(segments, "overlap_join", counted)
        return make().collect(), sum(made)


def close_genes(spark, n):
    """Genes 1,000 apart: each place at one has its promoter, and the wide regions of all others around it."""
    return spark.range(n).select(F.lit("c").alias("chrom"), (300_000 + F.col("id") * 1000).alias("start"), (300_000 + F.col("id") * 1000 + 500).alias("end"), F.lit("+").alias("strand"), F.concat(F.lit("g"), F.col("id")).alias("gene"))


def test_loops_meet_what_they_report(spark, monkeypatch):
    s = 300_000 + F.col("id") * 1000
    ends = [x for i in (0, 1) for x in (F.lit("c").alias(f"chrom{i + 1}"), (s + i * 20_000).alias(f"start{i + 1}"), (s + i * 20_000 + 300).alias(f"end{i + 1}"))]
    found = spark.range(250).select(F.col("id").alias("k"), *ends)
    rows, made = pairs_made(monkeypatch, lambda: pipelines.transfer_loops(found, close_genes(spark, 300)))
    assert len(rows) == 250 and {r.annot1 for r in rows} == {r.annot2 for r in rows} == {"Promoter"}
    places = {(r[f"start{i}"], r[f"detail{i}"]) for r in rows for i in (1, 2)}
    assert made == sum(len(genes.split(",")) for _, genes in places)


def test_annotation_meets_what_it_reports(spark, monkeypatch):
    rows = spark.range(300).select("id", F.lit("c").alias("chrom"), (300_000 + F.col("id") * 1000).alias("s"), (300_300 + F.col("id") * 1000).alias("e"))
    far = spark.createDataFrame([(-1, "c", 700_000, 700_300), (-2, "c", 5_000_000, 5_000_300), (-3, "d", 300_000, 300_300), (-4, "c", 300_000, 300_000)], rows.schema)
    genes = close_genes(spark, 300)
    got, made = pairs_made(monkeypatch, lambda: intervals.annotate(rows.unionByName(far), intervals.gene_regions(genes), ["chrom"], ["id"], "s", "e", 50_000))
    by_id = {r.id: r for r in got}
    assert len(got) == len(by_id) == 304
    assert all(by_id[i].region == "Promoter" and f"g{i}" in by_id[i].genes.split(",") for i in range(300))
    assert by_id[-1].region == "Distal" and [(by_id[i].region, by_id[i].genes) for i in (-2, -3, -4)] == [("Desert", "")] * 3
    assert made == sum(len(r.genes.split(",")) for r in got if r.genes)


def test_annotation_neither_shuffles_nor_writes_lists(spark, monkeypatch):
    """Genes that lie on each other: each place lists them all, so the lists grow with the square of the input, and nothing else may."""
    kept, keep = [], intervals.keep
    monkeypatch.setattr(intervals, "keep", lambda df, name: kept.append(df.columns) or keep(df, name))
    rows = spark.range(100).select("id", F.lit("c").alias("chrom"), (300_000 + F.col("id")).alias("s"), (300_300 + F.col("id")).alias("e"))
    genes = spark.range(100).select(F.lit("c").alias("chrom"), F.lit(300_000).alias("start"), F.lit(300_500).alias("end"), F.lit("+").alias("strand"), F.concat(F.lit("g"), F.col("id")).alias("gene"))
    out = intervals.annotate(rows, intervals.gene_regions(genes), ["chrom"], ["id"], "s", "e", 50_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {(r.region, r.genes) for r in out.collect()} == {("Promoter", ",".join(sorted(f"g{i}" for i in range(100))))}
    assert kept and not any("genes" in columns for columns in kept)
    assert plan.index("array_join") < plan.index("Exchange")  # nothing is moved behind it


def test_annotation_by_brute_force(spark):
    """Rows of all lengths, also far longer than a bucket, empty ones, nulls, and genes without a name."""
    r = np.random.default_rng(3)
    places = [("c" if i % 3 else "d", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(r.integers(-2000, 60_000, 150), r.choice([0, 1, 30, 300, 5000, 40_000], 150), strict=True))]
    places += [(None, 0, 9000, 150), ("c", None, 9000, 151), ("c", 0, None, 152), ("c", 900, 100, 153)]
    known = [("c" if i % 2 else "d", kind, None if i % 17 == 0 else f"g{i % 40}", int(s), int(s + w)) for i, (kind, s, w) in enumerate(zip(r.choice([*intervals.PRIORITY, "other"], 60), r.integers(0, 60_000, 60), r.choice([50, 700, 4000], 60), strict=True))]
    rows = spark.createDataFrame(places, "chrom string, s long, e long, id long")
    got = intervals.annotate(rows, spark.createDataFrame(known, "chrom string, region string, gene string, start long, end long"), ["chrom"], ["id"], "s", "e", 1000).collect()
    want = set()
    for chrom, s, e, k in places:
        met = [x for x in known if chrom == x[0] and None not in (s, e) and s < e and s < x[4] and e > x[3] and x[1] in intervals.PRIORITY]
        best = max((x[1] for x in met), key=intervals.PRIORITY.get, default="Desert")
        want.add((k, best, ",".join(sorted({x[2] for x in met if x[1] == best and x[2]}))))
    assert len(got) == len(places) and {(x.id, x.region, x.genes) for x in got} == want


def test_signals_of_boundaries_make_no_pairs(spark, monkeypatch):
    sites = spark.range(400).select("id", F.lit("c").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 500).alias("end"))
    track = spark.range(400).select(F.lit("c").alias("chrom"), (F.col("id") + 200).alias("t_start"), (F.col("id") + 600).alias("t_end"), (F.col("id") * 7 % 400).cast("double").alias("value"))
    rows, made = pairs_made(monkeypatch, lambda: segments.max_signal(sites, track, ["id"], 10, 300))
    want = {i: max(float(k * 7 % 400) for k in range(400) if k + 200 < i + 510 and k + 600 > i - 10) for i in range(400)}
    assert {r.id: r.signal for r in rows} == want
    assert made < 4000
    there, made = pairs_made(monkeypatch, lambda: intervals.overlap_exists(sites, track, ["chrom"], ["id"], "start", "end", "t_start", "t_end", 300))
    assert len(there) == 400 and made < 4000


def test_largest_over_by_brute_force():
    r = np.random.default_rng(1)
    for _ in range(500):
        n, m, w = (int(x) for x in r.integers([0, 0, 2], [12, 12, 40]))
        s, b, v = r.integers(0, w, n), r.integers(0, w, m), r.normal(size=m)
        e, q = s + r.integers(1, 15, n), b + r.integers(1, 25, m)
        most, hit = kernels.largest_over(s, e, b, q, v)
        for i in range(n):
            over = v[(b < e[i]) & (q > s[i])]
            assert hit[i] == (len(over) > 0) and (not len(over) or most[i] == over.max())


def test_quantiles_are_exact_and_bring_few_values_together(spark):
    k = F.col("id")
    x = F.when(k % 101 == 0, None).when(k % 503 == 0, float("nan")).when(k % 3 == 0, 0.5).otherwise(F.pow(k * 7919 % 30011, 2) / 7)
    rows = spark.range(60_000).select(F.when(k % 5 > 0, k % 5).alias("p"), x.alias("x"), F.when(k % 5 != 1, -k).alias("y"))
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    wanted = {f"{c}{i}": (F.col(c), q) for c in "xy" for i, q in enumerate(shares)}
    for part in ([], ["p"]):
        got = {tuple(r[c] for c in part): r for r in stats.quantiles(rows, part, wanted).collect()}
        want = rows.groupBy(*part).agg(*[F.percentile(v, F.lit(q)).alias(n) for n, (v, q) in wanted.items()]).collect()
        assert len(got) == len(want)
        for r in want:
            for n in wanted:
                a, b = got[tuple(r[c] for c in part)][n], r[n]
                assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-12, equal_nan=True)), (part, r, n, a, b)
    plan = stats.fences(rows, ["p"], {"f": F.col("x")})._jdf.queryExecution().toString()
    assert not re.search(r"\bpercentile\(", plan)


def test_digestion_grows_with_the_cuts(spark):
    """A fragment's row used to hold all cuts of its text: 60,000 x 60,000 numbers here."""
    rows = spark.range(1).select("id", F.expr("repeat('tion', 60000)").alias("t")).unionByName(spark.createDataFrame([(1, None), (2, ""), (3, "é tion 𝄞tion")], "id bigint, t string"))
    began = time.time()
    got = intervals.digest(rows, "t", ["id"], "t^ion").groupBy("id").agg(F.count("*").alias("n"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("sum")).collect()
    assert time.time() - began < 30
    assert {r.id: (r.n, r.end, r.sum) for r in got} == {0: (60_001, 240_000, 240_000), 3: (3, 12, 12)}
