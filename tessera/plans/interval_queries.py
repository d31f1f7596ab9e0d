"""Queries on intervals, annotation and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import intervals, loops, segments, signal
from tessera.plans.registry import Registry
from tessera.sources import formats, views

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).select("event_id", "chrom", F.col("pos").alias("s"), (F.col("pos") + 900).alias("e"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(_reads(spark, sf_dir), views.bins(spark), [], "s", "e", "bs", "be", 3600, hint="broadcast")


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).where("chrom = 'error'").select((F.col("pos") - 1).alias("site_s"), (F.col("pos") + 1).alias("site_e"))


@query("SELECT * FROM map_a")
def contact_map(spark, sf_dir):
    return views.contact_map(spark, sf_dir)


@query("SELECT event_id, bin_id, least(pos + 900, be) - greatest(pos, bs) AS olp FROM ev JOIN bins ON pos < be AND pos + 900 > bs")
def overlap_len(spark, sf_dir):
    return _hits(spark, sf_dir).select("event_id", "bin_id", "olp")


@query("SELECT bin_id, count(s) AS n FROM bins LEFT JOIN sites ON s < be AND e > bs GROUP BY bin_id")
def overlap_count_left(spark, sf_dir):
    return intervals.overlap_count(views.bins(spark), _sites(spark, sf_dir), [], ["bin_id"], "bs", "be", "site_s", "site_e", 3600).select("bin_id", "n")


@query("SELECT event_id, chrom, pos AS s FROM ev WHERE EXISTS (SELECT 1 FROM sites WHERE s < pos + 900 AND e > pos)")
def overlap_semi(spark, sf_dir):
    return intervals.overlap_exists(_reads(spark, sf_dir), _sites(spark, sf_dir), [], ["event_id"], "s", "e", "site_s", "site_e", 900).select("event_id", "chrom", "s")


@query("SELECT event_id, chrom, pos AS s FROM ev WHERE NOT EXISTS (SELECT 1 FROM sites WHERE s < pos + 900 AND e > pos)")
def overlap_anti(spark, sf_dir):
    return intervals.overlap_exists(_reads(spark, sf_dir), _sites(spark, sf_dir), [], ["event_id"], "s", "e", "site_s", "site_e", 900, keep=False).select("event_id", "chrom", "s")


@query("SELECT pair_id, chrom, b1, b2, CAST(olp_sum AS BIGINT) AS olp_sum FROM best WHERE m = 'a'")
def best_match(spark, sf_dir):
    return intervals.best_match(views.contact_hits(spark, sf_dir), ["pair_id", "chrom"], [-F.col("olp_sum"), F.col("b1"), F.col("b2")], ["b1", "b2", "olp_sum"])


@query("SELECT pair_id, chrom, b1, b2, CAST(olp_sum AS BIGINT) AS olp_sum FROM cand WHERE m = 'a'")
def multi_match(spark, sf_dir):
    return views.contact_hits(spark, sf_dir).select("pair_id", "chrom", "b1", "b2", "olp_sum")


@query("SELECT pair_id, chrom FROM ends WHERE m = 'a' AND pair_id NOT IN (SELECT pair_id FROM cand WHERE m = 'a')")
def rescue_unmatched(spark, sf_dir):
    p = views.pairs(views.events(spark, sf_dir), 1).where("chrom1 = chrom2").select("pair_id", F.col("chrom1").alias("chrom"))
    return p.join(views.contact_hits(spark, sf_dir).select("pair_id"), "pair_id", "left_anti")


@query("SELECT count(DISTINCT pair_id) AS matched, (SELECT count(*) FROM ends WHERE m = 'a') AS pairs FROM cand WHERE m = 'a'")
def matched_pairs(spark, sf_dir):
    p = views.pairs(views.events(spark, sf_dir), 1).where("chrom1 = chrom2").agg(F.count("*").alias("pairs"))
    return views.contact_hits(spark, sf_dir).agg(F.countDistinct("pair_id").alias("matched")).join(F.broadcast(p))


@query("""SELECT event_id, bin_id, olp FROM (SELECT event_id, bin_id, least(pos + 900, be) - greatest(pos, bs) AS olp FROM ev JOIN bins ON pos < be AND pos + 900 > bs) h
WHERE olp >= 0.3 * (SELECT median(abs(o - m)) FROM (SELECT least(pos + 900, be) - greatest(pos, bs) AS o, (SELECT median(least(pos + 900, be) - greatest(pos, bs)) FROM ev JOIN bins ON pos < be AND pos + 900 > bs) AS m FROM ev JOIN bins ON pos < be AND pos + 900 > bs))""")
def overlap_cutoff_auto_mad(spark, sf_dir):
    h = _hits(spark, sf_dir).select("event_id", "bin_id", "olp")
    m = h.agg(F.median("olp").alias("m"))
    mad = h.join(F.broadcast(m)).agg(F.median(F.abs(F.col("olp") - F.col("m"))).alias("mad"))
    return h.join(F.broadcast(mad)).where("olp >= 0.3 * mad").select("event_id", "bin_id", "olp")


@query("""SELECT o_orderkey, strand, CASE WHEN strand = '-' AND l < f THEN l ELSE f END AS f, CASE WHEN strand = '-' AND l < f THEN f ELSE l END AS l
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS strand, CAST(o_orderkey % 1000 AS BIGINT) AS f, CAST(o_custkey % 1000 AS BIGINT) AS l FROM orders) WHERE NOT (strand = '+' AND l < f)""", plain=True)
def orient_pairs(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "+").otherwise("-").alias("strand"), (F.col("o_orderkey") % 1000).alias("f"), (F.col("o_custkey") % 1000).alias("l"))
    return intervals.orient(rows, "strand", "f", "l")


@query("""SELECT event_id, least(CASE WHEN d > 0 THEN d ELSE lead(d) OVER (PARTITION BY chrom, user_id ORDER BY pos, event_id) END, 10000) AS spacing
FROM (SELECT event_id, chrom, user_id, pos, pos - lag(pos) OVER (PARTITION BY chrom, user_id ORDER BY pos, event_id) AS d FROM ev)""")
def spacing_capped(spark, sf_dir):
    return intervals.spacing(views.events(spark, sf_dir), ["chrom", "user_id"], ["pos", "event_id"], "pos").select("event_id", "spacing")


@query("""SELECT event_id, CASE WHEN s - pe < 400 THEN CAST(trunc((pe + s) / 2.0) AS BIGINT) + 5 ELSE s END AS s, CASE WHEN ns - e < 400 THEN CAST(trunc((e + ns) / 2.0) AS BIGINT) - 5 ELSE e END AS e
FROM (SELECT event_id, pos AS s, pos + 900 AS e, lag(pos + 900) OVER w AS pe, lead(pos) OVER w AS ns FROM ev WINDOW w AS (PARTITION BY chrom, user_id ORDER BY pos, event_id))""")
def deoverlap_neighbours(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", "chrom", "user_id", "pos", F.col("pos").alias("s"), (F.col("pos") + 900).alias("e"))
    return intervals.deoverlap(rows, ["chrom", "user_id"], ["pos", "event_id"], "s", "e", 400).select("event_id", "s", "e")


@query("""SELECT event_id, CASE WHEN w < 150 THEN s - 35 ELSE s END AS s, CASE WHEN w < 150 THEN s + w + 35 ELSE s + w END AS e FROM (SELECT event_id, pos AS s, CAST(event_id % 300 AS BIGINT) AS w FROM ev)""")
def extend_short_cores(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", F.col("pos").alias("s"), (F.col("pos") + F.col("event_id") % 300).alias("e"))
    return intervals.extend_short(rows, "s", "e")


@query("""SELECT chrom, gap_start, gap_end FROM (
SELECT chrom, coalesce(max(pos + 900) OVER (PARTITION BY chrom ORDER BY pos, pos + 900 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, pos AS gap_end FROM ev
UNION ALL SELECT chrom, max(pos + 900), 2700000 FROM ev GROUP BY chrom) WHERE gap_start < gap_end""")
def complement_intervals(spark, sf_dir):
    r = _reads(spark, sf_dir)
    length = r.select("chrom").distinct().withColumn("size", F.lit(2_700_000))
    return intervals.complement(r, ["chrom"], "s", "e", length, "size")


@query(""", g AS (SELECT c_custkey, CAST(c_custkey * 37 % 40000 AS BIGINT) AS n FROM customer),
m AS (SELECT c_custkey, n, CAST(CASE WHEN n < 300 THEN 1 WHEN n < 600 THEN 2 WHEN n < 30000 THEN (n + 299) // 300 ELSE 100 END AS BIGINT) AS k FROM g WHERE n > 0),
e AS (SELECT c_custkey, n, k, unnest(range(k)) AS piece FROM m),
b AS (SELECT c_custkey, n, k, piece, [CASE WHEN q = 0 THEN 0 WHEN n < 600 THEN (CASE WHEN q = k THEN n ELSE n // 2 END) WHEN n < 30000 THEN (CASE WHEN q = k THEN n WHEN q = k - 1 THEN CAST(trunc(300 * (k - 2) + (n - 300 * (k - 2)) / 2.0) AS BIGINT) ELSE 300 * q END) ELSE n * q // 100 END FOR q IN [piece, piece + 1]] AS x FROM e)
SELECT c_custkey, piece, x[1] AS piece_start, x[2] AS piece_end FROM b""")
def subdivide_intervals(spark, sf_dir):
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).cast("bigint").alias("s"), (F.col("c_custkey") * 37 % 40000).alias("e"))
    return intervals.subdivide(rows, "s", "e").select("c_custkey", "piece", "piece_start", "piece_end")


@query("SELECT event_id, row_number() OVER (ORDER BY chrom, pos, event_id) - 1 AS bin_id FROM ev")
def bin_numbering(spark, sf_dir):
    return intervals.number_bins(views.events(spark, sf_dir), "chrom", ["pos", "event_id"]).select("event_id", "bin_id")


_GENES_SQL = """, genes AS (SELECT 'g' || c_custkey AS gene, c_mktsegment AS chrom, CAST(c_custkey * 7919 % 200000000 AS BIGINT) AS s, CAST(c_custkey * 7919 % 200000000 + 500 + c_custkey % 5 * 1000 AS BIGINT) AS e, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM customer),
r0 AS (SELECT chrom, 'Promoter' AS region, gene, CASE WHEN strand = '+' THEN s - 1000 ELSE e - 1000 END AS a, CASE WHEN strand = '+' THEN s + 1000 ELSE e + 1000 END AS b FROM genes
UNION ALL SELECT chrom, 'TTS', gene, CASE WHEN strand = '+' THEN e - 1000 ELSE s - 1000 END, CASE WHEN strand = '+' THEN e + 1000 ELSE s + 1000 END FROM genes
UNION ALL SELECT chrom, 'Genebody', gene, s + 1000, e - 1000 FROM genes
UNION ALL SELECT chrom, 'Proximal', gene, CASE WHEN strand = '+' THEN s - 10000 ELSE e + 1000 END, CASE WHEN strand = '+' THEN s - 1000 ELSE e + 10000 END FROM genes
UNION ALL SELECT chrom, 'Proximal', gene || '_bi', CASE WHEN strand = '+' THEN s + 1000 ELSE e - 10000 END, CASE WHEN strand = '+' THEN s + 10000 ELSE e - 1000 END FROM genes
UNION ALL SELECT chrom, 'Distal', gene, CASE WHEN strand = '+' THEN s - 250000 ELSE e + 10000 END, CASE WHEN strand = '+' THEN s - 10000 ELSE e + 250000 END FROM genes
UNION ALL SELECT chrom, 'Distal', gene || '_bi', CASE WHEN strand = '+' THEN s + 10000 ELSE e - 250000 END, CASE WHEN strand = '+' THEN s + 250000 ELSE e - 10000 END FROM genes),
regions AS (SELECT chrom, region, gene, CASE WHEN a < 0 THEN 1 ELSE a END AS s, CASE WHEN b < 0 THEN 1 ELSE b END AS e FROM r0 WHERE (CASE WHEN a < 0 THEN 1 ELSE a END) < (CASE WHEN b < 0 THEN 1 ELSE b END))"""


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as genes."""
    k = F.col("c_custkey")
    s = k * 7919 % 200_000_000
    return views.table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), k).alias("gene"), F.col("c_mktsegment").alias("chrom"), s.alias("start"), (s + 500 + k % 5 * 1000).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))


@query(_GENES_SQL + ' SELECT chrom, region, gene, s AS "start", e AS "end" FROM regions')
def gene_regions(spark, sf_dir):
    return intervals.gene_regions(_genes(spark, sf_dir))


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("chrom"), (F.col("c_custkey") * 104729 % 230_000_000).alias("s"), (F.col("c_custkey") * 104729 % 230_000_000 + 300).alias("e"))


@query(_GENES_SQL + """, loci AS (SELECT c_custkey, c_mktsegment AS chrom, CAST(c_custkey * 104729 % 230000000 AS BIGINT) AS ls FROM customer),
h AS (SELECT c_custkey, CASE region WHEN 'Promoter' THEN 32 WHEN 'TTS' THEN 16 WHEN 'Genebody' THEN 8 WHEN 'Proximal' THEN 4 ELSE 2 END AS bit, region, gene FROM loci l JOIN regions r ON l.chrom = r.chrom AND ls < r.e AND ls + 300 > r.s),
t AS (SELECT c_custkey, max(bit) AS bit FROM h GROUP BY ALL)
SELECT c_custkey, coalesce(max(region), 'Desert') AS region, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene), '') AS genes FROM loci LEFT JOIN t USING (c_custkey) LEFT JOIN h USING (c_custkey, bit) GROUP BY c_custkey""")
def region_annotate(spark, sf_dir):
    return intervals.annotate(_loci(spark, sf_dir), intervals.gene_regions(_genes(spark, sf_dir)), ["chrom"], ["c_custkey"], "s", "e", 50_000).select("c_custkey", "region", "genes")


@query("SELECT p_partkey, CASE WHEN p_size & 32 <> 0 THEN 'Promoter' WHEN p_size & 16 <> 0 THEN 'TTS' WHEN p_size & 8 <> 0 THEN 'Genebody' WHEN p_size & 4 <> 0 THEN 'Proximal' WHEN p_size & 2 <> 0 THEN 'Distal' ELSE 'Desert' END AS region FROM part", plain=True)
def priority_classify(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", intervals.region_of(F.col("p_size")).alias("region"))


@query("""SELECT p_partkey, CASE WHEN region = 'Desert' OR n > 5000 THEN 'DR' WHEN lv < 20 OR rv < 20 THEN 'NLIR' WHEN region IN ('Distal', 'Proximal', 'Genebody') AND n > 500 THEN 'NDG' ELSE 'NFR' END AS kind
FROM (SELECT p_partkey, p_size AS lv, p_partkey % 60 AS rv, p_partkey * 13 % 6000 AS n, ['Desert', 'Distal', 'Proximal', 'Genebody', 'Promoter'][p_partkey % 5 + 1] AS region FROM part)""", plain=True)
def interval_typing(spark, sf_dir):
    k = F.col("p_partkey")
    region = F.element_at(F.array(*[F.lit(x) for x in ("Desert", "Distal", "Proximal", "Genebody", "Promoter")]), (k % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", intervals.interval_type(F.col("p_size"), k % 60, F.lit(20), region, k * 13 % 6000).alias("kind"))


@query("""SELECT bin_id, coalesce(lag(be) OVER (ORDER BY bin_id), bs) AS bs, be FROM bins""")
def consecutive_coords(spark, sf_dir):
    return intervals.consecutive(views.bins(spark).withColumn("chrom", F.lit("x")), ["chrom"], ["bin_id"], "bs", "be").select("bin_id", "bs", "be")


@query("""SELECT event_id, coalesce(l, bs) AS ext_start, coalesce(n, be) AS ext_end FROM ev LEFT JOIN (SELECT bin_id, bs, be, lag(bs) OVER (ORDER BY bin_id) AS l, lead(be) OVER (ORDER BY bin_id) AS n FROM bins) ON bin_id = pos // 3600""")
def neighbour_extend(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", F.lit("x").alias("chrom"), F.floor(F.col("pos") / 3600).alias("at"))
    places = views.bins(spark).select(F.lit("x").alias("chrom"), F.col("bin_id").alias("idx"), F.col("bs").alias("start"), F.col("be").alias("end"))
    return intervals.neighbour_extend(rows, places, "at").select("event_id", "ext_start", "ext_end")


@query("SELECT event_id, (2 * pos + 900) // 2 - 3000 AS s, (2 * pos + 900) // 2 + 3000 AS e FROM ev")
def constant_extend(spark, sf_dir):
    return loops.recentre(_reads(spark, sf_dir), "s", "e").select("event_id", "s", "e")


_LOOP_SQL = """l AS (SELECT o_orderkey, ['Promoter', 'Genebody', 'Distal', 'Desert', 'TTS'][o_orderkey % 5 + 1] AS a1, ['Promoter', 'Genebody', 'Distal', 'Desert', 'TTS'][o_orderkey // 5 % 5 + 1] AS a2, 'g' || (o_custkey % 7) || ',g' || (o_custkey % 3) || '_bi' AS g1, 'g' || (o_orderkey % 7) AS g2 FROM orders),
c AS (SELECT *, CASE a1 WHEN 'Distal' THEN 'D1' WHEN 'Promoter' THEN 'P1' WHEN 'Genebody' THEN 'G1' ELSE a1 END AS c1, CASE a2 WHEN 'Distal' THEN 'D1' WHEN 'Promoter' THEN 'P1' WHEN 'Genebody' THEN 'G1' ELSE a2 END AS c2,
list_sort(list_distinct(list_intersect([replace(x, '_bi', '') FOR x IN string_split(g1, ',')], [replace(x, '_bi', '') FOR x IN string_split(g2, ',')]))) AS common FROM l),
d AS (SELECT *, least(c1, c2) || ' ' || greatest(c1, c2) AS k FROM c)"""
_LOOP_CLASS = """SELECT o_orderkey, CASE WHEN len(common) > 0 THEN (CASE k WHEN 'D1 P1' THEN 'D1P1' WHEN 'D1 G1' THEN 'D1G1' WHEN 'D1 D1' THEN 'D1D1' WHEN 'G1 G1' THEN 'G1G1' WHEN 'G1 P1' THEN 'P1G1' ELSE 'unknown' END)
ELSE (CASE WHEN k = 'P1 P1' THEN 'P2P1' WHEN 'P1' IN (c1, c2) THEN 'D1P1' WHEN k = 'G1 G1' THEN 'G2G1' WHEN k = 'D1 G1' THEN 'D2G1' WHEN k = 'D1 D1' THEN 'D2D1' WHEN 'Desert' IN (c1, c2) THEN 'Desert' ELSE 'unknown' END) END AS assigned_annotation,
CASE WHEN len(common) > 0 THEN array_to_string(common, ',') WHEN k = 'P1 P1' THEN g1 || ';' || g2 WHEN 'P1' IN (c1, c2) THEN (CASE WHEN c1 = 'P1' THEN g1 ELSE g2 END) WHEN k = 'G1 G1' THEN g1 || ';' || g2 WHEN k = 'D1 G1' THEN (CASE WHEN c1 = 'G1' THEN g1 ELSE g2 END) ELSE 'Undefined' END AS genes FROM d"""


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(x) for x in ("Promoter", "Genebody", "Distal", "Desert", "TTS")])
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    rows = views.table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, (k % 5 + 1).cast("int")).alias("a1"), F.element_at(kinds, (F.floor(k / 5) % 5 + 1).cast("int")).alias("a2"), text("g", c % 7, ",g", c % 3, "_bi").alias("g1"), text("g", k % 7).alias("g2"))
    kind, genes = loops.loop_class(*[F.col(x) for x in ("a1", "a2", "g1", "g2")])
    return rows.withColumns({"assigned_annotation": kind, "genes": genes})


@query("WITH " + _LOOP_SQL + _LOOP_CLASS, plain=True)
def loop_classes(spark, sf_dir):
    return _loops(spark, sf_dir).select("o_orderkey", "assigned_annotation", "genes")


@query("WITH " + _LOOP_SQL + f"SELECT * FROM ({_LOOP_CLASS}) WHERE contains(assigned_annotation, 'P1')", plain=True)
def promoter_loops(spark, sf_dir):
    return loops.promoter_loops(_loops(spark, sf_dir)).select("o_orderkey", "assigned_annotation", "genes")


@query("WITH " + _LOOP_SQL + "SELECT o_orderkey, array_to_string(common, ',') AS common FROM d", plain=True)
def gene_set_intersection(spark, sf_dir):
    return _loops(spark, sf_dir).select("o_orderkey", F.array_join(loops.genes_in_common(F.col("g1"), F.col("g2")), ",").alias("common"))


@query("""SELECT event_id, max(v) AS signal FROM (SELECT e.event_id, s.value AS v FROM (SELECT * FROM ev WHERE chrom = 'error') e LEFT JOIN (SELECT * FROM ev WHERE chrom <> 'error') s ON s.pos < e.pos + 101 AND s.pos + 60 > e.pos - 101) GROUP BY event_id""")
def max_signal_at_sites(spark, sf_dir):
    e = views.events(spark, sf_dir)
    at = e.where("chrom = 'error'").select("event_id", F.lit("x").alias("chrom"), (F.col("pos") - 1).alias("start"), (F.col("pos") + 1).alias("end"))
    track = e.where("chrom <> 'error'").select(F.lit("x").alias("chrom"), F.col("pos").alias("t_start"), (F.col("pos") + 60).alias("t_end"), "value")
    return segments.max_signal(at, track, ["event_id"], 100, 300).select("event_id", "signal")


@query(""", a AS (SELECT * FROM ev WHERE chrom = 'error' AND value >= 100), b AS (SELECT * FROM ev WHERE chrom = 'purchase' AND value >= 50)
SELECT event_id, 0 AS factor FROM a UNION ALL SELECT event_id, 1 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.pos < b.pos + 600 AND a.pos + 600 > b.pos)""")
def transfer_candidates(spark, sf_dir):
    def factor(kind: str) -> DataFrame:
        return views.events(spark, sf_dir).where(F.col("chrom") == kind).select("event_id", F.lit("x").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 600).alias("end"), F.col("value").alias("signal"))

    return segments.transfer_candidates([(factor("error"), 100.0), (factor("purchase"), 50.0)], 600).select("event_id", "factor")


_FRAGMENTS = """SELECT CAST(s AS BIGINT) AS "start", f AS fragment, CAST(e AS BIGINT) AS "end", doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS f, c AS s, lead(c) OVER (PARTITION BY doc_id ORDER BY c) AS e FROM (SELECT DISTINCT doc_id, c FROM (
SELECT doc_id, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) + 4 * (i - 1) + 1 AS c, n FROM (SELECT doc_id, length(text) AS n, unnest(string_split(text, 'tion')) AS p, generate_subscripts(string_split(text, 'tion'), 1) AS i FROM documents) UNION ALL SELECT doc_id, 0, length(text) FROM documents UNION ALL SELECT doc_id, length(text), length(text) FROM documents) WHERE c <= n)) WHERE e IS NOT NULL"""


@query(_FRAGMENTS, plain=True)
def digest_fragments(spark, sf_dir):
    cuts = intervals.digest(views.table(spark, sf_dir, "documents"), "text", ["doc_id"], "t^ion")
    return cuts.withColumns({c: F.col(c).cast("bigint") for c in ("fragment", "start", "end")})


@query(_FRAGMENTS, plain=True)
def digest_in_chunks(spark, sf_dir):
    chunks = formats.chunked(views.table(spark, sf_dir, "documents"), "text", ["doc_id"], 256, 3)
    return intervals.digest_chunks(chunks, ["doc_id"], "t^ion", 256)


@query("""SELECT value FROM (SELECT CAST(p_partkey AS VARCHAR) AS value, p_partkey FROM part UNION ALL SELECT p_brand, p_partkey FROM part) WHERE try_cast(value AS BIGINT) IS NOT NULL""", plain=True)
def header_strip(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    return formats.strip_header_rows(p.select(F.explode(F.array(F.col("p_partkey").cast("string"), F.col("p_brand"))).alias("value")), "value")


@query("""SELECT c_custkey, 'a' || c_custkey AS path1, CASE WHEN c_custkey % 2 = 0 THEN 'b' || c_custkey END AS path2, CASE WHEN c_custkey % 2 = 0 THEN 'PE' ELSE 'SE' END AS layout, c_mktsegment AS assay FROM customer WHERE c_custkey % 10 <> 0""", plain=True)
def manifest_parse(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("# "), k)).when(k % 2 == 0, F.concat_ws("\t", F.concat(F.lit("a"), k), F.concat(F.lit("b"), k), F.lit("PE"), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("a"), k, F.lit(" | "), F.col("c_mktsegment")))
    parsed = formats.parse_manifest(views.table(spark, sf_dir, "customer").select(line.alias("value")))
    return parsed.select(F.substring("path1", 2, 20).cast("bigint").alias("c_custkey"), "path1", "path2", "layout", "assay")


@query("SELECT DISTINCT 's' || s_suppkey AS name FROM supplier", plain=True)
def file_base_name(spark, sf_dir):
    path = F.concat(F.lit("/x/y.z/s"), F.col("s_suppkey"), F.lit("_R1.fastq.gz"))
    return views.table(spark, sf_dir, "supplier").select(formats.base_name(path).alias("name")).distinct()


@query("""SELECT chrom, count(*) AS tags, max(CASE WHEN event_id % 2 = 0 THEN pos + 150 ELSE pos + 75 END) AS max_coordinate FROM ev GROUP BY chrom""")
def tag_statistics(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 75).alias("end"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return formats.tag_statistics(rows)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Shoulder' WHEN p_partkey % 4 = 1 THEN 'Other' WHEN p_partkey % 3 = 0 THEN 'MainPeak:doublet' WHEN p_size % 3 > 0 THEN 'MainPeak+Shoulder' ELSE 'MainPeak' END AS property FROM part""", plain=True)
def property_labels(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "shoulder").when(k % 4 == 1, "noise").otherwise("main")
    return views.table(spark, sf_dir, "part").select("p_partkey", formats.property_label(F.col("p_size") % 3, k % 3 == 0, kind).alias("property"))


@query("""SELECT name, row_number() OVER (ORDER BY n, name) AS rank FROM (SELECT DISTINCT 'chr' || p_size AS name, p_size AS n FROM part)""", plain=True)
def natural_sort_rank(spark, sf_dir):
    names = views.table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), F.col("p_size")).alias("name")).distinct()  # one row a chromosome
    return names.select("name", F.row_number().over(Window.orderBy(*stats.natural_key("name"))).cast("bigint").alias("rank"))


@query("""SELECT chrom, slot, round(sum(least(l, (slot + 1) * 600) - greatest(f, slot * 600 + 1) + 1) / 600.0, 6) AS score FROM (SELECT chrom, f, l, unnest(range((f - 1) // 600, (l - 1) // 600 + 1)) AS slot FROM (SELECT chrom, CASE WHEN event_id % 2 = 0 THEN pos + 37 ELSE pos + 900 - 112 END AS f, CASE WHEN event_id % 2 = 0 THEN pos + 112 ELSE pos + 900 - 37 END AS l FROM ev)) GROUP BY ALL""")
def pileup(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 900).alias("end"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return signal.pileup(signal.covered_single(rows), ["chrom"], "first", "last", 600).withColumn("score", F.round("score", 6))


@query("""SELECT event_id, CAST(round_even(pos + 0.25 * n, 0) AS BIGINT) AS "first", CAST(round_even(pos + n - 0.25 * n, 0) AS BIGINT) AS "last", CAST(round_even(pos + n / 2.0, 0) AS BIGINT) AS center FROM (SELECT event_id, pos, CAST(event_id % 300 AS BIGINT) AS n FROM ev) WHERE n + 1 BETWEEN 100 AND 200""")
def paired_cores(spark, sf_dir):
    rows = views.events(spark, sf_dir).select("event_id", F.col("pos").alias("start"), (F.col("pos") + F.col("event_id") % 300).alias("end"))
    return signal.covered_paired(rows).select("event_id", "first", "last", "center")
