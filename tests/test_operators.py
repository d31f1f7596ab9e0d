import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.operators import intervals, islands, matrix, segments, signal
from tessera.plans import pipelines
from tessera.sources import formats
from tessera.tables import keep


@pytest.mark.parametrize("bucket", [1, 7, 50, 1000])
def test_overlap_join_is_the_naive_join(spark, bucket):
    r = random.Random(bucket)
    a = [(i, r.choice("xy"), s := r.randrange(-50, 300), s + r.randrange(0, 60)) for i in range(60)]
    b = [(i, r.choice("xy"), s := r.randrange(-50, 300), s + r.randrange(0, 60)) for i in range(60)]
    got = intervals.overlap_join(spark.createDataFrame(a, "i int, c string, s long, e long"), spark.createDataFrame(b, "j int, c string, bs long, be long"), ["c"], "s", "e", "bs", "be", bucket)
    want = sorted((i, j, min(e, be) - max(s, bs)) for i, c, s, e in a for j, d, bs, be in b if c == d and s < be and e > bs and s < e and bs < be)
    assert sorted((x.i, x.j, x.olp) for x in got.collect()) == want


def zero_runs_by_hand(values, tolerance, least):
    out, i, n = [], 0, len(values)
    while i < n:
        if values[i]:
            i += 1
            continue
        last, zeros, others, k = i, 0, 0, i
        while k < n and others <= tolerance:
            if values[k] == 0:
                zeros, last, others = zeros + 1, k, 0
            else:
                others += 1
            k += 1
        if zeros >= least:
            out.append((i, last, zeros))
        i = last + 1
        while i < n and values[i]:
            i += 1
    return out


def test_zero_runs_equal_the_walk(spark):
    r = random.Random(5)
    tracks = {c: [int(r.random() < 0.5) for _ in range(80)] for c in range(12)}
    rows = spark.createDataFrame([(c, i, v) for c, t in tracks.items() for i, v in enumerate(t)], "c int, i int, v int")
    got = sorted(tuple(x) for x in islands.zero_runs(rows, ["c"], "i", "v", 2, 3).select("c", "first", "last", "zeros").collect())
    assert got == sorted((c, *x) for c, t in tracks.items() for x in zero_runs_by_hand(t, 2, 3))


def test_mirror_then_triangle_is_the_map(spark):
    rows = [("c", 0, 0, 1), ("c", 0, 3, 2), ("c", 2, 3, 4)]
    m = spark.createDataFrame(rows, "chrom string, bin1_id long, bin2_id long, cnt long")
    assert sorted(tuple(r) for r in matrix.triangle(matrix.mirror(m)).collect()) == rows
    assert {r.bin_id: r.marginal for r in matrix.marginals(m).collect()} == {0: 3, 2: 4, 3: 6}


def test_digest_with_overlapping_motifs(spark):
    rows = spark.createDataFrame([("a", "GAGAGA"), ("b", ""), ("c", "TTT"), ("d", "AANCAGC")], "k string, t string")
    got = {}
    for r in intervals.digest(rows, "t", ["k"], "G^NG").collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {"a": [(0, 1), (1, 3), (3, 6)], "c": [(0, 3)], "d": [(0, 7)]}


def test_subdivision_edges(spark):
    sizes = [1, 299, 300, 599, 600, 29_999, 30_000, 100_000]
    rows = spark.createDataFrame([(n, 10, 10 + n) for n in sizes], "n int, s long, e long")
    got = intervals.subdivide(rows, "s", "e").orderBy("n", "piece").collect()
    for n in sizes:
        own = [(r.piece_start, r.piece_end) for r in got if r.n == n]
        assert own[0][0] == 10 and own[-1][1] == 10 + n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert len(own) == (1 if n < 300 else 2 if n < 600 else -(-n // 300) if n < 30_000 else 100)


def test_readers(spark, tmp_path):
    (tmp_path / "p").write_text("# header\n" + "\t".join(["r1", "chr1", "1", "chr2", "2", "+", "-", "x", "y", "R1", "11", "22", "33", "44"]) + "\n")
    r = formats.read_pairs(spark, str(tmp_path / "p")).collect()[0]
    assert (r.chrom1, r.pos51, r.pos31, r.strand1, r.chrom2, r.pos52, r.pos32, r.strand2, r.walk_pair_type) == ("chr1", 11, 33, "+", "chr2", 22, 44, "-", "R1")
    (tmp_path / "f").write_text(">c1 x\nACG\ntt\n>c2\nGG\n")
    assert sorted(tuple(x) for x in formats.read_fasta(spark, str(tmp_path / "f")).collect()) == [("c1", "ACGTT"), ("c2", "GG")]


def test_contigs_in_chunks_give_the_same_fragments(spark, tmp_path):
    rng = random.Random(4)
    contigs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate([0, 1, 6, 7, 8, 300, 2000])} | {"m": "GATCGATC" * 20, "end": "ACGATC"}
    for f, width in (("one", 5), ("two", 61)):
        text = "".join(f">{c} x y\n" + "".join(x[i : i + width].lower() + "\n" for i in range(0, len(x), width)) for c, x in contigs.items())
        (tmp_path / f"{f}.fa").write_text("bases of no record\n" + text + (">c6\nGATC\n>none\n" if f == "two" else ">one\n" + "GATCA" * 40))
    want = {"one": [*contigs.items(), ("one", "GATCA" * 40)], "two": [*contigs.items(), ("c6", "GATC"), ("none", "")]}
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, overlap, split in ((7, 3, 97), (64, 5, 1000), (1 << 20, 3, 1 << 27)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            chunks = keep(formats.read_fasta_chunks(spark, str(tmp_path / "*.fa"), size, overlap), "chunks")
            rows = chunks.collect()
            assert max(len(r.sequence) for r in rows) <= size + overlap
            pieces = {(r.file[-6:-3], r.record, r.contig, r.offset): r.sequence for r in rows}
            assert pieces == {(f, i, c, at): x[at : at + size + overlap] for f, of in want.items() for i, (c, x) in enumerate(of, 1) for at in range(0, len(x), size)}
            got = sorted((r.file[-6:-3], r.record, r.fragment, r.start, r.end) for r in intervals.digest_chunks(chunks, ["file", "record", "contig"], "^GATC" if size == 7 else "GA^NC", size).collect())
            whole = spark.createDataFrame([(f, i, x) for f, of in want.items() for i, (c, x) in enumerate(of, 1)], "file string, record long, x string")
            assert got == sorted((r.file, r.record, r.fragment, r.start, r.end) for r in intervals.digest(whole, "x", ["file", "record"], "^GATC" if size == 7 else "GA^NC").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_map_round_trip(spark, tmp_path):
    bins = spark.createDataFrame([("c", i, 10 * i, 10 * i + 10, 0.5 * (i + 1)) for i in range(3)], "chrom string, bin_id long, start long, end long, weight double")
    pixels = spark.createDataFrame([("c", 0, 2, 4), ("c", 1, 1, 2)], "chrom string, bin1_id long, bin2_id long, cnt long")
    formats.write_map(bins, pixels, str(tmp_path / "m"))
    back = formats.read_map(spark, str(tmp_path / "m"), "c", balanced=True)[1]
    assert {(r.bin1_id, r.bin2_id): r.cnt for r in back.collect()} == {(0, 2): 3.0, (1, 1): 2.0}


def test_gaussian_sums_to_about_one():
    assert abs(sum(w for _, w in signal.gaussian(3.0)) - 1) < 0.01 and len(signal.gaussian(3.0)) == 19


def test_poisson_tails_are_whole(spark):
    cases = [(n, m) for m in (0.3, 28.5, 300.0, 10_000.0) for n in {0, 1, int(m) // 2, int(m) - 1, int(m), int(m) + 1, int(m) + 90, 2 * int(m), 1000} if n >= 0]
    rows = spark.createDataFrame(cases, "n long, m double")
    got = rows.select("n", "m", signal.poisson_tail(F.col("n"), F.col("m")).alias("upper"), signal.poisson_tail(F.col("n"), F.col("m"), upper=False).alias("lower")).collect()
    for r in got:
        terms = [k * math.log(r.m) - r.m - math.lgamma(k + 1) for k in range(25_000)]

        def score(part):
            top = max(part)
            return -(top + math.log(math.fsum(math.exp(x - top) for x in part))) / math.log(10)

        assert r.upper == pytest.approx(score(terms[r.n :]) if r.n else 0, rel=1e-9, abs=2e-8)
        assert r.lower == pytest.approx(score(terms[: r.n + 1]), rel=1e-9, abs=2e-8)


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    """Closed periods in append mode add up to the best-match counts; a pair that comes too late counts nowhere, and state of closed periods goes."""
    from tessera.streaming.contacts import stream_counts

    pairs = [(i, "c", (i * 37) % 100, (i * 53) % 100, i * 60) for i in range(40)]
    late, last = (100, "c", 5, 5, 0), (101, "c", 5, 5, 10**6)
    bins = spark.range(10).selectExpr("id bin_id", "id * 10 bs", "id * 10 + 8 be")
    schema = "pair_id long, chrom string, p1 long, p2 long, t long"
    path = str(tmp_path / "in")

    def write(rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)

    write(pairs)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = stream_counts(stream, bins, 6, 10, late="10 minutes", period="10 minutes").writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    for rows in ([(102, "c", 5, 5, 9 * 10**5)], [late], [last]):
        query.processAllAvailable()
        write(rows)
    query.processAllAvailable()
    kept = [p["numRowsTotal"] for p in query.lastProgress["stateOperators"]]
    query.stop()
    want = {}
    for _, _, p1, p2, t in [*pairs, (102, "c", 5, 5, 9 * 10**5)]:
        best = []
        for p in (p1, p2):
            over = [(min(p + 6, 10 * k + 8) - max(p, 10 * k), -k) for k in range(10)]
            best.append(-max(o for o in over if o[0] > 0)[1] if any(o[0] > 0 for o in over) else None)
        if None not in best:
            key = (t // 600, min(best), max(best))
            want[key] = want.get(key, 0) + 1
    got = {(int(r.period_start.timestamp()) // 600, r.bin1_id, r.bin2_id): r.cnt for r in spark.table("counts").collect()}
    assert got == want and kept == [1]


def called_by_hand(pixels, n, w, kinds=None, zeros=4, tolerance=3):
    """(first, last, tag, score) of one chromosome with bins of 5,000 bases and one nucleosome each, on dense arrays."""
    a = np.zeros((n, n))
    for i, j, v in pixels:
        a[i, j] = a[j, i] = v
    mean = np.zeros(n)
    for i in range(n - 1):
        mean[i] = a[max(0, i - w + 1) : i + 1, i + 1 : i + 1 + w].mean()
    if kinds is None:
        first = [min([j for j in range(i, n) if a[i, j]], default=n) for i in range(n)]
        gap, i = [False] * n, 0
        while i < n:
            to = min(first[i:])
            if to - 1 >= i + 1:
                gap[i:to] = [True] * (to - i)
                i = to
            else:
                i += 1
        gap = gap[:n]
    else:
        gap = [k == 0 for k in kinds]
        one = [i for i in range(n) if kinds[i] == 1]
        least = mean[one].min()
        mean[one] -= np.quantile(mean[one], 0.25)
        mean[mean <= 0] = least
    z = a.copy()
    for k in range(1, 2 * w):
        d = np.diagonal(a, k)
        if d.std():
            z[np.arange(n - k), np.arange(k, n)] = (d - d.mean()) / d.std(ddof=1)
    cut = 0.05 if kinds is None else 0.1
    p, mark, inside, i = np.ones(n), [False] * (n + 1), [False] * n, 0
    while i < n:
        j = i
        while j < n and not gap[j]:
            j += 1
        if j - 1 - i >= 3:
            inside[i:j] = [True] * (j - i)
            part, m = z[i:j, i:j], j - i
            for x in range(1, m):
                diamond = [part[r, c] for r in range(max(1, x - w + 1), x + 1) for c in range(x, min(x + w, m))]
                side = [part[r, c] for lo, hi in ((max(0, x - w), x), (x, min(x + w, m))) for r in range(lo, hi) for c in range(r + 1, hi) if part[r, c]]
                p[i + x - 1] = kernels.mann_whitney_less(np.array(diamond), np.array(side))
            for x, e in enumerate(kernels.change_points(mean[i:j])):
                mark[i + x + (kinds is not None)] |= e == -1 and p[i + x] < cut
        i = j + 1
    if kinds is None:
        gap = [not x for x in inside]
    tag, score = [None] * n, [1.0] * n
    for kind, test in (("gap", lambda x: gap[x]), ("boundary", lambda x: mark[x] and not gap[x]), ("domain", lambda x: not mark[x] and not gap[x])):
        i = 0
        while i < n:
            j = i
            while j < n and test(j):
                j += 1
            if j > i and (kind != "boundary" or kinds is not None or j - i >= 2):
                low = kind == "domain" and (p[i:j] < cut).all()
                for x in range(i, j):
                    tag[x] = "boundary" if low else kind
                    score[x] = p[i:j].mean() if tag[x] == "domain" else 0.0
            i = max(j, i + 1)
    top = max([s for s, t in zip(score, tag, strict=True) if t], default=0) or 1.0
    score = [1 - int(s / top * 10) if t else 1.0 for s, t in zip(score, tag, strict=True)]
    over = [k == 0 for k in kinds] if kinds else [False] * n
    if not kinds:
        for lo, hi, _ in zero_runs_by_hand([int(a[i, i] != 0) for i in range(n)], tolerance, zeros):
            over[lo : hi + 1] = [True] * (hi + 1 - lo)
    tag = ["gap" if o or t is None else t for o, t in zip(over, tag, strict=True)]
    score = [1.0 if o else float(s) for o, s in zip(over, score, strict=True)]

    def runs(items):
        out = []
        for lo, hi, t, s in items:
            if out and out[-1][2] == t:
                out[-1] = (out[-1][0], hi, t, [*out[-1][3], s])
            else:
                out.append((lo, hi, t, [s]))
        return [(lo, hi, t, sum(s) / len(s)) for lo, hi, t, s in out]

    out = runs([(i, i, t, s) for i, (t, s) in enumerate(zip(tag, score, strict=True))])
    if not kinds:
        out = runs([(lo, hi, "gap", 1.0) if t == "domain" and hi == lo else (lo, hi, t, s) for lo, hi, t, s in out])
    return [(lo, hi, t, min(s, -1.0) if t == "domain" else s) for lo, hi, t, s in out]


@pytest.mark.parametrize("regions_map", [False, True])
def test_segments_equal_the_walk_on_dense_arrays(spark, regions_map):
    r = np.random.default_rng(11)
    rows, bins, want = [], [], {}
    for c, (n, share) in enumerate([(70, 0.9), (55, 0.5), (40, 0.12)]):
        shift, block = 1000 * c, np.cumsum(r.random(n) < 0.12)
        own = [(i, j, int(r.integers(1, 9)) * (4 if block[i] == block[j] else 1)) for i in range(n) for j in range(i, min(n, i + 14)) if r.random() < share]
        own = [x for x in own if not 20 <= x[0] <= 27 and not 20 <= x[1] <= 27]
        kinds = [0 if k % 23 == 11 else 1 if k % 5 == 2 else 2 for k in range(n)]
        rows += [(f"c{c}", i + shift, j + shift, v) for i, j, v in own]
        bins += [(f"c{c}", shift + k, 5000 * k, 5000 * k + 5000, 1, kinds[k]) for k in range(n)]
        want[f"c{c}"] = [(lo + shift, hi + shift, t, round(s, 9)) for lo, hi, t, s in called_by_hand(own, n, 4, kinds if regions_map else None)]
    pixels = spark.createDataFrame(rows, "chrom string, bin1_id long, bin2_id long, cnt long")
    places = spark.createDataFrame(bins, "chrom string, bin_id long, start long, end long, nuc long, kind int")
    got = {c: [] for c in want}
    for x in pipelines.segment(pixels, places, window=4, zeros=4, regions_map=regions_map).orderBy("chrom", "first").collect():
        got[x.chrom].append((x["first"], x["last"], x.tag, round(x.score, 9)))
        assert (x.start, x.end) == (5000 * (x["first"] % 1000), 5000 * (x["last"] % 1000) + 5000)
    assert got == want and {t for w in want.values() for _, _, t, _ in w} >= {"gap", "domain"}


def inserted_by_hand(rows, marks):
    """rows and marks: (first, last, start, end, ...) of one chromosome; the pieces in order, before their edges are made to meet."""
    out = []
    for f, t, s, e, tag in rows:
        cuts = sorted((bs, be, bf, bl) for bf, bl, bs, be in marks if bs < e and be > s and not (s >= bs and e <= be)) if tag == "domain" else []
        if not cuts:
            out.append([f, t, s, e, tag])
        elif len(cuts) == 1:
            bs, be, bf, bl = cuts[0]
            if bs < s:
                out.append([bl, t, be, e, tag])
            elif be > e:
                out.append([f, bf, s, bs, tag])
            else:
                pieces = [[f, bf, s, bs, tag], [bf, bl, bs, be, "boundary"], [bl, t, be, e, tag]]
                if f == bf:
                    pieces[1][0], pieces[1][2] = f, s
                    pieces.pop(0)
                if t == bl:
                    pieces[-2][1], pieces[-2][3] = t, e
                    pieces.pop()
                out += pieces
        else:
            at, first = s, f
            for bs, be, bf, bl in cuts:
                lo, hi = max(at, bs), min(e, be)
                if at < lo:
                    out.append([first, bf, at, lo, tag])
                out.append([bf, bl, lo, hi, "boundary"])
                at, first = hi, bl
            if at < e:
                out.append([first, t, at, e, tag])
    starts, ends = [p[2] for p in out], [p[3] for p in out]
    for i in range(1, len(out)):
        if starts[i] != ends[i - 1]:
            if out[i][4] == "domain":
                out[i - 1][3] = starts[i]
            else:
                out[i][2] = ends[i - 1]
    return [tuple(p) for p in out if p[2] != p[3]]


def test_transferred_boundaries_equal_the_walk(spark):
    """The whole query's input: signals, cuts of their densities, candidates by priority, and the pieces, one after the other."""
    from tessera.plans import composite_queries

    sf = "/root/testdata/sf0.001"
    called, bins, source, factors = composite_queries._transfer(spark, sf)
    rows, places, marks = ([tuple(r) for r in x.collect()] for x in (called.select("chrom", "first", "last", "start", "end", "tag"), bins, source.distinct()))
    chosen = []
    for pair in factors:
        tracks = [[tuple(r) for r in x.collect()] for x in pair]
        signals = [[max([v for c, a, b, v in track if c == m[0] and a < m[2] + 100 and b > m[1] - 100], default=None) for m in marks] for track in tracks]
        cuts = []
        for values, low in zip(signals, (0.015, 0.0015), strict=True):
            _, d = kernels.kde(np.array([v for v in values if v is not None]))
            behind = [i for i in range(len(d)) if d[i] <= low and i > d.argmax()]
            cuts.append(max(behind[0] if behind else len(d) - 1, 10))
        good = [m for m, x, y in zip(marks, *signals, strict=True) if x is not None and y is not None and x >= cuts[0] and y >= cuts[1]]
        good = [m for m in good if not any(r[0] == m[0] and r[5] == "boundary" and r[3] < m[2] and r[4] > m[1] for r in rows)]
        chosen += [m for m in good if not any(o[0] == m[0] and o[1] < m[2] and o[2] > m[1] for o in chosen)]
    assert chosen
    want = []
    for chrom in {r[0] for r in rows}:
        put = set()
        for c, s, e in chosen:
            near = [p for p in places if p[0] == chrom == c and p[2] < e and p[3] > s]
            if near:
                put.add((min(p[1] for p in near), max(p[1] for p in near), min(p[2] for p in near), max(p[3] for p in near)))
        own = sorted((r[1:] for r in rows if r[0] == chrom), key=lambda r: r[2])
        want += [(chrom, *p) for p in inserted_by_hand(own, put)]
    got = [(r.chrom, r["first"], r["last"], r.start, r.end, r.tag) for r in composite_queries.transferred_boundaries(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) != len(rows)


def test_boundaries_at_edges(spark):
    rows = [(0, 4, 0, 50, "gap"), (5, 14, 50, 150, "domain"), (15, 15, 150, 160, "boundary"), (16, 29, 160, 300, "domain"), (30, 39, 300, 400, "domain"), (40, 42, 400, 430, "domain")]
    for marks in ([(4, 6, 40, 70)], [(13, 15, 130, 160)], [(5, 6, 50, 70)], [(13, 14, 130, 150)], [(7, 8, 70, 90)], [(18, 19, 180, 200), (19, 21, 190, 220), (28, 31, 280, 320)], [(39, 43, 390, 440)], [(30, 30, 300, 310), (39, 39, 390, 400)]):
        called = spark.createDataFrame([("c", *r, -1.0) for r in rows], "chrom string, first long, last long, start long, end long, tag string, score double")
        put = spark.createDataFrame([("c", *m) for m in marks], "chrom string, b_first long, b_last long, b_start long, b_end long")
        got = segments.insert_boundaries(called, put, 64).select("first", "last", "start", "end", "tag").collect()
        assert sorted(map(tuple, got)) == sorted(inserted_by_hand(rows, marks)), marks


def test_false_discovery_grows_with_the_rows(spark):
    import time

    from tessera.functions import stats

    r = np.random.default_rng(0)
    took = []
    for n in (50_000, 200_000):
        p = np.concatenate([r.random(n // 2), r.random(n // 2 - 3) ** 9, [0.0, 1.0, np.nan]])
        rows = spark.createDataFrame([(i, "x", None if x != x else float(x)) for i, x in enumerate(p)], "i long, c string, p double").repartition(4).cache()
        rows.count()
        began = time.time()
        got = {x.i: x.q for x in stats.bh(rows, ["c"], "p", ["i"]).collect()}
        took.append(time.time() - began)
        known = p[:-1]
        want = kernels.bh_values(known)
        assert got.pop(len(p) - 1) is None and np.allclose([got[i] for i in range(len(known))], want, rtol=1e-9, atol=0)
    assert took[1] < 8 * took[0] + 5  # sixteen times as much if it were quadratic


def test_text_formats(spark, tmp_path):
    (tmp_path / "p").write_text("# x\nr1\tchr1\t11\t33\tchr2\t22\t44\tR1\t+-\t60\n")
    r = formats.read_polished_pairs(spark, str(tmp_path / "p")).first()
    assert (r.chrom1, r.pos51, r.pos32, r.strand1, r.strand2, r.mapq) == ("chr1", 11, 44, "+", "-", 60)
    track = spark.createDataFrame([("c", 0, 10, 1.5), ("c", 10, 20, None), ("c", 20, 30, float("nan"))], "chrom string, start long, end long, value double")
    formats.write_signal(track, str(tmp_path / "s"))
    assert sorted(tuple(x) for x in formats.read_table(spark, str(tmp_path / "s"), "signal").collect()) == [("c", 0, 10, 1.5), ("c", 10, 20, 0.0), ("c", 20, 30, 0.0)]
    called = spark.createDataFrame([("c", 200, 350, 1.23456, 9.87654, "MainPeak", 3.5, 1.25), ("c", 0, 140, 2.0, 4.0, "Shoulder", 1.0, 0.5)], "chrom string, start long, end long, height double, auc double, property string, nlp_peak double, nlp_valley double")
    formats.write_nucleosomes(called, str(tmp_path / "n"))
    back = sorted(tuple(x) for x in formats.read_table(spark, str(tmp_path / "n"), "nucleosomes").collect())
    assert back == [("c", 0, 140, "Nucleosome:1", 150, 2.0, 4.0, "Shoulder", 1.0, 0.5), ("c", 200, 350, "Nucleosome:2", 160, 1.235, 9.877, "MainPeak", 3.5, 1.25)]
    profile = spark.createDataFrame([(0, 1.23456, 1.0, -0.5, 0.25, 3, 0.0), (7, 2.0, 1.11111, 0.1, 0.2, 0, 1.5)], "slot long, score double, smooth double, log double, minor_log double, tags long, height double")
    formats.write_profile(profile, str(tmp_path / "w"))
    lines = sorted(x for f in (tmp_path / "w").glob("part*") for x in f.read_text().splitlines())
    assert lines == ["1\t1.235\t1.0\t-0.5\t0.25\t3\t0.0", "71\t2.0\t1.111\t0.1\t0.2\t0\t1.5"]
    cuts = spark.createDataFrame([("c", 0, 10, 1), ("c", 10, 25, 2), ("c", 25, 40, 3), ("d", 0, 9, 1)], "Chromosome string, Start long, End long, bin_id long")
    assert sorted((x.chrom, x.site_start, x.site_end) for x in intervals.sites_of_fragments(cuts).collect()) == [("c", 9, 11), ("c", 24, 26)]


def test_bins_drop_shoulders_and_short_gaps_in_genes(spark):
    areas = [2.0 ** (k / 10) for k in range(-30, 31) for _ in range(31 - abs(k))]
    cut = kernels.area_cut(spark.createDataFrame([(a,) for a in areas], "auc double"), "auc")
    grid, density = kernels.kde(np.log2(areas))
    assert cut == pytest.approx(2 ** grid[np.flatnonzero(density >= 0.75 * density.max())[0]]) and 0.3 < cut < 1
    rows = [("c", 400 * k, 400 * k + 150, 1.0, a, kind, 2.0, 3.0) for k, (a, kind) in enumerate([(5.0, "MainPeak")] * 10 + [(a, "Shoulder") for a in (1.0, 8.0, 8.0, 8.0, 8.0, 8.0)])]
    n = spark.createDataFrame(rows, "chrom string, start long, end long, height double, auc double, property string, nlp_peak double, nlp_valley double")
    genes = spark.createDataFrame([], "chrom string, start long, end long, strand string, gene string")
    bins = pipelines.build_bins(n, genes, spark.createDataFrame([("c", 7000)], "chrom string, length long"))
    assert sorted(r.start for r in bins.where("nuc = 1").collect()) == [400 * k for k in range(16) if k != 10]


def test_gap_measures_and_genebody_filter(spark):
    gaps = spark.createDataFrame([("c", 0, 500, 20.0)] + [("c", 1000 * k, 1000 * k + 100 + 10 * k, v) for k, v in enumerate([5.0, 6.0, 8.0, 9.0, 0.01], 1)], "chrom string, start long, end long, left_valley double")
    # the median of 5, 6, 8, 9 is 7, their deviations 2, 1, 1, 2; lengths 500, 110, .. 150: median 135, deviations 365, 25, 15, 5, 5, 15
    assert pipelines.gap_measures(gaps) == (3.0, 15.0) and pipelines.gap_measures(gaps.where("false")) == (None, 0.0)
    known = spark.createDataFrame([("Genebody", 0, 89), ("Genebody", 0, 90), ("Distal", 0, 80)], "region string, start long, end long")
    assert sorted((r.region, r.end) for r in pipelines.genebody_filter(known, 15.0).collect()) == [("Distal", 80), ("Genebody", 90)]
    assert [r.region for r in pipelines.genebody_filter(known, 31.0).collect()] == ["Distal"]
