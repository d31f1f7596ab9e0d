"""Balancing, blobs, loops and the distance curve against plain walks over dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.spline import smoothed
from tessera.operators import balancing, loops
from tessera.plans import pipelines

PIXELS = "chrom string, bin1_id long, bin2_id long, cnt double"


def test_wide_balance_equals_the_kernel(spark):
    """Chromosomes of several components, one of them alone in a task; marginals meet their targets, and plans don't grow."""
    r = np.random.default_rng(6)
    rows, want = [], []
    for c, n in enumerate((30, 12, 25)):
        block = r.integers(0, 3, n)
        rows += [(f"c{c}", 100 * c + i, 100 * c + j, float(r.integers(1, 20))) for i in range(n) for j in range(i, n) if i == j or (block[i] == block[j] and r.random() < 0.6)]
        want += [(f"c{c}", 100 * c + i, float(r.uniform(0.5, 3))) for i in range(n) if i % 7]
    pixels, targets = spark.createDataFrame(rows, PIXELS), spark.createDataFrame(want, "chrom string, bin_id long, target double")
    goal = {(c, b): t for c, b, t in want}
    plain = {(x.chrom, x.bin_id): x.bias for x in balancing.balance_map(pixels, targets).collect()}
    wide = balancing.balance_map(pixels, targets, alone=100)
    assert len(wide._jdf.queryExecution().toString()) < 20_000
    got = {(x.chrom, x.bin_id): x.bias for x in wide.collect()}
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(plain[k], rel=1e-5) for k in plain)
    sums = dict.fromkeys(got, 0.0)
    for c, i, j, v in rows:
        v *= got[c, i] * got[c, j]
        sums[c, i] += v
        if i != j:
            sums[c, j] += v
    assert max(abs(s - goal.get(k, 1.0)) for k, s in sums.items()) < 1e-5
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("entries_")]


def blobs_by_hand(a, limit, sigma, octaves, layers, q_most, dense, dense_wide, reach):
    n = len(a)
    stored = [(i, j) for i in range(n) for j in range(i + 2, n) if a[i, j]]
    work = a.copy()
    for i in range(n):
        for j in range(n):
            if j - i <= 2 or j - i > limit:
                work[i, j] = 2

    def smooth(s):
        far = int(np.ceil(2 * s))
        w = np.exp(-0.5 * (np.arange(-far, far + 1) / s) ** 2)
        w = np.outer(w, w) / w.sum() ** 2
        wide = np.pad(work, far, mode="symmetric")
        return np.array([[(wide[i : i + 2 * far + 1, j : j + 2 * far + 1] * w).sum() for j in range(n)] for i in range(n)])

    around = lambda d, i, j: np.pad(d, reach)[i : i + 2 * reach + 1, j : j + 2 * reach + 1].max()
    best, scale, p = dict.fromkeys(stored, 0.0), dict.fromkeys(stored, 1.0), {}
    for o in range(octaves):
        width = {i: sigma * 2**o * 2 ** ((i - 1) / layers) for i in range(1, layers + 2)}
        g = {i: smooth(width[i]) for i in width}
        d = [g[1] - g[2], g[2] - g[3], np.zeros((n, n))] + [g[m] - g[m + 1] for m in range(3, layers + 1)]
        for c in range(1, len(d) - 1):
            values = np.array([abs(d[c][x]) for x in stored])
            low, spread = values.min(), values.mean() - values.min()
            for k, (i, j) in enumerate(stored):
                v, one, two = d[c][i, j], around(d[c - 1], i, j), around(d[c + 1], i, j)
                if v > best[i, j] and v == around(d[c], i, j) and (d[c - 1][i, j] == one or d[c + 1][i, j] == two) and v > one and v > two:
                    best[i, j], scale[i, j], p[i, j] = v, width[3] if c == 1 else width[c + 1], np.exp(-(values[k] - low) / spread) if spread else 1.0
    order = sorted(p, key=p.get)
    q, least = {}, 1.0
    for rank in range(len(order), 0, -1):
        least = min(least, p[order[rank - 1]] * len(order) / rank)
        q[order[rank - 1]] = least
    full = np.zeros((n, n), bool)
    for x in stored:
        full[x] = True

    def share(i, j, s):
        return full[i - s : i + s + 1, j - s : j + s + 1].sum() / (2 * s + 1) ** 2 if i >= s and j >= s else 0

    kept = set()
    for (i, j), v in q.items():
        s = int(np.ceil(scale[i, j]))
        diagonal = [work[k, k + j - i] for k in range(n - (j - i)) if work[k, k + j - i]]
        if v < q_most and i and share(i, j, s) >= dense and share(i, j, 2 * s) >= dense_wide and work[i, j] > 2 * np.mean(diagonal):
            kept |= {(i + x, j + y) for x in (-1, 0, 1) for y in (-1, 0, 1)}
    kept = {(i, j) for i, j in kept if i < n and j < n}
    out = []
    while kept:
        group, todo = set(), [kept.pop()]
        while todo:
            i, j = todo.pop()
            group.add((i, j))
            near = {(i + x, j + y) for x in (-1, 0, 1) for y in (-1, 0, 1)} & kept
            kept -= near
            todo += near
        value = lambda x: q.get(x, 2.0 if x in best else 1.0)
        top = min(group, key=lambda x: (value(x), x))
        out.append((*top, value(top), scale.get(top, 1.0)))
    return sorted(out)


def a_map(r, n, peaks=4, fill=0.9):
    i = np.arange(n)
    a = np.triu((np.maximum(0, 4 - np.abs(i[:, None] - i) / 12) + r.random((n, n))) * (r.random((n, n)) < fill))
    for _ in range(peaks):
        x = r.integers(2, n - 12)
        y = r.integers(x + 6, min(n - 2, x + 25))
        a[x - 1 : x + 2, y - 1 : y + 2] += r.uniform(5, 25)
    return np.round(a, 3)


@pytest.mark.parametrize("seed", range(5))
def test_blobs_equal_the_walk(seed):
    r = np.random.default_rng(seed)
    a = a_map(r, 42, fill=[0.95, 0.7, 0.9, 0.8, 1.0][seed])
    settings = dict(sigma=[0.5, 0.3][seed % 2], octaves=2, layers=10, q_most=0.3, dense=0.3, dense_wide=0.4, reach=2 - seed % 2)
    got = kernels.blobs(a, 30, least=50, **settings)
    want = blobs_by_hand(a, 30, **settings)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2:] for x in got], [x[2:] for x in want]) and (want or seed > 2)
    assert kernels.blobs(a, 30, least=10_000) == [] and kernels.blobs(np.zeros((5, 5))) == []


def test_loops_equal_the_walk(spark):
    """Tiles by position, blobs within the distances, strong pixels by the quantile of the whole matrix, lines, and one row for each pair of ends."""
    r = np.random.default_rng(3)
    width, reach, n = 1000, 26_000, 190
    settings = dict(q_most=0.3, dense_wide=0.3, sigma=0.5, octaves=1, layers=10, reach=2)
    rows, want = [], []
    for c in range(2):
        a = a_map(r, n, peaks=14) if c == 0 else a_map(r, 20, peaks=1)
        m = len(a)
        pixels = [(i, j) for i in range(m) for j in range(i, min(m, i + 60)) if a[i, j]]
        rows += [(f"c{c}", i, j, float(a[i, j])) for i, j in pixels]
        ends = [(i + 1) * width for i in range(m)]
        found = {}
        for dense in (0.25, 0.6):
            for k in range(10):
                low, high = (0 if k == 0 else (5 * k - 1) * reach), 5 * (k + 1) * reach
                own = [i for i in range(m) if low <= ends[i] < high]
                if not own:
                    continue
                t = np.zeros((len(own),) * 2)
                near = [(i, j) for i, j in pixels if i in own and j in own and (j - i) * width <= reach]
                for i, j in near:
                    t[i - own[0], j - own[0]] = a[i, j]
                limit = max([j - i for i, j in near if (j - i) * width < reach], default=0)
                if sum(j - i >= 2 for i, j in near) < 100:
                    continue
                for i, j, q, s in blobs_by_hand(t, limit, dense=dense, **settings):
                    i, j = i + own[0], j + own[0]
                    if (k == 0 or max(i, j) >= [x for x in range(m) if ends[x] >= 5 * k * reach][0]) and 4 * width <= (j - i) * width <= reach:
                        found.setdefault((i, j), (q, s, float(a[i, j])))
        band = [(i, j) for i, j in pixels if 5 * width <= (j - i) * width <= 40 * width]
        if m > 10:
            cut = np.quantile([a[x] for x in band for _ in (0, 1)], 0.98)
            groups, last = [], None
            for i, j in [x for x in band if a[x] >= cut]:
                if last and abs(i - last[0]) <= 5 and abs(j - last[1]) <= 5 and len(groups[-1]) < 50:
                    groups[-1].append((i, j))
                else:
                    groups.append([(i, j)])
                last = (i, j)
            peaks = [max(g, key=lambda x: a[x]) for g in groups]
            known = [v for v in found.values() if v[2] >= min(a[x] for x in peaks)]
            for x in peaks:
                if x not in found:
                    if not known:
                        fit = (0.01, 0.6155) if found else (0.00001, 0.6155)
                    else:
                        xs = np.array([v[2] for v in known])
                        fit = [np.polyval(np.polyfit(xs, [v[k] for v in known], 1), a[x]) if len(set(xs)) > 1 else np.mean([v[k] for v in known]) for k in (0, 1)]
                    found[x] = (round(max(fit[0], 0), 5), round(fit[1], 5), float(a[x]))
        want += [(f"c{c}", i, j, q, s, v) for (i, j), (q, s, v) in found.items()]
    bins = spark.createDataFrame([(f"c{c}", i, i * width, (i + 1) * width) for c in range(2) for i in range((n, 20)[c])], "chrom string, bin_id long, start long, end long")
    got = pipelines.call_loops(spark.createDataFrame(rows, PIXELS), bins, 4 * width, reach, 5 * width, 40 * width, q=0.98, densities=(0.25, 0.6), least=100, **settings)
    got = sorted(got.select("chrom", "sidx", "eidx", "fdr", "scale", "intensity").collect())
    want = sorted(want)
    assert [tuple(x)[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([tuple(x)[3:] for x in got], [x[3:] for x in want], atol=1.1e-5) and len(want) > 8


def test_lines_of_few_known_loops(spark):
    known = spark.createDataFrame([("a", 5.0, 0.2, 1.0), ("b", 1.0, 0.2, 1.0), ("d", 4.0, 0.1, 1.0), ("d", 4.0, 0.3, 2.0)], "chrom string, intensity double, fdr double, scale double")
    rows = spark.createDataFrame([("a", 4.0), ("a", 9.0), ("b", 4.0), ("c", 4.0), ("d", 3.0)], "chrom string, intensity double")
    got = {(x.chrom, x.intensity): (x.fdr, x.scale) for x in loops.regress_fdr(rows, known).collect()}
    assert got == {("a", 4.0): (0.2, 1.0), ("a", 9.0): (0.2, 1.0), ("b", 4.0): (0.01, 0.6155), ("c", 4.0): (0.00001, 0.6155), ("d", 3.0): (0.2, 1.5)}


@pytest.mark.parametrize("n", [3, 4, 7, 60, 200])
def test_spline_equals_the_dense_solve(n):
    r = np.random.default_rng(n)
    y = np.exp(-np.arange(n) / 20) + 0.3 * r.random(n)
    q = np.diff(np.eye(n), 2, axis=0).T
    inner = np.diag(np.full(n - 2, 2 / 3)) + np.diag(np.full(n - 3, 1 / 6), 1) + np.diag(np.full(n - 3, 1 / 6), -1)
    for residual in (0.05 * n / 200, y.min() ** 2, 1e9, 0.0):
        f = smoothed(y, residual)
        miss = ((y - f) ** 2).sum()
        if residual in (0.0, 1e9):
            assert np.allclose(f, y if not residual else np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n)))
            continue
        assert miss <= residual * (1 + 1e-6)
        if miss > 0.999 * residual:  # else the line is near enough
            low, high = -30.0, 40.0
            for _ in range(120):
                w = np.exp((low + high) / 2)
                g = y - w * q @ np.linalg.solve(inner + w * q.T @ q, q.T @ y)
                low, high = (low, (low + high) / 2) if ((y - g) ** 2).sum() > residual else ((low + high) / 2, high)
            assert np.allclose(f, g, atol=1e-6)


def test_region_map_divides_by_the_fit(spark):
    r = np.random.default_rng(8)
    rows = [("c", i, j, float(r.integers(1, 9))) for i in range(40) for j in range(i, min(40, i + 25)) if r.random() < 0.8]
    pixels = spark.createDataFrame(rows, PIXELS)
    runs = spark.createDataFrame([("c", 0, 9), ("c", 12, 20), ("c", 21, 39)], "chrom string, first long, last long")
    got = {(x.block1, x.block2): x["mean"] for x in pipelines.region_map(pixels, runs, 12).collect()}
    whole, before, masses = sum(x[3] for x in rows), 0.0, {}
    for row in sorted(rows, key=lambda x: (x[2] - x[1], x[1])):
        masses.setdefault(min(11, int(before * 12 // whole)), []).append(row)
        before += row[3]
    means = [np.mean([x[3] for x in masses[k]]) for k in sorted(masses)]
    fit = dict(zip(sorted(masses), smoothed(np.array(means), min(means) ** 2), strict=True))
    blocks = {i: b for b, (lo, hi) in enumerate([(0, 9), (12, 20), (21, 39)]) for i in range(lo, hi + 1)}
    want = {}
    for k, own in masses.items():
        for _, i, j, v in own:
            if i in blocks and j in blocks:
                key = blocks[i], blocks[j]
                want[key] = want.get(key, 0.0) + v / fit[k]
    size = [10, 9, 19]
    assert got == {k: pytest.approx(v / (size[k[0]] * size[k[1]])) for k, v in want.items()}


def test_compositions_read_their_source_few_times(spark):
    """Scans of the two maps that are merged, counted where they are made."""
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        seen.add(1)
        yield from parts

    r = np.random.default_rng(1)
    rows = [("c", i, j, int(r.integers(1, 9))) for i in range(30) for j in range(i, 30) if r.random() < 0.7]
    m = spark.createDataFrame(rows, "chrom string, bin1_id long, bin2_id long, cnt long").coalesce(1).mapInPandas(counted, "chrom string, bin1_id long, bin2_id long, cnt long")
    sites = spark.range(30).select(F.col("id").alias("bin_id"), (F.col("id") % 3).alias("sites"))
    merged, weights = pipelines.merge_maps(m, m, sites)
    assert merged.count() and weights.count()
    assert seen.value <= 2
    bins = spark.range(30).selectExpr("'c' chrom", "id bin_id", "id * 5000 start", "id * 5000 + 5000 end", "1 nuc")
    assert pipelines.segment(m, bins, window=4).count() and seen.value <= 3
