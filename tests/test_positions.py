"""Positions of peaks against a walk over the slots of each chromosome."""

import math
import random

import numpy as np

from tessera.operators import positions, signal
from tessera.operators.scans import carried

L = positions.Limits()


def curve(raw, sigma, derivative):
    w = dict(signal.gaussian(sigma, derivative))
    return [round(sum(raw[x - o] * w[o] for o in w if 0 <= x - o < len(raw)), positions.PLACES) + 0.0 for x in range(len(raw))]


def walk_peaks(slope):
    """[begin, top left, top right, end] by going up and down."""
    out, begin, top, state, zeros, last_down = [], None, None, 0, 0, None
    for t in range(1, len(slope)):
        if slope[t] > 0:
            if state == -1:
                if begin is not None and top:
                    out.append([begin, *top, last_down])
                begin, top = t, None
            elif state == 0:
                begin = t
            state, zeros = 1, 0
        elif slope[t] < 0:
            if state == 1:
                top = (t - zeros, t - zeros) if zeros else (t - 1, t)
            state, zeros, last_down = -1, 0, t
        else:
            zeros += 1
    if state == -1 and begin is not None and top:
        out.append([begin, *top, last_down])
    return out


def walk_pairs(bend):
    out, begin = [], None
    for t in range(1, len(bend)):
        if bend[t] < 0 and begin is None:
            begin = t
        elif bend[t] > 0 and begin is not None:
            out.append((begin, t - 1))
            begin = None
    return out


def walk_middles(third):
    out, down, zeros = [], False, 0
    for t in range(1, len(third)):
        if third[t] > 0:
            if down:
                out.append((t - max(1, zeros), t))
            down, zeros = False, 0
        elif third[t] < 0:
            down, zeros = True, 0
        else:
            zeros += 1
    return out


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return (sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) + 1e-8) / math.sqrt((sum((a - mx) ** 2 for a in x) + 1e-8) * (sum((b - my) ** 2 for b in y) + 1e-8))


def concavity(y):
    low, k = min(y), (y[-1] - y[0]) / len(y)
    return (sum(v - low for v in y) + 1e-7) / (sum(y[0] + i * k - low for i in range(len(y))) + 1e-7)


def called(raw, filtered=True):
    smooth, bend = curve(raw, 3, 0), curve(raw, 3, 2)
    peaks, mids, fine = walk_peaks(curve(raw, 3, 1)), walk_middles(curve(raw, 3, 3)), walk_pairs(curve(raw, 1, 2))
    top = lambda v, a, b: max(v[a : b + 1])
    mains, shoulders = {}, {}
    for a, b in walk_pairs(bend):
        own = [i for i, p in enumerate(peaks) if p[0] <= b and p[3] >= a]
        if len(own) == 1 and a >= peaks[own[0]][0] and b <= peaks[own[0]][3]:
            if a <= peaks[own[0]][1] <= b or a <= peaks[own[0]][2] <= b:
                mains[own[0]] = (a, b)
            else:
                shoulders.setdefault(own[0], []).append((a, b))
    rows = []  # first, last, kind, peak
    for i, main in mains.items():
        chain = sorted([main, *shoulders.get(i, [])])
        at = chain.index(main)

        def belongs(s, n):
            (a, b), (c, d) = chain[s], chain[n]
            spots = {x for m in mids if m[0] <= b and m[1] >= a for x in m} or {a, b}
            pieces = [(x, c - 1) if s < n else (d + 1, x) for x in spots]
            r, v = min(pearson(raw[f : z + 1], smooth[f : z + 1]) for f, z in pieces), max(concavity(smooth[f : z + 1]) for f, z in pieces)
            gap = c - b if s < n else a - d
            share = top(raw, a, b) / top(raw, c, d) if top(raw, c, d) > 0 else 0
            return any(r > x and v > y and gap < far and share >= z for x, y, far, z in L.together)

        groups = [[0]]
        for k in range(1, len(chain)):
            joined = belongs(k - 1, k) if k <= at else belongs(k, k - 1)
            if joined:
                groups[-1].append(k)
            else:
                groups.append([k])
        for g in groups:
            kind = ("integrated" if len(g) > 1 else "main") if at in g else "shoulder"
            rows.append([chain[g[0]][0], chain[g[-1]][1], kind, i])
    rows.sort()
    before = [r[:] for r in rows]

    def middle(r, right):
        return (r[0] + r[1]) / 2 if r[2] == "shoulder" else peaks[r[3]][1 if right else 2]

    def pulled(me, other, left):
        lo, hi = (other, me) if left else (me, other)
        high = top(raw, *other[:2]) >= top(raw, *me[:2]) and top(smooth, *other[:2]) >= top(smooth, *me[:2])
        return high and hi[0] - lo[1] <= L.border_gap and middle(hi, True) - middle(lo, False) <= L.border_middles

    last_main = max(mains, default=-1)
    for j, me in enumerate(before):
        i = me[3]
        near = [i, i + 1] if i == 0 else [i - 1, i, i + 1] if i < last_main else [i - 1, i]
        cand = sorted({f for f in fine for n in near if n < len(peaks) and f[0] <= peaks[n][3] and f[1] >= peaks[n][0]})
        if j + 1 < len(before) and pulled(me, before[j + 1], False):
            rows[j][1] = max([f[1] for f in cand[:-1] if me[1] < f[1] < (me[1] + before[j + 1][0]) / 2], default=me[1])
        if j and pulled(me, before[j - 1], True):
            rows[j][0] = min([f[0] for f in cand[1:] if (rows[j - 1][1] + me[0]) / 2 < f[0] < me[0]], default=me[0])
    if filtered:
        n = len(rows)
        joins, depth, gaps = [False] * n, [None] * n, [None] * n
        for j in range(n - 1):
            (a, b, *_), (c, d, *_) = rows[j], rows[j + 1]
            gaps[j], depth[j] = 10 * (c - b), min(smooth[b + 1 : c])
            if 5 * (c + d - a - b) < L.twin_middles:
                h = sorted([top(raw, a, b), top(raw, c, d)])
                ratio, share = (h[0] / h[1] if h[1] else 0), 2 * depth[j] / (top(smooth, a, b) + top(smooth, c, d))
                rules = [L.twins_low if h[1] < L.twin_low else L.twins_high, *L.twins]
                joins[j] = any(ratio > x and gaps[j] <= y and share > z for x, y, z in rules)
        go = []
        for j in range(n):
            right, left = joins[j], j > 0 and joins[j - 1]
            if right and left:
                one, two = (-depth[j], gaps[j]), (-depth[j - 1], gaps[j - 1])
                go.append(1 if one < two else -1 if one > two else 0)
            else:
                go.append(1 if right else -1 if left else 0)
        out, j = [], 0
        while j < n:
            if j + 1 < n and go[j] == 1 and go[j + 1] == -1:
                main = rows[j][2] != "shoulder" or rows[j + 1][2] != "shoulder"
                out.append([rows[j][0], rows[j + 1][1], "twin_main" if main else "twin_shoulder"])
                j += 2
            else:
                out.append(rows[j][:3])
                j += 1
        rows = []
        for a, b, kind in out:
            part, bent, most = bend[a : b + 1], 0, 0
            for v in part:
                bent = bent + 1 if v < 0 else 0
                most = max(most, bent)
            mean, area = sum(part) / len(part), sum(raw[a : b + 1])
            noise = area < L.noise_area[0] and most <= L.noise_area[1] and mean > L.noise_area[2] or len(part) <= L.noise_slots[0] and mean > L.noise_slots[1]
            noise = noise or top(raw, a, b) <= L.noise_height[0] and mean > L.noise_height[1] or any(most <= x and mean > y for x, y in L.noise_bent)
            if not noise:
                rows.append([a, b, kind])
    return [(a, b, top(raw, a, b), sum(raw[a : b + 1]), positions.PROPERTIES[kind]) for a, b, kind, *_ in rows]


def tracks():
    """Peaks of many shapes, distances and heights, with noise, empty stretches, plateaus and twins."""
    r = random.Random(4)
    out = {}
    for c in range(14):
        n = r.choice([60, 300, 700])
        raw = [0.0] * n
        at = r.randrange(15)
        while at < n:
            height, width = r.choice([1, 3, 6, 20]) * (1 + r.random()), r.choice([2, 4, 6])
            for k in range(max(0, at - 20), min(n, at + 21)):
                raw[k] += height * math.exp(-(((k - at) / width) ** 2))
            at += r.choice([5, 7, 8, 9, 11, 12, 14, 16, 20, 45])
        noise = r.choice([0, 0.3, 1.5])
        out[f"c{c}"] = [float(round(max(0.0, v + noise * (r.random() - 0.5)), 1 if c % 3 else 0)) for v in raw]
    out["flat"] = [2.0] * 40
    out["one"] = [5.0]
    return out


def test_positions_equal_the_walk(spark):
    every = tracks()
    first = {c: 7 * k for k, c in enumerate(every)}  # a chromosome may begin anywhere
    rows = spark.createDataFrame([(c, first[c] + i, v) for c, t in every.items() for i, v in enumerate(t) if v or i in (0, len(t) - 1)], "chrom string, slot long, raw double")
    kinds = set()
    for filtered in (False, True):
        got = {c: [] for c in every}
        for x in positions.precise(rows, filtered=filtered).orderBy("chrom", "first").collect():
            got[x.chrom].append((x["first"] - first[x.chrom], x["last"] - first[x.chrom], round(x.height, 6), round(x.area, 6), x.property))
            kinds.add(x.property)
        want = {c: [(a, b, round(h, 6), round(s, 6), p) for a, b, h, s, p in called(t, filtered)] for c, t in every.items()}
        assert got == want
    assert kinds >= set(positions.PROPERTIES.values()) - {"Shoulder:doublet"}
    assert positions.precise(rows.where("false")).count() == 0


def test_scans_equal_plain_windows_on_one_hot_part(spark):
    """Nearly all rows in one part, in ranges far narrower than it; no window holds a part."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    rows = [("hot" if k % 40 else "cold", int(i), None if r.random() < 0.5 else int(r.integers(0, 100))) for k, i in enumerate(np.cumsum(r.integers(1, 5, 3000)))]
    df = spark.createDataFrame(rows, "c string, i long, v long")
    v, w = F.col("v"), Window.partitionBy("c").orderBy("i")
    upto, behind, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    got = carried(df, ["c"], ["i"], sums={"s": v, "n": F.lit(1)}, before={"b": v}, after={"a": v}, most={"m": v}, latest={"l": v}, coming={"k": v}, width=64)
    want = df.withColumns({"s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "n": F.row_number().over(w).cast("long"), "b": F.lag("v").over(w), "a": F.lead("v").over(w), "m": F.max("v").over(behind), "l": F.last("v", True).over(upto), "k": F.first("v", True).over(on)})
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    sizes = df.groupBy("c", F.floor(F.col("i") / 64)).count().agg(F.max("count")).head()[0]
    assert sizes <= 64 and df.count() == 3000
    swapped = carried(df, ["c"], ["i"], before={"v": v}, width=64)  # a new column may take the old one's name
    assert sorted(map(repr, swapped.select("c", "i", "v").collect())) == sorted(map(repr, want.select("c", "i", F.col("b").alias("v")).collect()))
