"""Change points, greedy bins, meeting segments and tiled maps against plain walks."""

import math
import random
import time

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import segments
from tessera.plans import pipelines
from tessera.sources import formats


def points_by_hand(y):
    """The ends of segments, each chord's error summed anew."""
    steps = np.abs(np.diff(y)).mean()
    level = np.concatenate([[y[0]], y[0] + np.cumsum(np.diff(y) / steps)]) if steps > 0 else y
    points, i, n = [0], 0, len(y)
    while i < n - 1:
        best, j = -math.inf, i + 1
        while j < n:
            length = math.hypot(j - i, level[j] - level[i])
            inner = np.arange(i + 1, j)
            error = np.abs((level[j] - level[i]) * (inner - i) - (j - i) * (level[inner] - level[i])).sum() / length
            if length - error < best:
                break
            best, j = length - error, j + 1
        i = max(j - 1, i + 1)
        points.append(i)
    return points


def test_chord_errors_and_change_points():
    r = np.random.default_rng(1)
    for n in (2, 3, 60, 333):
        level = np.cumsum(r.normal(size=n))
        want = [np.abs((level[j] - level[0]) * np.arange(1, j) - j * (level[1:j] - level[0])).sum() / math.hypot(j, level[j] - level[0]) for j in range(1, n)]
        assert np.allclose(kernels.chord_errors(level), want)
    for seed in range(40):
        r = np.random.default_rng(seed)
        y = np.repeat(r.normal(size=12), r.integers(1, 40, 12)).cumsum() + (0.02 * r.normal(size=1)[0] if seed % 2 else 0)
        y = y + (0.3 * r.normal(size=len(y)) if seed % 3 else 0)
        got, points = kernels.change_points(y), points_by_hand(y)
        want = np.zeros(len(y), int)
        for k in range(1, len(points) - 1):
            p = points[k]
            want[p] = 1 if y[p] >= y[p - 1] and y[p] >= y[p + 1] else -1 if y[p] < y[p - 1] and y[p] < y[p + 1] else 0
        for a, b in zip(points[:-2], points[1:-1], strict=True):
            if b - a > 1:
                part = y[a + 1 : b]
                if part.min() < min(y[a], y[b]):
                    want[a + 1 + int(part.argmin())] = -1
                if part.max() > max(y[a], y[b]):
                    want[a + 1 + int(part.argmax())] = 1
        assert got.tolist() == want.tolist(), seed


def test_long_segments_are_quick():
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        kernels.change_points(np.arange(n) * 0.5)
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 0.5  # sixteen times as much if it were quadratic


@pytest.mark.parametrize("slack", [None, 0.5])
def test_greedy_bins_equal_the_walk(spark, slack):
    r = random.Random(3)
    rows = [(c, i, j, r.choice([1, 1, 2, 5, 40]) * (1 if c == "a" else 0.25)) for c in "ab" for i in range(30) for j in range(i, 30) if r.random() < 0.7] + [("c", 0, 0, 3.0)]
    want = {}
    for c in "abc":
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[2] - x[1], x[1]))
        target, held, now = sum(x[3] for x in own) / 7, 0.0, 0
        for x in own:
            want[x[:3]] = now
            held += x[3]
            if held >= target:
                held, now = 0.0, now + 1
    got = pipelines.greedy_mass_bins(spark.createDataFrame([(*x[:3], float(x[3])) for x in rows], "chrom string, bin1_id long, bin2_id long, cnt double"), 7, slack)
    assert {(x.chrom, x.bin1_id, x.bin2_id): x.mass_bin for x in got.collect()} == want and len(set(want.values())) > 4


def meeting_by_hand(rows, shift):
    rows = [list(x) for x in rows]
    n = len(rows)
    if n > 3:
        old = [x[:] for x in rows]
        for i, x in enumerate(rows):
            if x[2] != "domain" and i and old[i - 1][2] == "domain":
                x[0] = old[i - 1][1]
            if x[2] != "domain" and i + 1 < n and old[i + 1][2] == "domain":
                x[1] = old[i + 1][0]
        old = [x[:] for x in rows]
        for i in range(1, n):
            if old[i][0] != old[i - 1][1]:
                if rows[i][2] == "boundary":
                    rows[i - 1][1] = old[i][0]
                elif rows[i][2] == "gap":
                    rows[i][0] = old[i - 1][1]
        while True:
            starts = [min(rows[i - 1][1], rows[i][1]) if i else rows[i][0] for i in range(n)]
            starts[0] = min(rows[0][0], rows[0][1])
            if starts == [x[0] for x in rows]:
                break
            for x, s in zip(rows, starts, strict=True):
                x[0] = s
    marks = [x[2] == "boundary" for x in rows]
    return [(s - shift * (marks[i] or (i > 0 and marks[i - 1])), e - shift * (marks[i] or (i + 1 < n and marks[i + 1])), t) for i, (s, e, t) in enumerate(rows)]


@pytest.mark.parametrize("shift", [0, 150])
def test_segments_are_made_to_meet(spark, shift):
    r = random.Random(shift)
    rows = {}
    for c in range(12):
        at, own = 0, []
        for _ in range(r.choice([2, 5, 30])):
            n = r.randrange(100, 2000)
            own.append((at, at + n, r.choice(["domain", "gap", "boundary"])))
            at += n + r.choice([0, 0, 40, 300])
        rows[f"c{c}"] = own
    got = {c: [] for c in rows}
    made = segments.make_consecutive(spark.createDataFrame([(c, *x) for c, own in rows.items() for x in own], "chrom string, start long, end long, tag string"), shift)
    for x in made.collect():
        got[x.chrom].append((x.start, x.end, x.tag))
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(meeting_by_hand(own, shift)) for c, own in rows.items()}


def files_read(df):
    """Files of the scan of pixels, from its own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numFiles").get().value()


def test_a_region_reads_the_files_that_it_touches(spark, tmp_path):
    r = random.Random(2)
    pixels = [(c, i, j, r.randrange(1, 9)) for c in "ab" for i in range(0, 400, 3) for j in range(i, 400, 5) if r.random() < 0.5]
    bins = spark.createDataFrame([(c, i, 0.5 + i / 400) for c in "ab" for i in range(400)], "chrom string, bin_id long, weight double")
    formats.write_tiles(bins, spark.createDataFrame(pixels, "chrom string, bin1_id long, bin2_id long, cnt long"), str(tmp_path / "m"), side=50)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = []
        for first, last in ((0, 49), (60, 180), (0, 399)):
            own, got = formats.read_region(spark, str(tmp_path / "m"), "a", first, last, side=50)
            assert sorted(map(tuple, got.select("chrom", "bin1_id", "bin2_id", "cnt").collect())) == sorted(x for x in pixels if x[0] == "a" and first <= x[1] and x[2] <= last)
            assert own.count() == last - first + 1
            read.append(files_read(got))
        assert read[0] == 1 and read[0] < read[1] < read[2] and read[1] <= 9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    weighted = formats.read_region(spark, str(tmp_path / "m"), "a", 60, 180, side=50, balanced=True)[1]
    want = {x[1:3]: x[3] * (0.5 + x[1] / 400) * (0.5 + x[2] / 400) for x in pixels if x[0] == "a" and 60 <= x[1] and x[2] <= 180}
    assert {(x.bin1_id, x.bin2_id): x.cnt for x in weighted.collect()} == {k: pytest.approx(v) for k, v in want.items()}
