"""Numeric kernels that are sequential or iterative by nature, in numpy; the wrappers run them on one chromosome, region or tile a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, by hooking and shortcutting."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def balance(i: np.ndarray, j: np.ndarray, v: np.ndarray, target: np.ndarray, tolerance: float = 1e-8, most: int = 1500) -> np.ndarray:
    """x > 0 with x * (A x) = target for the symmetric A whose upper triangle is (i, j, v); rows without entries keep 1.

    Newton's method on the logarithm of x, solved by conjugate gradients: with s = x * (A x), the step d solves (diag(s) + X A X) d = target - s; the step is cut so that no factor
    changes by more than a third of its order. A little of the identity keeps components without a diagonal solvable."""
    n = len(target)
    off = i != j
    rows, cols, vals = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([v, v[off]]).astype(float)
    held = np.bincount(rows, vals, n) > 0
    x, goal = np.ones(n), np.where(held, target, 0.0).astype(float)
    times = lambda y: np.bincount(rows, vals * y[cols], n) + np.finfo(np.float32).eps * y
    first = times(x)
    x[held] = np.sqrt(goal[held].clip(1e-12) / first[held])
    left = most
    while left > 0:
        s = x * times(x)
        miss = np.where(held, goal - s, 0.0)
        if np.sqrt((miss**2).sum()) <= tolerance * max(1.0, np.sqrt((goal**2).sum())):
            break
        d, r = np.zeros(n), miss.copy()
        diag = np.where(held, 2 * s, 1.0)
        z = r / diag
        p, rz = z.copy(), float(r @ z)
        stop = 0.01 * float(r @ r)
        for _ in range(200):
            left -= 1
            q = np.where(held, s * p + x * times(x * p), 0.0)
            if (curve := float(p @ q)) <= 0:
                break
            step = rz / curve
            d += step * p
            r -= step * q
            if float(r @ r) <= stop or left <= 0:
                break
            z = r / diag
            rz, old = float(r @ z), rz
            p = z + rz / old * p
        x = np.where(held, x * np.exp(np.clip(d, -1.0, 1.0)), 1.0)
    return x


def _apart(rows: DataFrame) -> DataFrame:
    """The same rows with columns of their own, for a cogroup of tables that come from one."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def balance_alone(pixels: DataFrame, want: DataFrame) -> DataFrame:
    """chrom, bin_id, bias by balance(), a chromosome a task; want: chrom, bin_id, target of all bins with pixels."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = right.bin_id.to_numpy()
        order = np.argsort(ids)
        ids, goal = ids[order], right.target.to_numpy()[order]
        i, j = np.searchsorted(ids, left.bin1_id), np.searchsorted(ids, left.bin2_id)
        x = balance(i, j, left.cnt.to_numpy(float), goal)
        return pd.DataFrame({"chrom": right.chrom.iloc[0] if len(right) else None, "bin_id": ids, "bias": x})

    return pixels.groupBy("chrom").cogroup(_apart(want).groupBy("chrom")).applyInPandas(run, "chrom string, bin_id bigint, bias double")


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.6, rounds: int = 3, delta: float = 0.01) -> np.ndarray:
    """Local linear fit with tricube weights over the nearest share of points and bisquare robustness; fitted at points more than delta of the range apart and drawn as lines between."""
    n = len(x)
    if n < 3:
        return y.astype(float).copy()
    order = np.argsort(x, kind="stable")
    xs, ys = x[order].astype(float), y[order].astype(float)
    k = max(2, min(n, int(share * n + 1e-10)))
    anchors, at = [0], 0
    step = delta * (xs[-1] - xs[0])
    while at < n - 1:
        at = max(at + 1, int(np.searchsorted(xs, xs[at] + step, "right")) - 1)
        anchors.append(at)
    anchors = np.unique(anchors)
    robust, fit = np.ones(n), np.zeros(n)
    for _ in range(rounds + 1):
        values = np.zeros(len(anchors))
        for m, a in enumerate(anchors):
            lo = max(0, min(a - k // 2, n - k))
            while lo > 0 and xs[a] - xs[lo - 1] < xs[lo + k - 1] - xs[a]:
                lo -= 1
            while lo + k < n and xs[lo + k] - xs[a] < xs[a] - xs[lo]:
                lo += 1
            part = slice(lo, lo + k)
            d = np.abs(xs[part] - xs[a])
            far = d.max()
            w = robust[part] * ((1 - (d / far).clip(0, 1) ** 3) ** 3 if far > 0 else 1.0)
            if w.sum() <= 0:
                values[m] = ys[a]
                continue
            mean = (w * xs[part]).sum() / w.sum()
            spread = (w * (xs[part] - mean) ** 2).sum()
            level = (w * ys[part]).sum() / w.sum()
            slope = (w * (xs[part] - mean) * ys[part]).sum() / spread if spread > 1e-12 * max(1.0, (xs[-1] - xs[0]) ** 2) else 0.0
            values[m] = level + slope * (xs[a] - mean)
        fit = np.interp(xs, xs[anchors], values)
        miss = np.abs(ys - fit)
        scale = 6 * np.median(miss)
        robust = (1 - (miss / scale).clip(0, 1) ** 2) ** 2 if scale > 0 else np.ones(n)
    out = np.zeros(n)
    out[order] = fit
    return out


def normalise_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tracks brought together: log2(x + 1) less its lowess against their mean; zeros stay, and what isn't finite is 0."""
    la, lb = np.log2(a + 1.0), np.log2(b + 1.0)
    mean = (la + lb) / 2
    out = []
    for own, raw in ((la, a), (lb, b)):
        back = np.abs(2 ** (own - lowess(mean, own - mean)) - 1)
        out.append(np.where((raw == 0) | ~np.isfinite(back), 0.0, back))
    return out[0], out[1]


def outlying(x: np.ndarray, threshold: float = 5.0) -> np.ndarray:
    """Whether the modified z-score of each value is above threshold, as in stats.outliers: zeros are left out and are none, and there is none where the deviation is 0."""
    own = x[x != 0]
    if not len(own):
        return np.zeros(len(x), bool)
    far = np.abs(x - np.median(own))
    mad = np.median(far[x != 0])
    return (x != 0) & (0.6745 * far > threshold * mad) if mad > 0 else np.zeros(len(x), bool)


def normalise_marginals(rows: DataFrame) -> DataFrame:
    """chrom, bin_id, norm_a, norm_b from marginals a and b and sites: groups of equal numbers of sites are strong or weak by the slope of b on a without outliers, and each kind is normalised apart.

    Bins without sites are in no group: the coefficients (norm + 1) / (raw + 1) of the others are interpolated over them by row. All coefficients are then applied to the raw marginals.
    A chromosome without any bin that has sites is an error."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin_id")
        raw = [part[c].to_numpy(float) for c in "ab"]
        anchors = part.sites.to_numpy() != 0
        if not anchors.any():
            raise ValueError(f"chromosome {part.chrom.iloc[0]}: no bin with contacts has a site")
        kind = np.where(anchors, "strong", "none").astype(object)
        for sites, at in part.groupby("sites").indices.items():
            x, y = (r[at] for r in raw)
            if not sites or len(at) < 2 or not x.sum() or not y.sum():
                continue
            usual = ~(outlying(x) | outlying(y))
            x, y = x[usual], y[usual]
            if len(x) < 2:
                continue
            if x.std() < 1e-10:
                kind[at] = "strong" if y.sum() > x.sum() else "weak"
            elif abs(np.polyfit(x, y, 1)[0]) < 0.5:
                kind[at] = "weak"
        norm = [np.zeros(len(part)), np.zeros(len(part))]
        for k in ("strong", "weak"):
            if (m := kind == k).any():
                norm[0][m], norm[1][m] = normalise_pair(raw[0][m], raw[1][m])
        out, places = [], np.arange(len(part))
        for r, v in zip(raw, norm, strict=True):
            factor = np.interp(places, places[anchors], (v[anchors] + 1) / (r[anchors] + 1))
            new = factor * (r + 1) - 1
            out.append(np.where(r == 0, 0.0, np.abs(np.where(new == 0, factor, new))))
        return pd.DataFrame({"chrom": part.chrom, "bin_id": part.bin_id, "norm_a": out[0], "norm_b": out[1]})

    return rows.where("a <> 0 or b <> 0").groupBy("chrom").applyInPandas(run, "chrom string, bin_id bigint, norm_a double, norm_b double")


def _weighted_misses(slope: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    """Add to out[j] the sum over k < j of weight[k] * |slope[j] - slope[k]|: halves are sorted and summed up once, for all of the other half."""
    n = len(slope)
    if n <= 48:
        miss = np.abs(slope[:, None] - slope[None]) * weight[None]
        out += np.tril(miss, -1).sum(axis=1)
        return
    m = n // 2
    _weighted_misses(slope[:m], weight[:m], out[:m])
    _weighted_misses(slope[m:], weight[m:], out[m:])
    order = np.argsort(slope[:m], kind="stable")
    s, w = slope[:m][order], weight[:m][order]
    sums, moments = np.concatenate([[0.0], np.cumsum(w)]), np.concatenate([[0.0], np.cumsum(w * s)])
    at = np.searchsorted(s, slope[m:])
    x = slope[m:]
    out[m:] += x * (2 * sums[at] - sums[-1]) - (2 * moments[at] - moments[-1])


def chord_errors(level: np.ndarray) -> np.ndarray:
    """For each j from 1 the summed distance of the points between 0 and j from the chord between these: |slope of the chord - slope from 0 to the point| times the point's and the chord's width, by the chord's length."""
    k = np.arange(1, len(level))
    rise = level[1:] - level[0]
    slope, out = rise / k, np.zeros(len(k))
    _weighted_misses(slope, k.astype(float), out)
    return out * k / np.hypot(k, rise)


def change_points(y: np.ndarray) -> np.ndarray:
    """-1 at local minima, 1 at local maxima and 0 elsewhere, at the ends of the straight segments that a track is made of.

    A segment goes on as long as its chord's length less the distances of the points from it grows. Errors of 32 chords, then of twice as many, are computed together, so a segment of n points takes n log^2 n steps."""
    y = np.nan_to_num(np.asarray(y, float))
    n, out = len(y), np.zeros(len(y), int)
    if n <= 3:
        if n:
            out[int(y.argmin())], out[int(y.argmax())] = -1, 1
        return out
    steps = np.abs(np.diff(y)).mean()
    level = np.concatenate([[y[0]], y[0] + np.cumsum(np.diff(y) / steps)]) if steps > 0 else y
    points, i = [0], 0
    while i < n - 1:
        ahead = 32
        while True:
            part = level[i : i + ahead + 1]
            gain = np.hypot(np.arange(1, len(part)), part[1:] - part[0]) - chord_errors(part)
            falls = np.flatnonzero(gain[1:] < gain[:-1])
            if len(falls) or i + ahead + 1 >= n:
                break
            ahead *= 2
        i = i + 1 + (int(falls[0]) if len(falls) else len(gain) - 1)
        points.append(i)
    for k in range(1, len(points) - 1):
        p = points[k]
        if y[p] >= y[p - 1] and y[p] >= y[p + 1]:
            out[p] = 1
        elif y[p] < y[p - 1] and y[p] < y[p + 1]:
            out[p] = -1
    for a, b in zip(points[:-2], points[1:-1], strict=True):  # not into the last segment
        if b - a > 1:
            part = y[a + 1 : b]
            if part.min() < min(y[a], y[b]):
                out[a + 1 + int(part.argmin())] = -1
            if part.max() > max(y[a], y[b]):
                out[a + 1 + int(part.argmax())] = 1
    return out


def mann_whitney_less(x: np.ndarray, y: np.ndarray) -> float:
    """One-sided p-value of x being smaller than y: exact without ties up to 8 values, else by the normal approximation with corrections for ties and continuity; 1 where it isn't defined."""
    n, m = len(x), len(y)
    if not n or not m:
        return 1.0
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    ranks = np.zeros(n + m)
    values, first, count = np.unique(both[order], return_index=True, return_counts=True)
    ranks[order] = np.repeat(first + (count + 1) / 2, count)
    u = ranks[:n].sum() - n * (n + 1) / 2
    if min(n, m) <= 8 and len(values) == n + m:
        ways = np.zeros((n + 1, n * m + 1))  # ways[k, s]: k of the x so far, with s pairs in which an x is above a y
        ways[0, 0] = 1
        for total in range(1, n + m + 1):
            for k in range(min(n, total), 0, -1):
                above = total - k
                if above <= m:
                    moved = np.zeros(n * m + 1)
                    if above <= n * m:
                        moved[above:] = ways[k - 1, : n * m + 1 - above]
                    ways[k] = ways[k] + moved
        return float(min(1.0, ways[n, : int(u) + 1].sum() / ways[n].sum()))
    var = n * m / 12 * (n + m + 1 - (count**3 - count).sum() / ((n + m) * (n + m - 1)))
    if var <= 0:
        return 1.0
    return 0.5 * math.erfc(-(u - n * m / 2 + 0.5) / math.sqrt(2 * var))


def domain_p_values(band: np.ndarray, window: int) -> np.ndarray:
    """p of each bin but the last: the diamond between a bin's sides against the triangles on both sides, zeros of the triangles left out. band: [i, k] is the cell (i, i + k), k < 2 * window."""
    n = len(band)
    out = np.ones(n)
    for i in range(1, n):
        low, high = max(0, i - window), min(n, i + window)
        rows, columns = np.arange(low, high)[:, None], np.arange(low, high)[None]
        k = columns - rows
        cells = band[rows, k.clip(0, 2 * window - 1)]
        side = cells[(k >= 1) & ((columns < i) | (rows >= i))]
        diamond = cells[(rows >= max(1, i - window + 1)) & (rows <= i) & (columns >= i) & (k < 2 * window)]
        out[i - 1] = mann_whitney_less(diamond, side[side != 0])
    return out


def greedy_gaps(first_column: np.ndarray) -> np.ndarray:
    """Whether each bin lies in a gap: from each bin to the smallest first column of the rows from there on, jumping over what was marked."""
    n = len(first_column)
    ahead = np.minimum.accumulate(first_column[::-1])[::-1]
    out, i = np.zeros(n, bool), 0
    while i < n:
        to = int(ahead[i])
        if to - 1 >= i + 1:
            out[i : min(to, n)] = True
            i = to
        else:
            i += 1
    return out


def kde(values: np.ndarray, points: int = 200, cut: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Grid and density of a Gaussian kernel estimate with Scott's bandwidth."""
    values = np.asarray(values, float)
    width = values.std(ddof=1) * len(values) ** (-1 / 5) if len(values) > 1 else 0.0
    if not width:
        width = 1.0
    grid = np.linspace(values.min() - cut * width, values.max() + cut * width, points)
    density = np.zeros(points)
    for at in range(0, len(values), 4096):
        density += np.exp(-0.5 * ((grid[:, None] - values[None, at : at + 4096]) / width) ** 2).sum(axis=1)
    return grid, density / (len(values) * width * math.sqrt(2 * math.pi))


def kde_cut(values: np.ndarray) -> float:
    """The place right of the mode that is farthest below the line from the mode to the end (the elbow)."""
    grid, density = kde(values)
    top = int(density.argmax())
    x = np.linspace(0, 1, len(grid) - top)
    y = density[top:] / density[top]
    return float(grid[top + int((1 - x - y + y[-1] * x).argmax())])


def density(values: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Grid and density of kde() for a column v; None without rows. Each task sums up its rows' share on the grid."""
    held = values.where("v is not null and not isnan(v)")
    n, low, high, spread = held.agg(F.count("*"), F.min("v"), F.max("v"), F.stddev_samp("v")).first()
    if not n:
        return None
    width = (spread or 0.0) * n ** (-1 / 5) or 1.0
    grid = np.linspace(low - 3 * width, high + 3 * width, 200)

    def run(parts):
        total = np.zeros(len(grid))
        for part in parts:
            v = part.v.to_numpy()
            for at in range(0, len(v), 4096):
                total += np.exp(-0.5 * ((grid[:, None] - v[None, at : at + 4096]) / width) ** 2).sum(axis=1)
        yield pd.DataFrame({"at": np.arange(len(grid)), "d": total})

    summed = held.mapInPandas(run, "at int, d double").groupBy("at").agg(F.sum("d").alias("d")).orderBy("at").collect()  # a row for each place of the grid
    return grid, np.array([r.d for r in summed]) / (n * width * math.sqrt(2 * math.pi))


def area_cut(rows: DataFrame, value: str) -> float | None:
    """Where the density of the logarithms of a positive column first reaches 3/4 of its peak; None without rows."""
    found = density(rows.where(F.col(value) > 0).select(F.log2(F.col(value).cast("double")).alias("v")))
    if found is None:
        return None
    grid, d = found
    return float(2 ** grid[min(int((d >= 0.75 * d.max()).argmax()), len(grid) - 2)])


def largest_over(start: np.ndarray, end: np.ndarray, begin: np.ndarray, stop: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals [start, end) the largest value of those [begin, stop) that overlap them, and whether there is one. In n log n: tables of the largest of 1, 2, 4, ... neighbours serve the ranges.

    What overlaps begins inside, or reaches over the start: the first are a range of the sorted begins, and each of the second holds a range of the sorted starts."""
    out, hit = np.full(len(start), -np.inf), np.zeros(len(start), bool)
    if not len(start) or not len(begin):
        return out, hit
    level = lambda n: np.maximum(np.frexp(np.maximum(n, 1))[1] - 1, 0)  # noqa: E731  the largest k with 2^k <= n
    order = np.argsort(begin, kind="stable")
    begins = begin[order]
    i, j = np.searchsorted(begins, start), np.searchsorted(begins, end)
    inside, row = level(j - i), value[order].astype(float)
    for k in range(int(inside.max()) + 1):
        at = np.flatnonzero((inside == k) & (i < j))
        out[at] = np.maximum(row[i[at]], row[j[at] - (1 << k)])
        row = np.maximum(row[: -(1 << k)], row[1 << k :])
    hit |= i < j
    starts, back = np.unique(start, return_inverse=True)
    i, j = np.searchsorted(starts, begin, side="right"), np.searchsorted(starts, stop)
    some = i < j
    i, j, v = i[some], j[some], value[some].astype(float)
    over, deep = level(j - i), np.full(len(starts), -np.inf)
    for k in range(int(over.max()) if len(over) else -1, -1, -1):
        at = over == k
        np.maximum.at(deep, i[at], v[at])
        np.maximum.at(deep, j[at] - (1 << k), v[at])
        if k:  # what holds for 2^k neighbours holds for both halves
            half = 1 << (k - 1)
            deep[half:] = np.maximum(deep[half:], deep[:-half].copy())
    covered = np.cumsum(np.bincount(i, minlength=len(starts) + 1) - np.bincount(j, minlength=len(starts) + 1))[:-1] > 0
    return np.maximum(out, deep[back]), hit | covered[back]


def signal_cut(rows: DataFrame, value: str, least_density: float, least: int = 10) -> float:
    """The place on the density's grid, as a number from 0 to 199, behind the peak where it falls to least_density, `least` at least; infinite without rows, and the last place where it doesn't fall so far.

    It is the grid's index that signals are held against, not the signal there: so the described tool does, whose cutoffs this is to give."""
    found = density(rows.select(F.col(value).cast("double").alias("v")))
    if found is None:
        return math.inf
    _, d = found
    behind = np.flatnonzero(d <= least_density)
    behind = behind[behind > int(d.argmax())]
    return float(max(behind[0] if len(behind) else len(d) - 1, least))


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian; edges are reflected."""
    reach = max(1, int(math.ceil(2 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(a, [(reach, reach) if x == axis else (0, 0) for x in (0, 1)], mode="symmetric")
        a = sum(w * np.take(wide, np.arange(o, o + a.shape[axis]), axis) for o, w in enumerate(k))
    return a


def most_around(a: np.ndarray, reach: int = 2) -> np.ndarray:
    """The largest value in the square around each cell; 0 beyond the edges."""
    for axis in (0, 1):
        wide = np.pad(a, [(reach, reach) if x == axis else (0, 0) for x in (0, 1)])
        a = np.max([np.take(wide, np.arange(o, o + a.shape[axis]), axis) for o in range(2 * reach + 1)], axis=0)
    return a


def bh_values(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(0, 1)
    out = np.zeros(len(p))
    out[order] = q
    return out


def exponential_tail(v: np.ndarray) -> np.ndarray:
    """P(X > v) under the exponential distribution fitted to all of v: from the least value on, with the mean's distance from it."""
    spread = v.mean() - v.min()
    return np.exp(-(v - v.min()) / spread) if spread > 0 else np.ones(len(v))


def layers_of(work: np.ndarray, first: float, layers: int) -> list[tuple[np.ndarray, float]]:
    """Differences of Gaussians of rising width, each with the scale that a peak in it is given.

    The first two are at the widths' first steps; then comes an empty one, as the third width is smoothed twice, and so what is beside it is compared with zero."""
    width = lambda i: first * 2 ** ((i - 1) / layers)
    smooth = [blur(work, width(i)) for i in range(1, layers + 2)]
    apart = [x - y for x, y in zip(smooth[:-1], smooth[1:], strict=True)]
    rest = [(d, width(i + 1)) for i, d in enumerate(apart[2:], 3)]
    return [(apart[0], width(2)), (apart[1], width(3)), (np.zeros_like(work), 0.0), *rest]


def blobs(a: np.ndarray, limit: int | None = None, sigma: float = 0.5, octaves: int = 2, layers: int = 10, q_most: float = 0.1, dense: float = 0.25, dense_wide: float = 0.6, least: int = 10_000, reach: int = 2) -> list[tuple[int, int, float, float]]:
    """(row, column, q, scale) of blobs of a dense upper triangle, one a connected group.

    Cells with a contact from the second diagonal on are candidates; those up to that diagonal, and beyond `limit` diagonals, count as 2 on the map. A candidate is a peak in a layer where it is the largest around itself, larger than all around
    it in both neighbouring layers, and there is the largest in one of them, and larger than it was in any layer before. Its p is the tail of the exponential distribution fitted to all candidates of the layer, made q by Benjamini-Hochberg
    over the peaks. Of those with q below q_most enough cells around have to be filled, within the scale and twice that, out of the whole square (none, where it reaches over the upper or left edge), and the value must be above twice the
    mean of its diagonal. Peaks, each with the cells around it, that touch are a group, which gives its cell of the least q. Fewer than `least` candidates (50 at least) give none."""
    n = len(a)
    far = np.arange(n)[None] - np.arange(n)[:, None]
    stored = (a != 0) & (far >= 2)
    if stored.sum() < max(50, least):
        return []
    work = np.where(far <= 2, 2.0, a)
    if limit is not None:
        work = np.where(far > limit, 2.0, work)
    rows, columns = np.nonzero(stored)
    best, scale, p = np.zeros(len(rows)), np.ones(len(rows)), np.full(len(rows), 2.0)
    for octave in range(octaves):
        found = layers_of(work, sigma * 2**octave, layers)
        top = [most_around(d, reach) for d, _ in found]
        for i in range(1, len(found) - 1):
            v, own, before, behind = (x[stored] for x in (found[i][0], top[i], top[i - 1], top[i + 1]))
            at_top = (found[i - 1][0][stored] == before) | (found[i + 1][0][stored] == behind)
            peak = (v > best) & (v == own) & at_top & (v > before) & (v > behind)
            if peak.any():
                best[peak], scale[peak], p[peak] = v[peak], found[i][1], exponential_tail(np.abs(v))[peak]
    some = p != 2
    p[some] = bh_values(p[some])
    o, so = np.ones((n, n)), np.ones((n, n))
    o[stored], so[stored] = p, scale
    filled = np.pad(np.cumsum(np.cumsum(stored, axis=0), axis=1), ((1, 0), (1, 0)))

    def share(r: int, c: int, s: int) -> float:
        if r < s or c < s:
            return 0.0
        r1, c1 = min(n, r + s + 1), min(n, c + s + 1)
        return (filled[r1, c1] - filled[r - s, c1] - filled[r1, c - s] + filled[r - s, c - s]) / (2 * s + 1) ** 2

    means, marked = {}, np.zeros((n + 1, n + 1), bool)
    for r, c in zip(*np.nonzero(o < q_most), strict=True):
        s = int(math.ceil(so[r, c]))
        if not r or share(r, c, s) < dense or share(r, c, 2 * s) < dense_wide:
            continue
        if (k := c - r) not in means:
            d = np.diagonal(work, k)
            means[k] = d[d != 0].mean()
        if work[r, c] > 2 * means[k]:
            marked[r - 1 : r + 2, c - 1 : c + 2] = True
    x, y = np.nonzero(marked[:n, :n])
    if not len(x):
        return []
    number = np.full((n + 2, n + 2), -1)
    number[x + 1, y + 1] = np.arange(len(x))
    pairs = [(number[x + 1, y + 1], number[x + 1 + i, y + 1 + j]) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
    one, two = (np.concatenate(z) for z in zip(*pairs, strict=True))
    label = connected_labels(len(x), one[two >= 0], two[two >= 0])
    order = np.lexsort((y, x, o[x, y], label))
    first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])]
    return sorted((int(x[i]), int(y[i]), float(o[x[i], y[i]]), float(so[x[i], y[i]])) for i in first)


def blobs_in_tiles(tiles: DataFrame, **settings) -> DataFrame:
    """chrom, bin1_id, bin2_id, fdr, scale: blobs of each tile (chrom, block, bin1_id, bin2_id, cnt, near, low, high, behind), one tile a group, so memory is bounded by the tile.

    near: whether a pixel is within the distance limit, so that the farthest such diagonal is the tile's limit; low and high: the tile's first and last bin; behind: the last bin of the tile before, which reports blobs up to there."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        low, high, behind = (int(part[c].iloc[0]) for c in ("low", "high", "behind"))
        dense = np.zeros((high - low + 1,) * 2)
        dense[part.bin1_id.to_numpy() - low, part.bin2_id.to_numpy() - low] = part.cnt
        far = (part.bin2_id - part.bin1_id)[part.near.to_numpy(bool)]
        found = blobs(dense, int(far.max()) if len(far) else None, **settings)
        rows = [(part.chrom.iloc[0], low + r, low + c, q, s) for r, c, q, s in found if max(low + r, low + c) > behind]
        return pd.DataFrame(rows, columns=["chrom", "bin1_id", "bin2_id", "fdr", "scale"])

    return tiles.groupBy("chrom", "block").applyInPandas(run, "chrom string, bin1_id bigint, bin2_id bigint, fdr double, scale double")


def boundaries_in_regions(regions: DataFrame, track: DataFrame, scores: DataFrame, fills: DataFrame, window: int, p_most: float = 0.05) -> DataFrame:
    """chrom, bin_id, extreme, p of each region's bins: change points of the track (chrom, bin_id, score; 0 where there is none) and the domain p-value; minima with p below p_most stay -1.

    regions: chrom, first, last; scores: chrom, bin1_id, bin2_id, z of the cells with a pixel; fills: chrom, fill, the z of the others on each diagonal. A region is one task, with the 2 * window diagonals that are used."""
    spread = regions.select("chrom", "first", "last", F.explode(F.sequence("first", "last")).alias("bin_id"))
    rows = spread.join(track.select("chrom", "bin_id", F.col("score").cast("double").alias("score")), ["chrom", "bin_id"], "left").fillna(0.0, ["score"]).join(fills, "chrom", "left")
    k = F.col("bin2_id") - F.col("bin1_id")
    cells = scores.where(k < 2 * window).join(spread.withColumnRenamed("bin_id", "bin1_id"), ["chrom", "bin1_id"]).where("bin2_id <= last").select("chrom", "first", "last", "bin1_id", k.alias("k"), "z")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("bin_id")
        low, fill = int(left["first"].iloc[0]), left.fill.iloc[0]
        band = np.zeros((len(left), 2 * window))
        if fill is not None:
            band[:] = np.asarray(fill, float)
        band[right.bin1_id.to_numpy() - low, right.k.to_numpy()] = right.z
        extreme, p = change_points(left.score.to_numpy()), domain_p_values(band, window)
        extreme = np.where((extreme == -1) & (p >= p_most), 0, extreme)
        return pd.DataFrame({"chrom": left.chrom, "bin_id": left.bin_id, "extreme": extreme, "p": p})

    key = ["chrom", "first", "last"]
    return rows.groupBy(*key).cogroup(_apart(cells).groupBy(*key)).applyInPandas(run, "chrom string, bin_id bigint, extreme int, p double")


def gap_bins(first_columns: DataFrame, bins: DataFrame) -> DataFrame:
    """chrom, bin_id of the bins that greedy_gaps() finds; first_columns: chrom, bin_id, c, the first column with an entry of each row that has one; bins: chrom, bins. One row a bin meets in a task."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = int(right.bins.iloc[0])
        at = np.full(n, n)
        at[left.bin_id.to_numpy()] = left.c
        return pd.DataFrame({"chrom": right.chrom.iloc[0], "bin_id": np.flatnonzero(greedy_gaps(at))})

    return first_columns.groupBy("chrom").cogroup(_apart(bins).groupBy("chrom")).applyInPandas(run, "chrom string, bin_id bigint")
