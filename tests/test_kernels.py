from itertools import combinations

import numpy as np
import pytest

from tessera.functions.kernels import balance, bh_values, change_points, connected_labels, greedy_gaps, kde, lowess, mann_whitney_less, normalise_marginals, normalise_pair


def test_balanced_rows_meet_their_targets():
    r = np.random.default_rng(0)
    a = np.triu(r.random((40, 40))) * (r.random((40, 40)) < 0.5) + np.eye(40)
    i, j = np.nonzero(a)
    goal = r.uniform(0.5, 3, 40)
    x = balance(i, j, a[i, j], goal)
    full = a + np.triu(a, 1).T
    assert np.abs(x * (full @ x) - goal).max() < 1e-4


def test_balance_of_two_components_and_an_empty_row():
    x = balance(np.array([0, 1]), np.array([0, 1]), np.array([4.0, 9.0]), np.ones(3))
    assert np.allclose(x, [0.5, 1 / 3, 1.0])


def test_lowess_of_a_line_is_the_line():
    x = np.random.default_rng(1).random(300)
    assert np.abs(lowess(x, 3 * x + 1) - 3 * x - 1).max() < 1e-9


@pytest.mark.parametrize("n,m", [(1, 1), (2, 5), (4, 4), (3, 7)])
def test_exact_ranks(n, m):
    r = np.random.default_rng(n * 10 + m)
    for _ in range(20):
        v = r.permutation(n + m).astype(float)
        x, y = v[:n], v[n:]
        u = sum(a > b for a in x for b in y)
        every = [sum(a > b for a in c for b in set(range(n + m)) - set(c)) for c in combinations(range(n + m), n)]
        assert mann_whitney_less(x, y) == pytest.approx(np.mean([w <= u for w in every]))


def test_bh_is_monotone_and_at_most_one():
    p = np.random.default_rng(2).random(200)
    q = bh_values(p)
    assert (q <= 1).all() and (np.diff(q[np.argsort(p)]) >= 0).all() and (q >= p).all()


def test_greedy_gaps_is_not_the_union_of_runs():
    assert greedy_gaps(np.array([3, 4, 4, 4, 5, 5])).tolist() == [True, True, True, False, False, False]


def test_components():
    assert connected_labels(6, np.array([0, 4, 2]), np.array([1, 5, 4])).tolist() == [0, 0, 2, 3, 2, 2]


def test_change_points_find_the_valley():
    assert change_points(np.abs(np.arange(21) - 10.0)).tolist().index(-1) == 10


def test_density_is_one_in_all():
    grid, d = kde(np.random.default_rng(3).normal(size=500))
    assert abs(d.sum() * (grid[1] - grid[0]) - 1) < 0.01


def test_marginals_leave_outliers_out_and_fill_bins_without_sites(spark):
    # with one site: slope 1 but for the last, whose a is an outlier that alone makes the slope small; with two sites: slope 0.1; without sites: between them
    one = [(0, 10, 12), (1, 20, 21), (2, 30, 33), (3, 40, 39), (4, 50, 54), (5, 5000, 60)]
    two = [(10, 100, 50), (11, 200, 61), (12, 300, 69), (13, 400, 81)]
    none = [(7, 80, 0), (8, 90, 70)]
    rows = [("c", i, a, b, s) for s, group in ((1, one), (2, two), (0, none)) for i, a, b in group]
    got = {r.bin_id: (r.norm_a, r.norm_b) for r in normalise_marginals(spark.createDataFrame(rows, "chrom string, bin_id long, a long, b long, sites long")).collect()}
    factors = {}
    for group in (one, two):
        a, b = (np.array([x[k] for x in group], float) for k in (1, 2))
        for (i, *_), x, y, na, nb in zip(group, a, b, *normalise_pair(a, b), strict=True):
            assert got[i] == pytest.approx((na, nb))
            factors[i] = (na + 1) / (x + 1), (nb + 1) / (y + 1)
    for step, (i, a, b) in enumerate(none, 1):  # rows, not bins, are counted between 5 and 10
        fa, fb = (factors[5][k] + (factors[10][k] - factors[5][k]) * step / 3 for k in (0, 1))
        assert got[i] == pytest.approx((fa * (a + 1) - 1, fb * (b + 1) - 1 if b else 0))
