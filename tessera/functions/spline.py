"""Smoothing splines over few points."""

from __future__ import annotations

import numpy as np


def _curves(y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """The second derivatives inside of the natural cubic spline that is smoothed with this weight, and what it takes off y.

    With the second differences Q and the spline's matrix R of unit steps, (R + weight Q'Q) c = Q'y is banded with two bands on either side; it is factored and solved along them."""
    n = len(y) - 2
    diagonal = np.full(n, 2 / 3 + 6 * weight)
    one, two = np.full(max(n - 1, 0), 1 / 6 - 4 * weight), np.full(max(n - 2, 0), weight)
    d, e, f = np.zeros(n), np.zeros(n), np.zeros(n)  # of L D L'
    z = np.diff(y, 2)
    for i in range(n):
        f[i] = two[i - 2] / d[i - 2] if i > 1 else 0.0
        e[i] = (one[i - 1] - (f[i] * d[i - 2] * e[i - 1] if i > 1 else 0.0)) / d[i - 1] if i else 0.0
        d[i] = diagonal[i] - (e[i] ** 2 * d[i - 1] if i else 0.0) - (f[i] ** 2 * d[i - 2] if i > 1 else 0.0)
        z[i] -= (e[i] * z[i - 1] if i else 0.0) + (f[i] * z[i - 2] if i > 1 else 0.0)
    c = z / d
    for i in range(n - 1, -1, -1):
        c[i] -= (e[i + 1] * c[i + 1] if i + 1 < n else 0.0) + (f[i + 2] * c[i + 2] if i + 2 < n else 0.0)
    wide = np.concatenate([[0, 0], c, [0, 0]])
    return c, weight * (wide[:-2] - 2 * wide[1:-1] + wide[2:])


def smoothed(y: np.ndarray, residual: float, steps: int = 200) -> np.ndarray:
    """The smoothest natural cubic spline at 0, 1, 2, ... whose squared distance from y is at most `residual`: the straight line, if that is near enough, else the spline that just meets it."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 3 or residual <= 0:
        return y.copy()
    x = np.arange(n)
    line = np.polyval(np.polyfit(x, y, 1), x)
    if ((y - line) ** 2).sum() <= residual:
        return line
    low, high = -30.0, 40.0  # of the weight's logarithm
    for _ in range(steps):
        middle = (low + high) / 2
        if (_curves(y, np.exp(middle))[1] ** 2).sum() > residual:
            high = middle
        else:
            low = middle
        if high - low < 1e-12:
            break
    return y - _curves(y, np.exp(low))[1]
