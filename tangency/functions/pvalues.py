"""Tail probabilities by series and quadrature; there is no statistics library to lean on."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-squared: the regularised incomplete gamma, by its series or its continued fraction."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def range_sf(q: float, k: int) -> float:
    """Upper tail of the studentized range of k normals, infinite degrees of freedom."""
    z = np.linspace(-8, 8, 4001)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    low = np.array([0.5 * math.erfc(-(v - q) / math.sqrt(2)) for v in z])
    return float(min(1.0, max(0.0, 1 - k * np.trapezoid(phi * (cdf - low) ** (k - 1), z))))


def wilcoxon_sf(w: float, n: int, ties: float = 0.0, exact: bool = True) -> float:
    """Two-sided probability of a signed-rank sum of ``w`` or less: exact up to 50 pairs without ties, else normal."""
    if n == 0:
        return 1.0
    if exact and n <= 50 and not ties:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for r in range(1, n + 1):
            counts[r:] = counts[r:] + counts[:-r]
        return float(min(1.0, 2 * counts[: int(w) + 1].sum() / 2.0**n))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    return min(1.0, 2 * normal_sf((n * (n + 1) / 4.0 - w) / sd)) if sd else 1.0


def signed_rank_p(w: float, ranks: list[float], pairs: int | None = None) -> float:
    """Two-sided probability of the smaller signed-rank sum ``w``, from the ranks of the differences; exact without ties and zero differences."""
    _, size = np.unique(np.asarray(ranks, float), return_counts=True)
    ties = float((size.astype(float) ** 3 - size).sum())
    return wilcoxon_sf(w, len(ranks), ties, exact=pairs is None or pairs == len(ranks))


def t_cdf_table(df: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, distribution function) of Student's t, dense enough to invert by interpolation."""
    x = np.sinh(np.linspace(-12, 12, 20_001))
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
    c = np.concatenate([[0.0], np.cumsum(0.5 * (density[1:] + density[:-1]) * np.diff(x))])
    return x, c / c[-1]


def normal_quantiles(u: np.ndarray) -> np.ndarray:
    x = np.linspace(-9, 9, 20_001)
    c = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    return np.interp(u, c, x)
