"""GJR-GARCH with skewed t errors, by likelihood: a derivative-free simplex over all parameters.

The errors' density is Hansen's skewed t, with the degrees of freedom as their inverse ``e``: e = 0 is the normal limit, so the Gaussian model is a point of the
family and no fit is worse than it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tangency.functions.pvalues import t_cdf_table

MOST_E = 1 / 2.05  # of 1 / degrees of freedom: the variance exists
LEAST_E = 1e-3  # under this the density is the normal limit


def constants(e: float, skew: float) -> tuple[float, float, float]:
    """(a, b, ln c) of Hansen's density, of mean 0 and variance 1."""
    if e < LEAST_E:
        lc, tail = -0.5 * math.log(2 * math.pi), 1.0
    else:
        nu = 1 / e
        lc = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        tail = (nu - 2) / (nu - 1)
    a = 4 * skew * math.exp(lc) * tail
    return a, math.sqrt(1 + 3 * skew * skew - a * a), lc


def log_density(z: np.ndarray, e: float, skew: float) -> np.ndarray:
    a, b, lc = constants(e, skew)
    x = b * z + a
    x = x / np.where(x < 0, 1 - skew, 1 + skew)
    if e < LEAST_E:
        return math.log(b) + lc - 0.5 * x * x
    nu = 1 / e
    return math.log(b) + lc - 0.5 * (nu + 1) * np.log1p(x * x / (nu - 2))


def distribution(z: np.ndarray, e: float, skew: float) -> np.ndarray:
    """The skewed t's distribution function, from Student's."""
    a, b, _ = constants(e, skew)
    x = b * z + a
    below = x < 0
    x = x / np.where(below, 1 - skew, 1 + skew)
    nu = 1 / max(e, LEAST_E)
    points, cdf = t_cdf_table(nu)
    f = np.interp(x * math.sqrt(nu / (nu - 2)), points, cdf)
    return np.where(below, (1 - skew) * f, (1 + skew) * f - skew)


def draws(rng: np.random.Generator, n: int, e: float, skew: float) -> np.ndarray:
    """Standardised skewed t variates."""
    a, b, _ = constants(e, skew)
    nu = 1 / max(e, LEAST_E)
    x = np.abs(rng.standard_t(nu, n)) * math.sqrt((nu - 2) / nu)
    x = np.where(rng.random(n) < (1 - skew) / 2, -x * (1 - skew), x * (1 + skew))
    return (x - a) / b


def variances(eps: np.ndarray, omega: float, alpha: float, gamma: float, beta: float, first: float) -> np.ndarray:
    """Conditional variances of each row and of the next; the linear recursion is unrolled by doubling, in log n steps of whole arrays."""
    h = np.empty(len(eps) + 1)
    h[0] = first
    h[1:] = omega + (alpha + gamma * (eps < 0)) * eps * eps
    k, factor = 1, beta
    while k < len(h) and factor > 1e-18:
        h[k:] = h[k:] + factor * h[:-k]
        k, factor = 2 * k, factor * factor
    return h


def backcast(eps: np.ndarray) -> float:
    """The variance before the first row: the first 75 rows' squares, weights falling by 0.94."""
    w = 0.94 ** np.arange(min(75, len(eps)))
    return float((w * eps[: len(w)] ** 2).sum() / w.sum())


@dataclass(frozen=True)
class Fit:
    constant: float
    slope: float  # of the return before, where the mean is an autoregression
    omega: float
    alpha: float
    gamma: float
    beta: float
    e: float
    skew: float
    loglik: float
    first: float

    def residuals(self, r: np.ndarray) -> np.ndarray:
        return r - self.constant if not self.slope else r[1:] - self.constant - self.slope * r[:-1]

    def standardised(self, r: np.ndarray) -> np.ndarray:
        eps = self.residuals(r)
        return eps / np.sqrt(variances(eps, self.omega, self.alpha, self.gamma, self.beta, self.first)[:-1])

    def mean_variance(self, r: np.ndarray, steps: int) -> float:
        """Mean of the forecasts of the next ``steps`` conditional variances."""
        h = variances(self.residuals(r), self.omega, self.alpha, self.gamma, self.beta, self.first)[-1]
        keep = self.alpha + self.gamma / 2 + self.beta
        level = self.omega / (1 - keep)
        return level + (h - level) * (1 - keep**steps) / (1 - keep) / steps


def simplex(loss: object, start: np.ndarray, size: np.ndarray, steps: int = 1500, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Nelder and Mead's search, with their coefficients made to the dimension (Gao and Han)."""
    n = len(start)
    expand, shrink_in, shrink_all = 1 + 2 / n, 0.75 - 1 / (2 * n), 1 - 1 / n
    x = np.vstack([start, start + np.diag(size)])
    v = np.array([loss(p) for p in x])
    for _ in range(steps):
        order = v.argsort(kind="stable")
        x, v = x[order], v[order]
        if v[-1] - v[0] < tolerance and np.abs(x[1:] - x[0]).max() < 1e-5:
            break
        centre = x[:-1].mean(axis=0)
        way = centre - x[-1]
        new = centre + way
        got = loss(new)
        if got < v[0]:
            far = centre + expand * way
            value = loss(far)
            x[-1], v[-1] = (far, value) if value < got else (new, got)
        elif got < v[-2]:
            x[-1], v[-1] = new, got
        else:
            near = centre + shrink_in * way if got < v[-1] else centre - shrink_in * way
            value = loss(near)
            if value < min(got, v[-1]):
                x[-1], v[-1] = near, value
            else:
                x[1:] = x[0] + shrink_all * (x[1:] - x[0])
                v[1:] = [loss(p) for p in x[1:]]
    i = int(v.argmin())
    return x[i], float(v[i])


def fitted(r: np.ndarray, gjr: bool = True, ar: bool = False, errors: str = "skewt") -> Fit:
    """The largest likelihood of a series: constant (and slope on the return before), omega, alpha, gamma, beta, 1 / degrees of freedom and skew at once.

    ``errors``: "normal" or "skewt"; the latter's search begins at the former's fit as well as at tails and no tails of its own.  Omega is searched as the
    long-run variance, relative to the series'.  Over the box (alpha, beta, alpha + gamma >= 0; alpha + gamma / 2 + beta < 1) the likelihood is the model's own, outside it is not looked at.
    """
    r = np.asarray(r, float)
    spread = float(r.std())
    if len(r) < 20 or not spread > 0 or not np.isfinite(r).all():
        raise ValueError("too short or constant")
    y = r / spread
    x0, x1 = (y[:-1], y[1:]) if ar else (None, y)
    first = backcast(x1 - x1.mean())

    def parts(p: np.ndarray) -> tuple[float, ...]:
        c, s, level, alpha, gamma, beta = p[0], p[1] if ar else 0.0, p[2], p[3], p[4] if gjr else 0.0, p[5]
        return c, s, math.exp(level) * (1 - alpha - gamma / 2 - beta), alpha, gamma, beta

    def loss(p: np.ndarray, tails: bool) -> float:
        c, s, omega, alpha, gamma, beta = parts(p)
        e, skew = (p[6], p[7]) if tails else (0.0, 0.0)
        if alpha < 0 or beta < 0 or alpha + gamma < 0 or alpha + gamma / 2 + beta >= 0.9999 or not 0 <= e < MOST_E or abs(skew) >= 0.99 or abs(s) >= 1 or abs(p[2]) > 6:
            return math.inf
        eps = x1 - c - s * x0 if ar else x1 - c
        h = variances(eps, omega, alpha, gamma, beta, first)[:-1]
        return float(0.5 * np.log(h).sum() - log_density(eps / np.sqrt(h), e, skew).sum())

    size = np.array([0.05, 0.1, 0.3, 0.05, 0.05, -0.1, 0.05, 0.1])
    free = np.array([True, ar, True, True, gjr, True, True, True])

    def search(start: np.ndarray, tails: bool) -> tuple[np.ndarray, float]:
        own = free & (np.arange(8) < (8 if tails else 6))

        def at(v: np.ndarray) -> float:
            p = start.copy()
            p[own] = v
            return loss(p, tails)

        v, value = simplex(at, start[own], size[own])
        v, value = simplex(at, v, size[own] * 0.3)  # anew from the best: a simplex may have collapsed
        out = start.copy()
        out[own] = v
        return out, value

    slope = float(np.corrcoef(x0, x1)[0, 1]) if ar else 0.0
    base = np.array([float(x1.mean()), slope, 0.0, 0.05, 0.05 if gjr else 0.0, 0.85, 0.0, 0.0])
    begun = [base, base.copy(), base.copy()]
    begun[1][3:6] = 0.1, 0.0, 0.6
    begun[2][3:6] = 0.03, 0.02 if gjr else 0.0, 0.94
    best = min((search(b, False) for b in begun), key=lambda f: f[1])
    if errors == "skewt":
        starts = []
        for e, skew in ((0.0, 0.0), (0.15, 0.0)):
            p = best[0].copy()
            p[6:] = e, skew
            starts.append(p)
        best = min([best, *(search(p, True) for p in starts)], key=lambda f: f[1])
    p, value = best
    c, s, omega, alpha, gamma, beta = parts(p)
    return Fit(c * spread, s, omega * spread**2, alpha, gamma, beta, float(p[6]), float(p[7]), -value - len(x1) * math.log(spread), first * spread**2)
