"""Dependence between series: Gaussian and t copulas, the latter by profile likelihood over its degrees of freedom."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tangency.functions import pvalues


def correlation(v: np.ndarray) -> np.ndarray:
    """The nearest by eigenvalues: positive definite, with unit diagonal."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    r = (vectors * np.maximum(values, 1e-10)) @ vectors.T
    s = np.sqrt(np.diag(r))
    r = r / np.outer(s, s)
    r = (r + r.T) / 2
    np.fill_diagonal(r, 1.0)
    return r


def tau_correlation(x: np.ndarray) -> np.ndarray:
    """sin(pi tau / 2) of Kendall's tau between the columns, made positive semi-definite with unit diagonal."""
    t, n = x.shape
    tau, block = np.zeros((n, n)), max(1, (1 << 20) // max(1, x.size))
    for s in range(0, len(x), block):  # pairs of all rows, so many rows at once that a block has about a million signs
        signs = np.sign(x[s : s + block, None, :] - x[None, :, :]).reshape(-1, n)
        tau += signs.T @ signs
    d = np.sqrt(np.maximum(np.diag(tau), 1e-12))
    r = np.sin(np.pi / 2 * tau / np.outer(d, d))
    np.fill_diagonal(r, 1.0)
    return correlation(r)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of each column over n + 1: values of a uniform margin."""
    return (np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0) + 1) / (len(x) + 1)


def gaussian_loglik(rho: np.ndarray, u: np.ndarray) -> float:
    inverse, (_, logdet) = np.linalg.inv(rho), np.linalg.slogdet(rho)
    z = pvalues.normal_quantiles(u)
    return float(-0.5 * len(u) * logdet - 0.5 * (np.einsum("ij,jk,ik->i", z, inverse, z) - (z * z).sum(axis=1)).sum())


def t_loglik(rho: np.ndarray, y: np.ndarray, nu: float) -> float:
    """Of the quantiles ``y`` of the margins; with all constants, so that it compares with the Gaussian one."""
    d = y.shape[1]
    inverse, (_, logdet) = np.linalg.inv(rho), np.linalg.slogdet(rho)
    q = np.einsum("ij,jk,ik->i", y, inverse, y)
    joint = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * d * math.log(nu * math.pi) - 0.5 * logdet - 0.5 * (nu + d) * np.log1p(q / nu)
    margin = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - 0.5 * (nu + 1) * np.log1p(y * y / nu)
    return float((joint - margin.sum(axis=1)).sum())


def t_quantiles(u: np.ndarray, nu: float) -> np.ndarray:
    points, cdf = pvalues.t_cdf_table(nu)
    return np.interp(u, cdf, points)


@dataclass(frozen=True)
class Fit:
    rho: np.ndarray
    nu: float
    loglik: float
    gaussian: float  # log likelihood of the Gaussian copula at its own correlation


def fitted(u: np.ndarray, least: float = 2.05, most: float = 200.0) -> Fit:
    """The t copula of uniform values ``u``: for each number of degrees of freedom the correlation is improved by weighted second moments as long as the likelihood rises; the number itself is found by golden section of the profile."""
    u = np.clip(u, 1e-9, 1 - 1e-9)
    start = tau_correlation(u)

    def profile(nu: float, rho: np.ndarray) -> tuple[float, np.ndarray]:
        y = t_quantiles(u, nu)
        value = t_loglik(rho, y, nu)
        for _ in range(20):
            q = np.einsum("ij,jk,ik->i", y, np.linalg.inv(rho), y)
            w = (nu + y.shape[1]) / (nu + q)
            new = correlation((y * w[:, None]).T @ y / len(y) / np.outer(*[np.sqrt((w[:, None] * y * y).mean(axis=0))] * 2))
            got = t_loglik(new, y, nu)
            if got < value + 1e-6:
                break
            value, rho = got, new
        return value, rho

    gold = (math.sqrt(5) - 1) / 2
    grid = np.log(np.geomspace(least, most, 9))
    found = []
    rho = start
    for g in grid:
        value, rho = profile(math.exp(g), rho)
        found.append((value, rho))
    i = int(np.argmax([f[0] for f in found]))
    value, rho = found[i]
    best = (value, grid[i], rho)
    a, b = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    c, d = b - gold * (b - a), a + gold * (b - a)
    fc, fd = profile(math.exp(c), rho), profile(math.exp(d), rho)
    while b - a > 0.01:
        best = max(best, (fc[0], c, fc[1]), (fd[0], d, fd[1]), key=lambda x: x[0])
        if fc[0] >= fd[0]:
            b, d, fd = d, c, fc
            c = b - gold * (b - a)
            fc = profile(math.exp(c), rho)
        else:
            a, c, fc = c, d, fd
            d = a + gold * (b - a)
            fd = profile(math.exp(d), rho)
    z = pvalues.normal_quantiles(u)
    gauss = max(gaussian_loglik(r, u) for r in (correlation(np.atleast_2d(np.corrcoef(z.T))), start))
    return Fit(best[2], math.exp(best[1]), best[0], gauss)
