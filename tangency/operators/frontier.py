"""The efficient frontier within a box, corner by corner: an active-set walk along the tilt towards return.

For a tilt t the weights minimise w'Cw - t w'mu subject to sum 1 and low <= w <= high.  Between two corners the free weights and the multipliers are linear in t; a corner
is where a free weight reaches a bound or a bound weight's multiplier its sign.  So every point of the frontier is a mix of two corners, and targets of return or risk and
the largest ratio are found on the segments in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TINY = 1e-11


@dataclass(frozen=True)
class Frontier:
    """Corners in order of rising return; ``tilts`` rise with them.  ``complete``: the walk came to the largest return."""

    tilts: np.ndarray
    weights: np.ndarray
    mu: np.ndarray
    cov: np.ndarray
    complete: bool

    def gains(self) -> np.ndarray:
        return self.weights @ self.mu

    def risks(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", self.weights, self.cov, self.weights), 0.0))

    def at_return(self, want: float) -> np.ndarray:
        g = self.gains()
        i = int(np.clip(np.searchsorted(g, want), 1, max(len(g) - 1, 1)))
        if len(g) == 1:
            return self.weights[0]
        part = np.clip((want - g[i - 1]) / (g[i] - g[i - 1]), 0.0, 1.0) if g[i] > g[i - 1] else 0.0
        return self.weights[i - 1] + part * (self.weights[i] - self.weights[i - 1])

    def at_risk(self, want: float) -> np.ndarray:
        r = self.risks()
        if len(r) == 1:
            return self.weights[0]
        i = int(np.clip(np.searchsorted(r, want), 1, len(r) - 1))
        a, d = self.weights[i - 1], self.weights[i] - self.weights[i - 1]
        # d'Cd s^2 + 2 a'Cd s + a'Ca = want^2
        q, h, c = float(d @ self.cov @ d), float(a @ self.cov @ d), float(a @ self.cov @ a) - want * want
        if q <= 0:
            return a
        s = (-h + np.sqrt(max(h * h - q * c, 0.0))) / q
        return a + np.clip(s, 0.0, 1.0) * d

    def largest_ratio(self) -> np.ndarray:
        """Of return over risk: a corner, or the point of a segment at which the ratio's slope is nought."""
        def ratio(w: np.ndarray) -> float:
            v = float(w @ self.cov @ w)
            return float(w @ self.mu) / np.sqrt(v) if v > 0 else 0.0

        found = list(self.weights)
        for a, b in zip(self.weights[:-1], self.weights[1:], strict=True):
            d = b - a
            m0, m1 = float(a @ self.mu), float(d @ self.mu)
            v0, v1, v2 = float(a @ self.cov @ a), float(a @ self.cov @ d), float(d @ self.cov @ d)
            bottom = m0 * v2 - m1 * v1
            if bottom != 0:
                s = (m1 * v0 - m0 * v1) / bottom
                if 0 < s < 1:
                    found.append(a + s * d)
        return max(found, key=ratio)


def least_variance(cov: np.ndarray, low: float, high: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, state: -1 at the lower bound, 1 at the upper, 0 free) by a primal active-set method from a feasible start."""
    n = len(cov)
    w = start.copy()
    state = np.where(w <= low + TINY, -1, np.where(w >= high - TINY, 1, 0))
    for _ in range(50 * n + 100):
        free = np.flatnonzero(state == 0)
        g = 2 * cov @ w
        if len(free) > 1:
            k = len(free)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = 2 * cov[np.ix_(free, free)], 1.0, 1.0
            way = np.linalg.solve(system, np.append(-g[free], 0.0))[:k]
        else:
            way = np.zeros(len(free))
        if len(free) and np.abs(way).max() > 1e-13:
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(way > 0, (high - w[free]) / way, np.where(way < 0, (low - w[free]) / way, np.inf))
            j = int(room.argmin())
            s = min(1.0, float(room[j]))
            w[free] += s * way
            if s < 1.0:
                state[free[j]] = 1 if way[j] > 0 else -1
                w[free[j]] = high if way[j] > 0 else low
                continue
            g = 2 * cov @ w
        # multipliers: the free gradients are all one; without free weights, any level between the two sides
        lower, upper = np.flatnonzero(state == -1), np.flatnonzero(state == 1)
        if len(free):
            level = float(g[free].mean())
            worst = [(level - g[i], i) for i in lower] + [(g[i] - level, i) for i in upper]
            if high - low < TINY or not worst or max(worst)[0] <= 1e-12 * max(1.0, float(np.abs(g).max())):
                return w, state
            state[max(worst)[1]] = 0
        else:
            i, j = (int(lower[g[lower].argmin()]) if len(lower) else -1), (int(upper[g[upper].argmax()]) if len(upper) else -1)
            if i < 0 or j < 0 or high - low < TINY or g[i] >= g[j] - 1e-14 * max(1.0, float(np.abs(g).max())):
                return w, state
            state[[i, j]] = 0
    raise np.linalg.LinAlgError("no least variance")


def walk(mu: np.ndarray, cov: np.ndarray, low: float, high: float, w: np.ndarray, state: np.ndarray) -> Frontier:
    """Corners from the least variance to the largest return."""
    n = len(mu)
    mu_c = mu - mu.mean()
    tilts, corners, t = [0.0], [w.copy()], 0.0
    state = state.copy()
    stuck = 0
    for _ in range(60 * n + 100):
        free, bound = np.flatnonzero(state == 0), np.flatnonzero(state != 0)
        k = len(free)
        slope, level_slope = np.zeros(n), 0.0
        if k:
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = 2 * cov[np.ix_(free, free)], -1.0, 1.0
            solved = np.linalg.solve(system, np.column_stack([np.append(mu_c[free], 0.0)]))[:, 0]
            slope[free], level_slope = solved[:k], solved[k]
            if k == 1:
                slope[free] = 0.0
        g = 2 * cov @ w - t * mu_c
        g_slope = 2 * cov @ slope - mu_c
        events: list[tuple[float, int, int]] = []  # (tilt, weight, new state)
        for i in free:
            if slope[i] > 1e-14:
                events.append((t + (high - w[i]) / slope[i], i, 1))
            elif slope[i] < -1e-14:
                events.append((t + (low - w[i]) / slope[i], i, -1))
        pair = None
        if k:
            level = float(g[free].mean())
            for i in bound:
                # at the lower bound the multiplier g - level must not fall below nought, at the upper not rise above it
                gap, gap_slope = (g[i] - level, g_slope[i] - level_slope) if state[i] < 0 else (level - g[i], level_slope - g_slope[i])
                if gap_slope < -1e-15:
                    events.append((t + max(gap, 0.0) / -gap_slope, i, 0))
        else:
            lower, upper = bound[state[bound] < 0], bound[state[bound] > 0]
            gap = g[lower][:, None] - g[upper][None, :]
            fall = g_slope[lower][:, None] - g_slope[upper][None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                when = np.where(fall < -1e-15, t + np.maximum(gap, 0.0) / -fall, np.inf)
            if when.size and np.isfinite(when.min()):
                i, j = np.unravel_index(int(when.argmin()), when.shape)
                pair = (float(when[i, j]), int(lower[i]), int(upper[j]))
        if pair:
            t = max(t, pair[0])
            state[[pair[1], pair[2]]] = 0
            continue
        if not events:
            return Frontier(np.array(tilts), np.array(corners), mu, cov, True)
        when, i, new = min(events)
        step = max(when - t, 0.0)
        w = w + step * slope
        t += step
        state[i] = new
        if new:
            w[i] = high if new > 0 else low
        stuck = 0 if step > 0 else stuck + 1
        if stuck > 4 * n + 20:
            break
        if np.abs(w - corners[-1]).max() > TINY:
            tilts.append(t)
            corners.append(w.copy())
    return Frontier(np.array(tilts), np.array(corners), mu, cov, False)


def residual(w: np.ndarray, tilt: float, mu: np.ndarray, cov: np.ndarray, low: float, high: float) -> float:
    """How far a point is from the conditions of an optimum at its tilt: sum, box, and signs of the multipliers, relative to the gradient."""
    g = 2 * cov @ w - tilt * (mu - mu.mean())
    scale = max(float(np.abs(2 * cov @ w).max()), float(np.abs(tilt * (mu - mu.mean())).max()), 1e-300)
    up, down = w < high - 1e-10, w > low + 1e-10  # can rise, can fall
    over = float(g[down].max() - g[up].min()) / scale if up.any() and down.any() else 0.0
    return max(abs(float(w.sum()) - 1), float((low - w).max()), float((w - high).max()), over, 0.0)


def frontier(mu: np.ndarray, cov: np.ndarray, low: float, high: float) -> Frontier | None:
    """The upper frontier; None where the walk is not possible (a covariance that is singular on the weights left free) or its corners are not optima."""
    n = len(mu)
    try:
        w = np.full(n, 1 / n)
        w, state = least_variance(cov, low, high, np.clip(w, low, high))
        found = walk(mu, cov, low, high, w, state)
    except np.linalg.LinAlgError:
        return None
    if not found.complete or not np.isfinite(found.weights).all():
        return None
    if max(residual(w, t, mu, cov, low, high) for w, t in zip(found.weights, found.tilts, strict=True)) > 1e-9:
        return None
    return found
