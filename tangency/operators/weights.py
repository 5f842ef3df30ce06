"""Portfolio weights: numeric solvers on one portfolio at a time, in grouped pandas functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.functions.randomness import uniform
from tangency.operators.frontier import Frontier, frontier, residual
from tangency.session import ship


def project(v: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest point of {sum 1, low <= w <= high}: v less one number, clipped.  The sum is linear between the clipping points."""
    points = np.sort(np.concatenate([v - low, v - high]))
    sums = np.clip(v[None, :] - points[:, None], low, high).sum(axis=1)
    i = int(np.searchsorted(-sums, -1.0))
    if i == 0 or i == len(points):
        return np.clip(v - points[min(i, len(points) - 1)], low, high)
    a, b, sa, sb = points[i - 1], points[i], sums[i - 1], sums[i]
    return np.clip(v - (a + (b - a) * ((sa - 1) / (sa - sb) if sa > sb else 0.0)), low, high)


def tilted(mu: np.ndarray, cov: np.ndarray, low: float, high: float, tilt: float, start: np.ndarray, steps: int = 1500) -> np.ndarray:
    """Minimises w'Cw - tilt w'mu over the box simplex by accelerated projected gradient: a point of the efficient frontier."""
    size = 0.5 / max(float(np.linalg.norm(cov, 2)), 1e-12)
    mu = mu - mu.mean()  # the same on the simplex, and no large common part in the steps
    w = project(start, low, high)
    y, t = w, 1.0
    for _ in range(steps):
        new = project(y - size * (2 * cov @ y - tilt * mu), low, high)
        if (y - new) @ (new - w) > 0:
            t = 1.0
        s = 0.5 * (1 + np.sqrt(1 + 4 * t * t))
        y, t = new + (t - 1) / s * (new - w), s
        moved = float(np.abs(new - w).max())
        w = new
        if moved < 1e-12:
            break
    return w


def at_level(level: object, want: float, mu: np.ndarray, cov: np.ndarray, low: float, high: float, ends: tuple[np.ndarray, np.ndarray], tilts: tuple[float, float]) -> np.ndarray:
    """The frontier point at which ``level`` (rising with the tilt) is ``want``: bisection, then a mix of the two that enclose it."""
    a, b = ends
    ta, tb = tilts
    for _ in range(60):
        tm = 0.5 * (ta + tb)
        m = tilted(mu, cov, low, high, tm, 0.5 * (a + b))
        if level(m) < want:
            a, ta = m, tm
        else:
            b, tb = m, tm
        if abs(level(b) - level(a)) < 1e-10:
            break
    x, y = 0.0, 1.0  # along the segment the level rises
    for _ in range(80):
        z = 0.5 * (x + y)
        x, y = (z, y) if level(a + z * (b - a)) < want else (x, z)
    return a + y * (b - a)


def extreme_return(mu: np.ndarray, low: float, high: float, largest: bool = True) -> np.ndarray:
    """The weights of the largest (smallest) return: names filled up in order."""
    w, left = np.full(len(mu), float(low)), 1 - low * len(mu)
    for i in np.argsort(-mu if largest else mu, kind="stable"):
        add = min(high - low, max(left, 0.0))
        w[i] += add
        left -= add
    return w


def ratio(w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> float:
    v = float(w @ cov @ w)
    return float(w @ mu) / np.sqrt(v) if v > 0 else 0.0


def _on_corners(upper: Frontier, mu: np.ndarray, low: float, high: float, target_return: float | None, target_risk: float | None, min_return: float | None, hi: float, lo: float) -> tuple[np.ndarray, str]:
    least, top = upper.weights[0], upper.weights[-1]

    def at_return(r: float) -> np.ndarray:
        if r >= float(least @ mu):
            return upper.at_return(r)
        lower = frontier(-mu, upper.cov, low, high)
        if lower is None:
            raise np.linalg.LinAlgError("no lower frontier")
        return lower.at_return(-r)

    if target_return is not None:
        if not lo - 1e-9 <= target_return <= hi + 1e-9:
            return top if target_return > hi else extreme_return(mu, low, high, False), "infeasible"
        return at_return(target_return), "optimal"
    if target_risk is not None:
        risks = upper.risks()
        if not risks[0] - 1e-9 <= target_risk <= risks[-1] + 1e-9:
            return least if target_risk < risks[0] else top, "infeasible"
        return upper.at_risk(target_risk), "optimal"
    if min_return is not None and min_return > hi + 1e-9:
        return top, "infeasible"
    best = upper.largest_ratio()
    if min_return is not None and float(best @ mu) < min_return:
        return at_return(min_return), "optimal"
    return best, "optimal"


def max_sharpe(mu: np.ndarray, cov: np.ndarray, low: float = 0.0, high: float = 0.3333, target_return: float | None = None, target_risk: float | None = None, min_return: float | None = None) -> tuple[np.ndarray, str]:
    """(weights, status).  Target return and target risk are equalities and exclude each other; min_return is an inequality.

    Points of the frontier's segments (``frontier``), for a singular covariance of one with a billionth more variance; where corners cannot be walked, by projected gradients.
    """
    n = len(mu)
    if target_return is not None and target_risk is not None:
        raise ValueError("a target for return or for risk, not both")
    if n == 0 or n * high < 1 - 1e-12 or n * low > 1 + 1e-12:
        return np.full(n, 1 / n if n else 0.0), "infeasible"
    top, bottom = extreme_return(mu, low, high), extreme_return(mu, low, high, False)
    hi, lo = float(top @ mu), float(bottom @ mu)
    upper = frontier(mu, cov, low, high)
    if upper is None:  # a singular covariance: a little more variance of each name's own tells equal mixes apart
        upper = frontier(mu, cov + np.eye(n) * (1e-9 * float(np.diag(cov).mean()) or 1e-6), low, high)
    if upper is not None:
        try:
            return _on_corners(upper, mu, low, high, target_return, target_risk, min_return, hi, lo)
        except np.linalg.LinAlgError:  # the lower frontier cannot be walked
            pass
    far = 1e4 * max(float(np.linalg.norm(cov, 2)), 1e-12) / max(float(np.ptp(mu)), 1e-12)
    gain = lambda w: float(w @ mu)
    risk = lambda w: float(np.sqrt(max(w @ cov @ w, 0.0)))
    least = tilted(mu, cov, low, high, 0.0, np.full(n, 1 / n), 4000)

    def at_return(r: float) -> np.ndarray:
        ends, tilts = ((least, top), (0.0, far)) if r >= gain(least) else ((bottom, least), (-far, 0.0))
        return at_level(gain, r, mu, cov, low, high, ends, tilts)

    if target_return is not None:
        if not lo - 1e-9 <= target_return <= hi + 1e-9:
            return top if target_return > hi else bottom, "infeasible"
        return at_return(target_return), "optimal"
    if target_risk is not None:
        if not risk(least) - 1e-9 <= target_risk <= risk(top) + 1e-9:
            return least if target_risk < risk(least) else top, "infeasible"
        return at_level(risk, target_risk, mu, cov, low, high, (least, top), (0.0, far)), "optimal"
    if min_return is not None and min_return > hi + 1e-9:
        return top, "infeasible"
    # the ratio rises, then falls, along the frontier: a grid of tilts, then a golden section about its best
    grid = np.concatenate([[0.0], far * np.logspace(-8, 0, 33)])
    found, w = [], least
    for t in grid:
        w = tilted(mu, cov, low, high, float(t), w)
        found.append(w)
    i = int(np.argmax([ratio(v, mu, cov) for v in found]))
    a, b, w = float(grid[max(0, i - 1)]), float(grid[min(len(grid) - 1, i + 1)]), found[i]
    gold = (np.sqrt(5) - 1) / 2
    c, d = b - gold * (b - a), a + gold * (b - a)
    wc, wd = (tilted(mu, cov, low, high, x, w) for x in (c, d))
    for _ in range(40):
        if ratio(wc, mu, cov) >= ratio(wd, mu, cov):
            b, d, wd = d, c, wc
            c = b - gold * (b - a)
            wc = tilted(mu, cov, low, high, c, wc)
        else:
            a, c, wc = c, d, wd
            d = a + gold * (b - a)
            wd = tilted(mu, cov, low, high, d, wd)
    best = max([wc, wd, top, *found], key=lambda v: ratio(v, mu, cov))
    if min_return is not None and gain(best) < min_return:
        return at_return(min_return), "optimal"
    return best, "optimal"


def risk_parity(cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> tuple[np.ndarray, str]:
    """Equal risk contributions: cyclical descent on the log-barrier form; if the box binds, projected gradient on the squared gaps."""
    n = len(cov)
    if n == 0 or n * high < 1 - 1e-12 or n * low > 1 + 1e-12:
        return np.full(n, 1 / n if n else 0.0), "infeasible"
    if (np.diag(cov) <= 0).any():
        return np.full(n, 1 / n), "degenerate"
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(2000):
        before = x.copy()
        for i in range(n):
            s = float(cov[i] @ x - cov[i, i] * x[i])
            x[i] = (-s + np.sqrt(s * s + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - before).max() < 1e-14 * np.abs(x).max():
            break
    w = x / x.sum()
    if (w >= low - 1e-12).all() and (w <= high + 1e-12).all():
        return w, "optimal"
    w = project(w, low, high)

    def gap(v: np.ndarray) -> float:
        rc = v * (cov @ v)
        return float(((rc - rc.mean()) ** 2).sum())

    size = 1.0 / max(1e-12, float(np.linalg.norm(cov, 2)) ** 2)
    for _ in range(3000):
        m = cov @ w
        rc = w * m
        e = rc - rc.mean()
        new = project(w - size * 2 * (e * m + cov @ (e * w)), low, high)
        if gap(new) > gap(w):
            size *= 0.5
            if size < 1e-18:
                break
            continue
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w, "bounded"


def _cells(chosen: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio_id, ti, tj, x): expected returns (tj null) and covariances of each portfolio's holdings."""
    named = chosen.join(mu, [c for c in ("portfolio_id", "ticker") if c in mu.columns], "left")
    cells = chosen.withColumnRenamed("ticker", "ti").join(chosen.withColumnRenamed("ticker", "tj"), "portfolio_id").join(cov, [c for c in ("portfolio_id", "ti", "tj") if c in cov.columns])
    return named.select("portfolio_id", F.col("ticker").alias("ti"), F.lit(None).cast("string").alias("tj"), F.col("mu").alias("x")).unionByName(cells.select("portfolio_id", "ti", "tj", F.col("cov").alias("x")))


def _inputs_of(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tickers, expected returns, covariance) of one portfolio's cells."""
    own = pdf[pdf["tj"].isna()].sort_values("ti")
    names, m = list(own["ti"]), own["x"].to_numpy(float)
    place = {t: i for i, t in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    for a, b, v in pdf[~pdf["tj"].isna()][["ti", "tj", "x"]].itertuples(index=False):
        if a in place and b in place:
            c[place[a], place[b]] = v
    return names, m, c


def solve(chosen: DataFrame, mu: DataFrame, cov: DataFrame, how: str = "sharpe", low: float = 0.0, high: float | None = 0.3333, **targets: float | None) -> DataFrame:
    """(portfolio_id, ticker, weight, status) for each portfolio of (portfolio_id, ticker).  A portfolio's covariance is the size of its holdings.

    ``mu`` (ticker, mu) and ``cov`` (ti, tj, cov) are one for all, or with a portfolio_id one for each.  A portfolio with a ticker that ``mu`` has not gets no weights and the status "unknown ticker".
    """
    ship(chosen.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m, c = _inputs_of(pdf)
        if np.isnan(m).any():
            return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "ticker": names, "weight": np.nan, "status": "unknown ticker"})
        top = ceiling(len(names)) if high is None else high
        w, status = risk_parity(c, low, top) if how == "parity" else max_sharpe(m, c, low, top, **targets)
        return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "ticker": names, "weight": w, "status": status})

    return _cells(chosen, mu, cov).groupBy("portfolio_id").applyInPandas(run, "portfolio_id string, ticker string, weight double, status string")


def corners(chosen: DataFrame, mu: DataFrame, cov: DataFrame, low: float = 0.0, high: float = 0.3333) -> DataFrame:
    """(portfolio_id, corner, tilt, ret, risk, residual, ticker, weight): the corner portfolios of each portfolio's frontier, from the least risk to the largest return.

    Portfolios that the box allows no weights, that have unknown tickers or a covariance singular on free weights have none.
    """
    ship(chosen.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m, c = _inputs_of(pdf)
        n = len(names)
        if np.isnan(m).any() or n * high < 1 - 1e-12 or n * low > 1 + 1e-12:
            return pd.DataFrame()
        f = frontier(m, c, low, high)
        if f is None:
            return pd.DataFrame()
        k = len(f.tilts)
        own = [residual(w, t, m, c, low, high) for w, t in zip(f.weights, f.tilts, strict=True)]
        each = lambda x: np.repeat(x, n)
        return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "corner": each(np.arange(k)), "tilt": each(f.tilts), "ret": each(f.gains()), "risk": each(f.risks()), "residual": each(own), "ticker": names * k, "weight": f.weights.ravel()})

    return _cells(chosen, mu, cov).groupBy("portfolio_id").applyInPandas(run, "portfolio_id string, corner int, tilt double, ret double, risk double, residual double, ticker string, weight double")


def random_weights(chosen: DataFrame, seed: int) -> DataFrame:
    """Uniforms over their sum; an empty table has none."""
    u = uniform(seed, "weight", F.col("portfolio_id"), F.col("ticker"))
    return chosen.withColumn("u", u).select("portfolio_id", "ticker", (F.col("u") / F.sum("u").over(Window.partitionBy("portfolio_id"))).alias("weight"))


def ceiling(k: int) -> float:
    """The largest weight of a portfolio of ``k``: room for all but one, 0.3 at least."""
    return max(1.0 / (k - 1), 0.3) if k > 1 else 1.0


def checked(chosen: DataFrame, least: int = 1) -> DataFrame:
    """``chosen``, unless it is empty or a portfolio has under ``least`` holdings: a ValueError."""
    if chosen.isEmpty():
        raise ValueError("an empty portfolio")
    small = chosen.groupBy("portfolio_id").count().where(F.col("count") < least).orderBy("portfolio_id").limit(5).collect()
    if small:
        raise ValueError(f"portfolios of under {least} holdings: {', '.join(str(r[0]) for r in small)}")
    return chosen


def optimal_weights(chosen: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """``solve`` for the largest ratio with no weight over ``ceiling``.  Under two holdings: ValueError; a ticker without history: KeyError."""
    unknown = checked(chosen, 2).join(mu, [c for c in ("portfolio_id", "ticker") if c in mu.columns], "left_anti").select("ticker").distinct().orderBy("ticker").limit(20).collect()
    if unknown:
        raise KeyError(f"tickers without history: {', '.join(r[0] for r in unknown)}")
    return solve(chosen, mu, cov, "sharpe", 0.0, None)


def best_ratio(mu: np.ndarray, cov: np.ndarray, low: float, high: float) -> float:
    """The largest ratio within the box; where it allows no weights, that of equal ones."""
    n = len(mu)
    if n * high < 1 - 1e-12 or n * low > 1 + 1e-12:
        return ratio(np.full(n, 1 / n), mu, cov)
    return ratio(max_sharpe(mu, cov, low, high)[0], mu, cov)
