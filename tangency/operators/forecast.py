"""Forecasts of return and variance, and dependence between series, as the models' likelihoods have them.

ARIMA by exact likelihood (``arima``), GJR-GARCH with skewed t errors (``garch``), t copulas by profile likelihood (``copula``).  A series is one group of rows, a portfolio another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.functions import pvalues
from tangency.operators import arima, copula, garch
from tangency.session import ship

YEAR = 252


def forecast_return(close: np.ndarray, steps: int = YEAR, least: int = 30, **orders: object) -> float | None:
    """ln of the last over the first forecast price (at least 1e-4) of an ARIMA(p, d, q) of the prices, p and q up to 5; None if it cannot be told, or if the path starts at zero or below."""
    if len(close) < least:
        return None
    try:
        path, _, _ = arima.forecast(np.asarray(close, float), steps, **orders)
    except (ValueError, np.linalg.LinAlgError):
        return None
    value = np.log(max(1e-4, path[-1]) / path[0]) if path[0] > 0 else np.nan
    return float(value) if np.isfinite(value) else None


def forecast_variance(ret: np.ndarray, steps: int = YEAR) -> float | None:
    """Annual variance: mean forecast of a GJR-GARCH(1,1,1) with a constant mean and skewed t errors, on returns in per cent; None if it cannot be told."""
    r = 100 * np.asarray(ret, float)
    try:
        value = garch.fitted(r).mean_variance(r, steps) / 1e4 * YEAR
    except (ValueError, np.linalg.LinAlgError):
        return None
    return float(value) if np.isfinite(value) and value > 0 else None


def forecasts(laid: DataFrame, rets: DataFrame) -> DataFrame:
    """(ticker, mu, variance), with the historical value where a forecast cannot be told.  One series is one group."""
    ship(laid.sparkSession)
    both = laid.select("ticker", "t", "close").join(rets.select("ticker", "t", "ret"), ["ticker", "t"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r = pdf["ret"].to_numpy(float)
        mu, var = forecast_return(pdf["close"].dropna().to_numpy(float)), forecast_variance(r)
        sample = float(r.var(ddof=1) * YEAR) if len(r) > 1 else np.nan
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "mu": [mu if mu is not None else float(r.mean() * YEAR)], "variance": [var if var is not None else sample]})

    return both.groupBy("ticker").applyInPandas(run, "ticker string, mu double, variance double")


def ljung_box(rets: DataFrame, lags: int = 10) -> DataFrame:
    """(ticker, q): Ljung-Box statistic of squared returns."""
    w = Window.partitionBy("ticker")
    x = rets.withColumn("y", F.col("ret") * F.col("ret"))
    x = x.withColumn("d", F.col("y") - F.avg("y").over(w)).withColumn("n", F.count("*").over(w))
    o = w.orderBy("t")
    sums = [F.sum(F.col("d") * F.coalesce(F.col(f"l{k}"), F.lit(0.0))).alias(f"c{k}") for k in range(1, lags + 1)]
    laged = x.select("ticker", "d", "n", *[F.lag("d", k).over(o).alias(f"l{k}") for k in range(1, lags + 1)])
    c = laged.groupBy("ticker").agg(F.sum(F.col("d") * F.col("d")).alias("c0"), F.first("n").alias("n"), *sums)
    q = sum(F.pow(F.try_divide(f"c{k}", "c0"), 2) / (F.col("n") - k) for k in range(1, lags + 1))
    return c.where(F.col("n") > lags).select("ticker", (F.col("n") * (F.col("n") + 2) * q).alias("q"))


def standardised(r: np.ndarray) -> np.ndarray:
    """Residuals of an AR(1)-GARCH(1,1) with skewed t errors over their conditional deviation; one fewer than returns."""
    return garch.fitted(r, gjr=False, ar=True).standardised(r)


def margins(x: np.ndarray, kind: str = "fitted") -> tuple[np.ndarray, np.ndarray]:
    """(standardised residuals, uniform values) of the columns: through each margin's own skewed t ("fitted"), or by ranks ("ranks")."""
    found = [garch.fitted(x[:, i], gjr=False, ar=True) for i in range(x.shape[1])]
    z = np.column_stack([f.standardised(x[:, i]) for i, f in enumerate(found)])
    if kind == "ranks":
        return z, copula.ranks(z)
    return z, np.column_stack([garch.distribution(z[:, i], f.e, f.skew) for i, f in enumerate(found)])


def _wide(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    wide = pdf.pivot(index="t", columns="ticker", values="ret").sort_index()
    return list(wide.columns), wide.to_numpy(float)


def copula_correlations(chosen: DataFrame, rets: DataFrame, kind: str = "fitted") -> DataFrame:
    """(portfolio_id, ti, tj, rho): the t copula's correlation; the sample correlation where the fit fails."""
    ship(rets.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = _wide(pdf)
        try:
            rho = copula.fitted(margins(x, kind)[1]).rho
            if not np.isfinite(rho).all():
                raise ValueError("not finite")
        except (ValueError, np.linalg.LinAlgError):
            rho = np.nan_to_num(np.corrcoef(x.T).reshape(len(names), len(names)), nan=0.0)
        i, j = np.meshgrid(range(len(names)), range(len(names)), indexing="ij")
        return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "ti": [names[k] for k in i.ravel()], "tj": [names[k] for k in j.ravel()], "rho": rho.ravel()})

    return chosen.join(rets, "ticker").select("portfolio_id", "ticker", "t", "ret").groupBy("portfolio_id").applyInPandas(run, "portfolio_id string, ti string, tj string, rho double")


def copula_covariances(chosen: DataFrame, rets: DataFrame, variances: DataFrame, kind: str = "fitted") -> DataFrame:
    """(portfolio_id, ti, tj, cov): D R D of each portfolio, R its copula's correlation, D from ``variances`` (ticker, variance; annual, negative ones as 0)."""
    d = variances.select("ticker", F.sqrt(F.greatest("variance", F.lit(0.0))).alias("d"))
    di, dj = d.toDF("ti", "di"), d.toDF("tj", "dj")
    return copula_correlations(chosen, rets, kind).join(di, "ti").join(dj, "tj").select("portfolio_id", "ti", "tj", (F.col("di") * F.col("rho") * F.col("dj")).alias("cov"))


def copula_diagnostics(chosen: DataFrame, rets: DataFrame, lags: int = 10, alpha: float = 0.05, kind: str = "fitted") -> DataFrame:
    """(portfolio_id, ticker, q, p, adequate, gaussian, t, nu): Ljung-Box on each series' squared standardised residuals, and of the portfolio the two copulas' log likelihoods and the t copula's degrees of freedom."""
    ship(rets.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = _wide(pdf)
        z, u = margins(x, kind)
        fit = copula.fitted(u)
        y = z * z - (z * z).mean(axis=0)
        n, c0 = len(z), (y * y).sum(axis=0)
        rho = np.array([(y[k:] * y[:-k]).sum(axis=0) / np.maximum(c0, 1e-300) for k in range(1, lags + 1)])
        q = n * (n + 2) * (rho**2 / (n - np.arange(1, lags + 1))[:, None]).sum(axis=0)
        p = [pvalues.chi2_sf(float(v), lags) for v in q]
        return pd.DataFrame({"portfolio_id": pdf["portfolio_id"].iloc[0], "ticker": names, "q": q, "p": p, "adequate": [v >= alpha for v in p], "gaussian": fit.gaussian, "t": fit.loglik, "nu": fit.nu})

    series = chosen.join(rets, "ticker").select("portfolio_id", "ticker", "t", "ret")
    return series.groupBy("portfolio_id").applyInPandas(run, "portfolio_id string, ticker string, q double, p double, adequate boolean, gaussian double, t double, nu double")


def arima_orders(laid: DataFrame, most_p: int = 5, most_q: int = 5, criterion: str = "aic", least: int = 30) -> DataFrame:
    """(ticker, p, d, q, loglik, criterion, level, variance, ar, ma): the model chosen for each price series; series too short for one have none."""
    ship(laid.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["close"].dropna().to_numpy(float)
        try:
            if len(y) < least:
                raise ValueError("too short")
            _, d, m = arima.forecast(y, 1, most_p=most_p, most_q=most_q, criterion=criterion)
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame()
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "p": m.p, "d": d, "q": m.q, "loglik": -m.deviance / 2, "criterion": m.criterion, "level": m.level, "variance": m.variance, "ar": [m.phi.tolist()], "ma": [m.theta.tolist()]})

    schema = "ticker string, p int, d int, q int, loglik double, criterion double, level double, variance double, ar array<double>, ma array<double>"
    return laid.select("ticker", "t", "close").groupBy("ticker").applyInPandas(run, schema)


def garch_fits(rets: DataFrame) -> DataFrame:
    """(ticker, constant, omega, alpha, gamma, beta, nu, skew, loglik, normal_loglik): the GJR-GARCH of each return series in per cent; nu is null for normal tails."""
    ship(rets.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = 100 * pdf.sort_values("t")["ret"].to_numpy(float)
        try:
            f, g = garch.fitted(r), garch.fitted(r, errors="normal")
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame()
        nu = 1 / f.e if f.e >= garch.LEAST_E else np.nan
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "constant": f.constant, "omega": f.omega, "alpha": f.alpha, "gamma": f.gamma, "beta": f.beta, "nu": nu, "skew": f.skew, "loglik": f.loglik, "normal_loglik": g.loglik})

    schema = "ticker string, constant double, omega double, alpha double, gamma double, beta double, nu double, skew double, loglik double, normal_loglik double"
    return rets.select("ticker", "t", "ret").groupBy("ticker").applyInPandas(run, schema)
