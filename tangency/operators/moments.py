"""Returns and their moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.durable import written
from tangency.operators import clean
from tangency.session import ship

YEAR = 252
MANY = 400  # tickers from which covariances are summed up in blocks


def log_returns(laid: DataFrame, drop_first: bool = False, fill: bool = True) -> DataFrame:
    """(ticker, t, date, ret): ln of the price ratio; the first row and undefined ratios are 0, or null without ``fill``."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("t"))
    ret = F.ln(F.try_divide("close", before))
    out = laid.select("ticker", "t", "date", (F.coalesce(ret, F.lit(0.0)) if fill else ret).alias("ret"))
    return out.where("t > 0") if drop_first else out


def expected(rets: DataFrame, year: int = YEAR, tiny: float | None = None) -> DataFrame:
    mean = F.avg("ret")
    mu = F.when(F.abs(mean) < tiny, 0.0).otherwise(mean * year) if tiny else mean * year
    return rets.groupBy("ticker").agg(mu.alias("mu"))


def variances(rets: DataFrame, year: int = YEAR) -> DataFrame:
    return rets.groupBy("ticker").agg((F.var_samp("ret") * year).alias("variance"))


def with_forecast(history: DataFrame, forecast: DataFrame, ceiling: float = 0.5) -> DataFrame:
    """History's mu, replaced by a forecast that exists and is at most ``ceiling``."""
    f = forecast.select("ticker", F.col("mu").alias("f"))
    bad = F.col("f").isNull() | F.isnan("f") | (F.col("f") > ceiling)
    return history.join(f, "ticker", "left").select("ticker", F.when(bad, F.col("mu")).otherwise(F.col("f")).alias("mu"))


def covariance_matrix(rets: DataFrame, year: int = YEAR) -> DataFrame:
    """(ti, tj, cov) of all ordered pairs, by the form that fits the number of tickers; ``rets`` should be a table, it is read twice."""
    return covariances_gram(rets, year) if rets.select("ticker").distinct().count() > MANY else covariances(rets, year)


def covariances(rets: DataFrame, year: int = YEAR) -> DataFrame:
    """(ti, tj, cov) of all ordered pairs: half of the pairs by a join on the date, then mirrored.  For some hundreds of tickers."""
    a = rets.select(F.col("ticker").alias("ti"), "t", F.col("ret").alias("x"))
    b = rets.select(F.col("ticker").alias("tj"), "t", F.col("ret").alias("y"))
    half = a.join(b, "t").where("ti <= tj").groupBy("ti", "tj").agg((F.covar_samp("x", "y") * year).alias("cov"))
    return half.select("ti", "tj", F.explode(F.when(F.col("ti") == F.col("tj"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("swap"), "cov").select(
        F.when(F.col("swap"), F.col("tj")).otherwise(F.col("ti")).alias("ti"), F.when(F.col("swap"), F.col("ti")).otherwise(F.col("tj")).alias("tj"), "cov"
    )


def covariances_gram(rets: DataFrame, year: int = YEAR, block: int = 512, days: int = 2048) -> DataFrame:
    """The same for thousands of tickers and more, tile by tile.

    A tile is up to ``block`` tickers by up to ``days`` dates, centred; it is sent once to each pair of tiles it is in.  Products are keyed by (tile i, tile j, dates) and summed by
    (tile i, tile j): a task holds two tiles and one square of ``block`` tickers, whatever the universe, and as many tasks run as there are pairs of tiles.
    """
    ship(rets.sparkSession)
    places = written(rets.groupBy("ticker").agg(F.avg("ret").alias("mean")), "means")
    count = places.count()
    dates = written(rets.select("t").distinct(), "dates")
    n_days = dates.count()
    # tickers and dates are numbered by ranges of their order: a window over each of some thousands
    order = lambda df, key: df.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1)
    names = order(places, "ticker").select("ticker", "mean", F.floor(F.col("at") / block).cast("int").alias("tile"), (F.col("at") % block).cast("int").alias("col"))
    times = order(dates, "t").select("t", F.floor(F.col("at") / days).cast("int").alias("chunk"), (F.col("at") % days).cast("int").alias("row"))
    tiles = -(-count // block)
    cells = rets.join(names, "ticker").join(times, "t").select("tile", "chunk", "col", "row", (F.col("ret") - F.col("mean")).alias("x"))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1))
        x[pdf["row"].to_numpy(), pdf["col"].to_numpy()] = pdf["x"].to_numpy(float)
        return pd.DataFrame({"tile": [key[0]], "chunk": [key[1]], "high": [x.shape[0]], "wide": [x.shape[1]], "x": [x.tobytes()]})

    packs = cells.groupBy("tile", "chunk").applyInPandas(packed, "tile int, chunk int, high int, wide int, x binary")
    pair = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(tiles - 1, 0)))))
    pair = pair.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "chunk", "tile", "high", "wide", "x")

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        of = {int(r.tile): np.frombuffer(r.x).reshape(r.high, r.wide) for r in pdf.itertuples()}
        if key[0] not in of or key[1] not in of:
            return pd.DataFrame({"i": [], "j": [], "high": [], "wide": [], "sums": []})  # one of the two has no rows at these dates
        a, b = of[key[0]], of[key[1]]
        rows = min(len(a), len(b))
        c = a[:rows].T @ b[:rows]
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "high": [c.shape[0]], "wide": [c.shape[1]], "sums": [c.tobytes()]})

    products = pair.groupBy("i", "j", "chunk").applyInPandas(product, "i int, j int, high int, wide int, sums binary")

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        high, wide = int(pdf["high"].max()), int(pdf["wide"].max())
        c = np.zeros((high, wide))
        for r in pdf.itertuples():
            c[: r.high, : r.wide] += np.frombuffer(r.sums).reshape(r.high, r.wide)
        c *= year / max(n_days - 1, 1)
        a, b = np.divmod(np.arange(c.size), wide)
        half = a <= b if key[0] == key[1] else np.ones(c.size, bool)
        return pd.DataFrame({"i": key[0], "ci": a[half], "j": key[1], "cj": b[half], "cov": c.ravel()[half]})

    half = products.groupBy("i", "j").applyInPandas(total, "i int, ci int, j int, cj int, cov double")
    own = names.select("ticker", "tile", "col")
    named = half.join(own.toDF("ti", "i", "ci"), ["i", "ci"]).join(own.toDF("tj", "j", "cj"), ["j", "cj"]).select("ti", "tj", "cov")
    both = F.when(F.col("ti") == F.col("tj"), F.array(F.struct("ti", "tj"))).otherwise(F.array(F.struct("ti", "tj"), F.struct(F.col("tj").alias("ti"), F.col("ti").alias("tj"))))
    return named.select(F.explode(both).alias("x"), "cov").select("x.ti", "x.tj", "cov")


@dataclass(frozen=True)
class Inputs:
    """What an optimisation starts from: returns, expected returns and forecast variances (None: the sample's)."""

    rets: DataFrame
    mu: DataFrame
    variances: DataFrame | None


def inputs(prices: DataFrame | None, forecast: DataFrame | None = None, rule: str = "int", share: float = 0.95) -> Inputs:
    """Cleans ``prices`` and takes their moments; ``forecast`` (ticker, mu, variance) takes the place of history where it can be told, and all of it where it is missing.

    No prices, an empty table, or one in which no ticker is covered, is a ValueError.
    """
    if prices is None or prices.isEmpty():
        raise ValueError("no prices")
    rets = written(log_returns(clean.cleaned(written(prices, "prices"), rule, share)), "returns")
    if rets.isEmpty():
        raise ValueError("no ticker has enough prices")
    history = expected(rets)
    if forecast is None or forecast.isEmpty():
        return Inputs(rets, history, None)
    return Inputs(rets, with_forecast(history, forecast), forecast.select("ticker", "variance"))


def correlations(cov: DataFrame) -> DataFrame:
    """(ti, tj, rho); null where a series has no variance."""
    d = cov.where("ti = tj")
    si, sj = d.select("ti", F.sqrt("cov").alias("si")), d.select(F.col("ti").alias("tj"), F.sqrt("cov").alias("sj"))
    return cov.join(si, "ti").join(sj, "tj").select("ti", "tj", F.try_divide("cov", F.col("si") * F.col("sj")).alias("rho"))


def constant_correlation(cov: DataFrame, rho: DataFrame, forecast: DataFrame) -> DataFrame:
    """D R D with D from forecast variances (negatives as 0); the sample matrix if any ticker lacks a forecast."""
    lacking = cov.select(F.col("ti").alias("ticker")).distinct().join(forecast.where("variance is not null"), "ticker", "left_anti").agg(F.count("*").alias("lacking"))
    d = forecast.select("ticker", F.sqrt(F.greatest("variance", F.lit(0.0))).alias("d"))
    di, dj = d.select(F.col("ticker").alias("ti"), F.col("d").alias("di")), d.select(F.col("ticker").alias("tj"), F.col("d").alias("dj"))
    joined = cov.join(rho, ["ti", "tj"]).join(di, "ti", "left").join(dj, "tj", "left").join(F.broadcast(lacking), F.lit(True))
    return joined.select("ti", "tj", F.when(F.col("lacking") > 0, F.col("cov")).otherwise(F.col("di") * F.col("rho") * F.col("dj")).alias("cov"))
