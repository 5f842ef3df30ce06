"""Portfolio evaluation over (portfolio_id, ticker, weight) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def returns_of(held: DataFrame, mu: DataFrame) -> DataFrame:
    return held.join(mu, "ticker").groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))


def _pairs(held: DataFrame, cov: DataFrame) -> DataFrame:
    i = held.select("portfolio_id", F.col("ticker").alias("ti"), F.col("weight").alias("wi"))
    j = held.select("portfolio_id", F.col("ticker").alias("tj"), F.col("weight").alias("wj"))
    return i.join(j, "portfolio_id").join(cov, ["ti", "tj"])


def variance_of(held: DataFrame, cov: DataFrame) -> DataFrame:
    return _pairs(held, cov).groupBy("portfolio_id").agg(F.sum(F.col("wi") * F.col("cov") * F.col("wj")).alias("variance"))


def sharpe(ret: Column, vol: Column, rf: float = 0.0) -> Column:
    """Excess return over volatility; zero without volatility."""
    return F.when(vol > 0, F.try_divide(ret - F.lit(rf), vol)).otherwise(F.lit(0.0))


def evaluated(held: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.0) -> DataFrame:
    """(portfolio_id, ret, variance, vol, sharpe)."""
    both = returns_of(held, mu).join(variance_of(held, cov), "portfolio_id")
    vol = F.sqrt(F.greatest("variance", F.lit(0.0)))
    return both.select("portfolio_id", "ret", "variance", vol.alias("vol"), sharpe(F.col("ret"), vol, rf).alias("sharpe"))


def negative_sharpe(held: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio_id, objective): the ratio as what a minimiser is given."""
    return evaluated(held, mu, cov).select("portfolio_id", (-F.col("sharpe")).alias("objective"))


def equal_weight_fitness(chosen: DataFrame, mu: DataFrame, cov: DataFrame, least: int, most: int, min_return: float | None, penalty: float = -1e4) -> DataFrame:
    """(candidate_id, k, ret, variance, fitness) of equal weights over (candidate_id, ticker); penalties go before the covariance is joined."""
    sums = chosen.join(mu, "ticker").groupBy("candidate_id").agg(F.count("*").alias("k"), F.avg("mu").alias("ret"))
    bad = ~F.col("k").between(least, most)
    if min_return is not None:
        bad = bad | (F.col("ret") < min_return)
    sums = sums.withColumn("bad", bad)
    live = chosen.join(sums.where(~F.col("bad")).select("candidate_id"), "candidate_id", "left_semi")
    i, j = live.withColumnRenamed("ticker", "ti"), live.withColumnRenamed("ticker", "tj")
    var = i.join(j, "candidate_id").join(cov, ["ti", "tj"]).groupBy("candidate_id").agg(F.sum("cov").alias("total"))
    variance = F.try_divide(F.col("total"), F.col("k") * F.col("k"))
    fitness = F.when(F.col("bad"), F.lit(penalty)).when(F.coalesce(variance, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.try_divide("ret", F.sqrt(F.abs(variance))))
    return sums.join(var, "candidate_id", "left").select("candidate_id", "k", "ret", variance.alias("variance"), fitness.alias("fitness"))


def risk_contributions(held: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio_id, ticker, rc): weight times marginal risk over volatility; zeros without variance."""
    rows = _pairs(held, cov).groupBy("portfolio_id", F.col("ti").alias("ticker"), "wi").agg(F.sum(F.col("cov") * F.col("wj")).alias("marginal"))
    total = rows.groupBy("portfolio_id").agg(F.sum(F.col("wi") * F.col("marginal")).alias("variance"))
    rc = F.when(F.col("variance") > 0, F.try_divide(F.col("wi") * F.col("marginal"), F.sqrt(F.abs("variance")))).otherwise(F.lit(0.0))
    return rows.join(total, "portfolio_id").select("portfolio_id", "ticker", rc.alias("rc"))


def risk_budget(rc: DataFrame) -> DataFrame:
    """Squared distance of contributions from an equal budget of the volatility."""
    total = rc.groupBy("portfolio_id").agg(F.sum("rc").alias("vol"), F.count("*").alias("n"))
    gap = F.col("rc") - F.col("vol") / F.col("n")
    return rc.join(total, "portfolio_id").groupBy("portfolio_id").agg(F.sum(gap * gap).alias("objective"))


def allocation(held: DataFrame, amount: float = 5000.0, least: float = 1e-4) -> DataFrame:
    return held.where(F.col("weight") > least).select("portfolio_id", "ticker", "weight", (F.col("weight") * amount).alias("amount"))
