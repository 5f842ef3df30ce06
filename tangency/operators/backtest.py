"""Backtests of drifting weights and their risk metrics, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tangency.durable import written
from tangency.operators import clean, moments
from tangency.operators import forecast as forecast_
from tangency.operators.search import CARDINALITY, Box, Genetic, Inputs, Rules, cardinality_portfolios, subsets
from tangency.operators.weights import optimal_weights, random_weights

YEAR = 252


def path(held: DataFrame, rets: DataFrame) -> DataFrame:
    """(portfolio_id, step, ret, degenerate): weights drift with e^r and are not rebalanced.

    With C the log return before a step and S = sum of w e^C r, the step's return is S / (1 + the S of the steps before): two
    cumulative sums instead of a recursion.  ``degenerate`` marks paths whose value reaches zero.
    """
    own = held.join(rets, "ticker")
    w = Window.partitionBy("portfolio_id", "ticker").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    grown = own.withColumn("c", F.coalesce(F.sum("ret").over(w), F.lit(0.0)))
    s = grown.groupBy("portfolio_id", "t").agg(F.sum(F.col("weight") * F.exp("c") * F.col("ret")).alias("s"))
    v = Window.partitionBy("portfolio_id").orderBy("t")
    valued = s.withColumn("n", 1 + F.coalesce(F.sum("s").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return valued.select("portfolio_id", (F.row_number().over(v) - 1).alias("step"), F.try_divide("s", "n").alias("ret"), (F.min("n").over(Window.partitionBy("portfolio_id")) <= 0).alias("degenerate"))


def drawdown_compat(steps: DataFrame) -> DataFrame:
    """The worst one-step loss after the first step: what comparing with the previous value, not the peak, amounts to."""
    loss = F.min(F.when(F.col("step") > 0, F.exp("ret") - 1))
    return steps.groupBy("portfolio_id").agg(F.least(F.lit(0.0), F.coalesce(loss, F.lit(0.0))).alias("mdd"))


def drawdown(steps: DataFrame) -> DataFrame:
    """The largest fall of the cumulative value from its running peak (the start counts as one)."""
    v = Window.partitionBy("portfolio_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    valued = steps.withColumn("value", F.exp(F.sum("ret").over(v)))
    peaks = valued.withColumn("peak", F.greatest(F.max("value").over(v), F.lit(1.0)))
    return peaks.groupBy("portfolio_id").agg(F.least(F.lit(0.0), F.min(F.col("value") / F.col("peak") - 1)).alias("mdd"))


def metrics(steps: DataFrame, mar: float = 0.0, compat: bool = True, annualise_downside: bool = False, year: int = YEAR) -> DataFrame:
    """(portfolio_id, ret, std, sharpe, downside, sortino, mdd, calmar); standard deviations are of the population."""
    under = F.when(F.col("ret") < mar, F.pow(F.col("ret") - mar, 2)).otherwise(0.0)
    base = steps.groupBy("portfolio_id").agg((F.avg("ret") * year).alias("ret"), (F.stddev_pop("ret") * F.sqrt(F.lit(float(year)))).alias("std"), F.sqrt(F.avg(under)).alias("downside"))
    if annualise_downside:
        base = base.withColumn("downside", F.col("downside") * F.sqrt(F.lit(float(year))))
    all_ = base.join(drawdown_compat(steps) if compat else drawdown(steps), "portfolio_id")
    safe = lambda a, b: F.when(F.abs(b) < 1e-12, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return all_.select("portfolio_id", "ret", "std", safe(F.col("ret"), F.col("std")).alias("sharpe"), "downside", safe(F.col("ret") - mar, F.col("downside")).alias("sortino"), "mdd", safe(F.col("ret"), -F.col("mdd")).alias("calmar"))


def arms(values: DataFrame) -> DataFrame:
    """(category, value) summed up by category, with population moments."""
    return values.groupBy("category").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def six_arms(spark: SparkSession, laid: DataFrame, forecast: DataFrame, portfolios: int = 20, rules: Rules = Rules(8, 20, None), genetic: Genetic = CARDINALITY, box: Box = Box(), skip: int = 252, leave: int = 252, seed: int = 0) -> DataFrame:
    """(category, idx, ret, std, sharpe, downside, sortino, mdd, calmar, holdings): portfolios made from training rows, evaluated on the ``leave`` rows after them.

    Training rows are ordinals ``skip`` to all but the last ``leave`` of ``laid`` (ticker, t, date, close).  Choices: by search on history (cc), by search with ``forecast``
    (ticker, mu, variance) and constant correlation (cc_forecast), at random.  Weights: optimised, optimised with copula correlations, random.
    """
    rets = written(moments.log_returns(laid), "returns")
    train = written(moments.log_returns(clean.split(laid, skip, leave)), "training")
    if train.isEmpty():
        raise ValueError("no rows to train on")
    mu, cov = written(moments.expected(train), "mu"), written(moments.covariance_matrix(train), "cov")
    mu_f = written(moments.with_forecast(mu, forecast), "mu-forecast")
    cov_f = written(moments.constant_correlation(cov, moments.correlations(cov), forecast), "cov-forecast")
    x = Inputs.of(mu, cov)
    seeds = [seed * 1000 + i for i in range(portfolios)]
    named = lambda df, category: df.select(F.concat(F.lit(f"{category}:"), "portfolio").alias("portfolio_id"), "ticker")
    cc = written(cardinality_portfolios(spark, x, rules, genetic, seeds, box).select("portfolio", "ticker"), "cc")
    cc_f = written(cardinality_portfolios(spark, Inputs.of(mu_f, cov_f), rules, genetic, seeds, box).select("portfolio", "ticker"), "cc-forecast")
    picked = written(subsets(spark.range(portfolios).withColumnRenamed("id", "candidate_id"), mu.select("ticker"), min(rules.least, len(x.names)), min(rules.most, len(x.names)), seed).withColumnRenamed("candidate_id", "portfolio"), "random")
    plain, formed = named(cc, "cc_optimised").unionByName(named(picked, "random_optimised")), named(cc_f, "cc_forecast")
    copulae = named(cc, "cc_copulae")
    own_var = cov.where("ti = tj").select(F.col("ti").alias("ticker"), F.col("cov").alias("variance"))
    # all optimised arms are solved together, each portfolio with its arm's returns and covariances
    pairs = lambda chosen, c: chosen.withColumnRenamed("ticker", "ti").join(chosen.withColumnRenamed("ticker", "tj"), "portfolio_id").join(c, ["ti", "tj"]).select("portfolio_id", "ti", "tj", "cov")
    cells = pairs(plain, cov).unionByName(pairs(formed, cov_f)).unionByName(forecast_.copula_covariances(copulae, train, own_var))
    returns = plain.unionByName(copulae).join(mu, "ticker").unionByName(formed.join(mu_f, "ticker"))
    held = optimal_weights(written(plain.unionByName(copulae).unionByName(formed), "optimised"), returns, cells).select("portfolio_id", "ticker", "weight")
    held = held.unionByName(random_weights(named(cc, "cc_random_weights"), seed)).unionByName(random_weights(named(picked, "random_random"), seed))
    held = written(held, "arms")
    last = rets.agg((F.max("t") + 1 - leave).alias("edge"))
    steps = written(path(held, rets.join(F.broadcast(last), F.col("t") >= F.col("edge")).drop("edge")), "steps")
    own = held.groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct("ticker", "weight"))).alias("holdings"))
    parts = F.split("portfolio_id", ":")
    return metrics(steps).join(own, "portfolio_id").select(parts[0].alias("category"), parts[1].cast("int").alias("idx"), "ret", "std", "sharpe", "downside", "sortino", "mdd", "calmar", "holdings")


def mean_difference(values: DataFrame) -> DataFrame:
    """(a, b, t): difference of means over the root of summed population variances by size, for each pair of categories."""
    g = values.groupBy("category").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("n"))
    a = g.select(F.col("category").alias("a"), F.col("m").alias("m1"), (F.col("v") / F.col("n")).alias("q1"))
    b = g.select(F.col("category").alias("b"), F.col("m").alias("m2"), (F.col("v") / F.col("n")).alias("q2"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.try_divide(F.col("m2") - F.col("m1"), F.sqrt(F.col("q1") + F.col("q2"))).alias("t"))
