"""Registered queries: each operator on panels derived from the tables, doubles rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tangency.durable import new_path, written
from tangency.functions.randomness import uniform
from tangency.operators import backtest, clean, eda, forecast, moments, portfolio, search, stats, universe, weights
from tangency.plans import benchmark
from tangency.sources import panels
from tangency.sources.panels import table
from tangency.sources.store import Store

SEED = 7
MONTE_CARLO_TRIALS = 20_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d))
    return f


# --------------------------------------------------------------------------------------------- shared pieces

# Panels, returns and covariances are small beside the tables they come from and are read several times: each is written once a query.


def brand_month(s: SparkSession, d: str) -> DataFrame:
    return written(panels.brand_month(s, d), "brand-month")


def user_day(s: SparkSession, d: str) -> DataFrame:
    return written(panels.user_day(s, d), "user-day")


def type_day(s: SparkSession, d: str) -> DataFrame:
    return written(panels.type_day(s, d), "type-day")


def brands(s: SparkSession, d: str) -> DataFrame:
    return clean.cleaned(brand_month(s, d))


def types(s: SparkSession, d: str) -> DataFrame:
    return clean.cleaned(type_day(s, d))


def rets(s: SparkSession, d: str) -> DataFrame:
    return written(moments.log_returns(brands(s, d)), "returns")


def covs(r: DataFrame) -> DataFrame:
    return written(moments.covariance_matrix(r), "covariances")


def store(s: SparkSession) -> Store:
    """A new, empty store."""
    return Store(s, new_path(s, "store"))


def chosen(s: SparkSession, r: DataFrame) -> DataFrame:
    """Eight random portfolios of 3 to 6 tickers."""
    ids = s.range(8).withColumnRenamed("id", "candidate_id")
    picked = search.subsets(ids, r.select("ticker").distinct(), 3, 6, SEED)
    return picked.select(F.concat(F.lit("p"), "candidate_id").alias("portfolio_id"), "ticker")


def held(s: SparkSession, r: DataFrame) -> DataFrame:
    return weights.random_weights(chosen(s, r), SEED)


def runs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("algorithm"), (F.col("user_id") % 30).alias("seed")).agg(F.max("value").alias("fitness"))


def records(s: SparkSession, d: str) -> DataFrame:
    """Time in days since 2024-01-01."""
    e = table(s, d, "events")
    time = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(86400e6)
    one = e.select(F.col("event_type").alias("algorithm"), (F.col("user_id") % 30).alias("seed"), time.alias("time"), "value").groupBy("algorithm", "seed", "time").agg(F.max("value").alias("best"))
    return stats.best_so_far(one)


BUDGET = 30.0

# --------------------------------------------------------------------------------------------------- cleaning


@query
def panel_brand_month(s, d):
    return panels.brand_month(s, d).select("ticker", "date", F.ln("close").alias("log_close"))


@query
def coverage_filter(s, d):
    return clean.covered(user_day(s, d), "int", 0.9)


@query
def coverage_variants(s, d):
    p = user_day(s, d)
    out = None
    for rule, share in (("int", 0.95), ("exact", 0.95), ("tenth", 0.1), ("int", 0.9), ("nulls", 0.98)):
        one = clean.covered(p, rule, share).agg(F.countDistinct("ticker").alias("tickers")).withColumn("rule", F.lit(f"{rule} {share}"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def last_n_days(s, d):
    return clean.last_days(user_day(s, d), 10)


@query
def ffill_panel(s, d):
    return clean.forward_fill(clean.grid(user_day(s, d)))


@query
def bfill_panel(s, d):
    return clean.backward_fill(clean.forward_fill(clean.grid(user_day(s, d))))


@query
def zero_filled(s, d):
    return clean.zero_fill(clean.grid(user_day(s, d)))


@query
def train_split(s, d):
    return clean.split(types(s, d), 5, 10)


@query
def wide_to_long(s, d):
    wide = written(clean.grid(type_day(s, d)), "grid").groupBy("date").pivot("ticker").agg(F.first("close"))
    return wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "ticker", "close").where("close is not null")


@query
def restrict_universe(s, d):
    keep = table(s, d, "part").where("p_size > 45").select(F.col("p_brand").alias("ticker")).distinct()
    return universe.restrict(panels.brand_month(s, d), keep).select("ticker", "date", F.ln("close").alias("log_close"))


# -------------------------------------------------------------------------------------------------- moments


@query
def log_returns(s, d):
    return rets(s, d)


@query
def log_returns_drop_first(s, d):
    return moments.log_returns(brands(s, d), drop_first=True, fill=False)


@query
def expected_returns(s, d):
    return moments.expected(rets(s, d))


@query
def expected_returns_tiny(s, d):
    return moments.expected(rets(s, d), tiny=2.22e-16)


@query
def variances(s, d):
    return moments.variances(rets(s, d))


@query
def cov_matrix(s, d):
    return moments.covariance_matrix(rets(s, d))


@query
def cov_matrix_gram(s, d):
    return moments.covariances_gram(rets(s, d))


@query
def cov_matrix_daily(s, d):
    return moments.covariances(written(moments.log_returns(brands(s, d), drop_first=True), "returns"), 1)


@query
def corr_matrix(s, d):
    return moments.correlations(covs(rets(s, d)))


def some_forecasts(mu: DataFrame, var: DataFrame) -> DataFrame:
    """Forecasts for the tests of overrides: hashed, some over the ceiling, some missing."""
    u = uniform(SEED, "forecast", F.col("ticker"))
    return mu.join(var, "ticker").select("ticker", F.when(u < 0.8, u).alias("mu"), (F.col("variance") * (0.5 + u)).alias("variance"))


@query
def forecast_override(s, d):
    r = rets(s, d)
    mu = moments.expected(r)
    return moments.with_forecast(mu, some_forecasts(mu, moments.variances(r)))


@query
def ccc_cov(s, d):
    r = rets(s, d)
    cov = covs(r)
    return moments.constant_correlation(cov, moments.correlations(cov), some_forecasts(moments.expected(r), moments.variances(r)))


@query
def ccc_cov_fallback(s, d):
    r = rets(s, d)
    cov = covs(r)
    f = some_forecasts(moments.expected(r), moments.variances(r)).where(uniform(SEED, "lack", F.col("ticker")) < 0.5)
    return moments.constant_correlation(cov, moments.correlations(cov), f)


# ------------------------------------------------------------------------------------------------ portfolios


@query
def equal_weight_sharpe(s, d):
    r = rets(s, d)
    own = r.select("ticker").distinct().withColumn("candidate_id", F.lit(0))
    f = portfolio.equal_weight_fitness(own, moments.expected(r), covs(r), 1, 10**6, None)
    return f.select("k", "ret", F.sqrt("variance").alias("vol"), F.col("fitness").alias("sharpe"))


@query
def random_weights(s, d):
    return held(s, rets(s, d))


@query
def portfolio_moments(s, d):
    r = rets(s, d)
    return portfolio.evaluated(held(s, r), moments.expected(r), covs(r), 0.01)


@query
def risk_contribution(s, d):
    r = rets(s, d)
    return portfolio.risk_contributions(held(s, r), covs(r))


@query
def risk_budget(s, d):
    r = rets(s, d)
    return portfolio.risk_budget(portfolio.risk_contributions(held(s, r), covs(r)))


@query
def allocation_report(s, d):
    return portfolio.allocation(held(s, rets(s, d)), 5000.0, 0.05)


@query
def equal_weight_fitness(s, d):
    r = rets(s, d)
    mu = moments.expected(r)
    cand = search.bernoulli(s.range(200).withColumnRenamed("id", "candidate_id"), mu, 5, 12, SEED)
    return portfolio.equal_weight_fitness(cand, mu, covs(r), 3, 6, -5.0)


# ---------------------------------------------------------------------------------------------------- search


@query
def ga_init(s, d):
    return search.bernoulli(s.range(50).withColumnRenamed("id", "candidate_id"), brands(s, d).select("ticker").distinct(), 5, 12, SEED)


@query
def ga_init_least(s, d):
    return search.bernoulli(s.range(50).withColumnRenamed("id", "candidate_id"), brands(s, d).select("ticker").distinct(), 3, 12, SEED, 4)


@query
def mc_candidates(s, d):
    return search.subsets(s.range(100).withColumnRenamed("id", "candidate_id"), brands(s, d).select("ticker").distinct(), 3, 10, SEED)


@query
def mc_best(s, d):
    r = rets(s, d)
    f = search.monte_carlo(s, moments.expected(r), covs(r), MONTE_CARLO_TRIALS, 3, 10, SEED)
    return f.orderBy(F.desc(F.round("fitness", 9)), "candidate_id").limit(5).select("candidate_id", "k", "fitness")  # equal subsets differ in the last bits


@query
def milp_select(s, d):
    r = rets(s, d)
    vol = moments.variances(r).select("ticker", F.sqrt("variance").alias("vol"))
    return search.milp(moments.expected(r).withColumn("mu", F.col("mu") + 20), vol, 0.8, 10)


def scored(s: SparkSession) -> DataFrame:
    """Forty hashed fitnesses on four islands."""
    return s.range(40).select(F.col("id").alias("candidate_id"), (F.col("id") % 4).alias("island"), uniform(SEED, "fitness", F.col("id")).alias("fitness"))


def rated(s: SparkSession, d: str) -> DataFrame:
    """Four hundred candidates on four islands, with their fitness."""
    r = rets(s, d)
    f = search.monte_carlo(s, moments.expected(r), covs(r), 400, 3, 10, SEED)
    return f.select("candidate_id", (F.col("candidate_id") % 4).alias("island"), F.round("fitness", 9).alias("fitness"))  # equal subsets differ in the last bits


@query
def ga_select(s, d):
    return search.best(rated(s, d), 3).select("island", "candidate_id", "rank")


@query
def ga_migrate(s, d):
    return search.migrants(rated(s, d), 4, 2)


def offspring(s: SparkSession, d: str) -> DataFrame:
    tickers = brands(s, d).select("ticker").distinct()
    genes = search.bernoulli(s.range(40).withColumnRenamed("id", "candidate_id"), tickers, 5, 12, SEED)
    return search.crossover(search.best(scored(s), 4), genes, tickers, 10, SEED)


@query
def ga_crossover(s, d):
    return offspring(s, d)


@query
def ga_mutate(s, d):
    return search.mutate(offspring(s, d), 0.1, SEED)


# -------------------------------------------------------------------------------------------------- backtests


def steps(s: SparkSession, d: str) -> DataFrame:
    r = written(moments.log_returns(types(s, d)), "returns")
    return backtest.path(held(s, r), r.withColumn("ret", F.col("ret") * 0.1))


@query
def backtest_path(s, d):
    return steps(s, d)


@query
def backtest_metrics(s, d):
    return backtest.metrics(written(steps(s, d), "steps"))


@query
def drawdown_compat(s, d):
    return backtest.drawdown_compat(steps(s, d))


@query
def drawdown_true(s, d):
    return backtest.drawdown(steps(s, d))


def arm_values(s: SparkSession, d: str) -> DataFrame:
    """Sharpe ratios of random portfolios in two arms: random weights and equal ones."""
    r = written(moments.log_returns(types(s, d)), "returns")
    random = held(s, r)
    equal = chosen(s, r).withColumn("weight", 1 / F.count("*").over(Window.partitionBy("portfolio_id")))
    named = lambda df, arm: df.select(F.concat(F.lit(f"{arm}:"), "portfolio_id").alias("portfolio_id"), "ticker", "weight")
    both = named(random, "random_random").unionByName(named(equal, "random_equal"))
    m = backtest.metrics(written(backtest.path(both, r.withColumn("ret", F.col("ret") * 0.1)), "steps"))
    return m.select(F.split("portfolio_id", ":")[0].alias("category"), F.col("sharpe").alias("value"))


@query
def arm_summary(s, d):
    return backtest.arms(arm_values(s, d))


@query
def mean_diff_t(s, d):
    return backtest.mean_difference(written(arm_values(s, d), "arms"))


@query
def six_arms(s, d):
    """At the reference's sizes: 20 portfolios an arm, 100 individuals, 6 generations."""
    laid = written(brands(s, d), "panel")
    r = written(moments.log_returns(clean.split(laid, 0, 24)), "returns")
    f = some_forecasts(moments.expected(r), moments.variances(r))
    return backtest.six_arms(s, laid, f, 20, search.Rules(3, 8, None), search.CARDINALITY, search.Box(0.0, 0.45), 0, 24, SEED)


# --------------------------------------------------------------------------------------------------------- eda


@query
def null_fraction(s, d):
    return eda.null_shares(clean.grid(user_day(s, d)))


@query
def null_fraction_bands(s, d):
    n = eda.null_shares(clean.grid(user_day(s, d)))
    c = F.col("share")
    return n.agg(*[F.count_if(x).alias(a) for x, a in ((c > 0.1, "over_10"), (c > 0.02, "over_2"), ((c > 0.01) & (c < 0.1), "between"))])


@query
def longest_null_run(s, d):
    return eda.longest_null_run(clean.grid(user_day(s, d)))


@query
def describe_runs(s, d):
    return eda.describe(eda.longest_null_run(clean.grid(user_day(s, d))), "longest")


@query
def max_log_return(s, d):
    return eda.extremes(rets(s, d))


@query
def hist_returns(s, d):
    return eda.histogram(rets(s, d), "ret", -1.0, 1.0, 20)


@query
def panel_shape(s, d):
    return eda.shape(clean.grid(user_day(s, d)))


@query
def panel_columns(s, d):
    return eda.columns(clean.grid(user_day(s, d)))


@query
def hist_outside(s, d):
    return eda.outside(rets(s, d), "ret", -0.1, 0.1)


# ------------------------------------------------------------------------------------------------------ statistics


@query
def summary_table(s, d):
    return stats.summary(runs(s, d))


@query
def best_fitness(s, d):
    return runs(s, d).groupBy("algorithm").agg(F.max("fitness").alias("best"))


@query
def friedman(s, d):
    return stats.friedman(runs(s, d))


@query
def friedman_ranks(s, d):
    return stats.mean_ranks(runs(s, d))


@query
def nemenyi_q(s, d):
    return stats.nemenyi(runs(s, d))


@query
def wilcoxon(s, d):
    return stats.wilcoxon(runs(s, d), "click", "view")


@query
def best_so_far(s, d):
    return records(s, d)


@query
def aocc(s, d):
    return stats.aocc(records(s, d), BUDGET, 1000.0)


@query
def convergence_grid(s, d):
    return stats.convergence(records(s, d), BUDGET, 31)


@query
def performance_profile(s, d):
    return stats.performance_profile(records(s, d), BUDGET, 0.95, 10.0, 19)


@query
def wilcoxon_pairs(s, d):
    return stats.wilcoxon_pairs(runs(s, d)).select("a", "b", "pairs", "n", "w")


@query
def box_plot(s, d):
    return stats.boxes(runs(s, d))


@query
def pending_runs(s, d):
    """The runner's work list, every algorithm with every seed, without what a store has: here the runs of even seeds."""
    r = written(runs(s, d), "runs")
    have = store(s)
    have.add("benchmark_runs", r.where("seed % 2 = 0").select("algorithm", "seed", "fitness", F.lit(0.0).alias("seconds"), F.lit("").alias("holdings")), ["algorithm", "seed"])
    names = [x[0] for x in r.select("algorithm").distinct().collect()]  # five event types
    return benchmark.pending(s, have, names, range(30))


# ---------------------------------------------------------------------------------------------- universe, history


@query
def universe_dedupe(s, d):
    parts = [("equity", table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_name").alias("name"))), ("etf", table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.col("c_name").alias("name"))), ("fund", table(s, d, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_name").alias("name")))]
    return universe.universe(parts)


@query
def asset_counts(s, d):
    return universe.counts(universe_dedupe(s, d))


@query
def common_stock_filter(s, d):
    p = table(s, d, "part")
    letters = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 4), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
    flag = lambda c: F.when(c, "Y").otherwise("N")
    #: words of other securities, and names that only look alike; every eleventh name is missing
    words = ["Warrant", "RIGHTS", "Units", "Preferred", "debentures", "Notes", "United", "Bright", "Unity", "Depositary Shares"]
    named = F.when(F.col("p_partkey") % 11 != 10, F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % 10 + 1).cast("int"))))
    listed = p.select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.concat(letters, F.lit(".W"))).otherwise(letters).alias("ticker"), named.alias("name"), flag(F.col("p_size") % 3 != 0).alias("traded"), flag(F.col("p_size") % 11 == 0).alias("etf"), flag(F.col("p_size") % 13 == 0).alias("test"))
    return universe.common_stocks(listed).select("p_partkey", "ticker", "name")


@query
def symbols_sorted(s, d):
    return universe_dedupe(s, d).where("asset_type = 'equity'").select("ticker").orderBy("ticker")


@query
def metadata_filter(s, d):
    from tangency.sources.panels import securities

    c = table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("sector"), F.col("c_nationkey").cast("string").alias("country"))
    return securities(c, sector=["BUILDING", "MACHINERY"], country=None)


@query
def upsert_prices(s, d):
    old = type_day(s, d).withColumn("ingest", F.lit(1))
    new = old.where("dayofmonth(date) % 3 = 0").select("ticker", "date", (F.col("close") + 1).alias("close"), F.lit(2).alias("ingest"))
    return universe.latest_by(old.unionByName(new), ["ticker", "date"], "ingest")


@query
def ensure_tickers(s, d):
    have = store(s)
    have.ensure_tickers(table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker")), "US", "supplier")
    have.ensure_tickers(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker")), "US", "customer")
    return have.read("tickers").where("asset_type = 'customer'").select(F.col("symbol").alias("ticker"))


@query
def load_prices(s, d):
    have = store(s)
    have.save_prices(type_day(s, d), "US", source="events")
    return have.prices("US", "2024-01-05", "2024-01-20", ["click", "view"]).select("ticker", "date", "close")


@query
def load_panel(s, d):
    """Brands' months from the store, in one call: dates, coverage, fill.  A third of the rows are saved a second time, one higher."""
    have = store(s)
    px = brand_month(s, d)
    have.save_prices(px, "US", source="lineitem")
    have.save_prices(px.where("month(date) % 3 = 0").withColumn("close", F.col("close") + 1), "US", source="lineitem")
    return have.panel("US", "1993-01-01", "1997-06-30", None, 0.95)


@query
def save_forecast(s, d):
    r = rets(s, d)
    mu, var = moments.expected(r), moments.variances(r)
    u = uniform(SEED, "null", F.col("ticker"))
    have = store(s)
    return have.forecast(have.save_forecast(mu.where(u < 0.7), var.where(u > 0.3), exchange="US", n_periods=252))


@query
def latest_forecast(s, d):
    """Two forecasts are saved, of the parts of even and of odd orders; the later counts."""
    have, of = store(s), table(s, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("ticker"), (F.col("l_orderkey") % 2).alias("odd"))
    sums = written(of.agg(F.sum("l_extendedprice").alias("mu"), F.sum("l_quantity").alias("variance")), "sums")
    for odd in (0, 1):
        one = sums.where(F.col("odd") == odd)
        have.save_forecast(one.select("ticker", "mu"), one.select("ticker", "variance"), exchange="US")
    return have.forecast()


@query
def recent_runs(s, d):
    have = store(s)
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created"), F.col("o_orderstatus").alias("script"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("params"), F.create_map(F.lit("price"), "o_totalprice").alias("results"))
    have.add("optimisation_runs", o, ["run_id"])
    return have.recent_runs(10, "F").select(F.col("run_id").alias("o_orderkey"), F.col("results")["price"].alias("o_totalprice"))


@query
def run_holdings(s, d):
    have = store(s)
    have.add("portfolio_holdings", table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").cast("string").alias("ticker")).agg(F.sum("l_quantity").alias("weight")))
    return have.holdings(1).select(F.col("ticker").cast("long").alias("l_partkey"), "weight")


@query
def recent_backtests(s, d):
    have = store(s)
    have.add("backtest_sessions", table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("created"), F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("params")), ["session_id"])
    return have.recent_backtests(5).select(F.col("session_id").alias("o_orderkey"), F.col("params")["customer"].cast("long").alias("o_custkey"))


@query
def latest_data_source(s, d):
    have = store(s)
    nothing = lambda kind: F.lit(None).cast(kind)
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.lit("US").alias("exchange"), F.col("o_orderdate").cast("timestamp").alias("downloaded"), nothing("date").alias("first_date"), nothing("date").alias("last_date"), nothing("int").alias("num_tickers"), nothing("long").alias("num_rows"), nothing("string").alias("notes"))
    have.add("data_sources", o, ["id"])
    return have.latest_data_source("1-URGENT").select(F.col("id").alias("o_orderkey"))


@query
def table_counts(s, d):
    """Rows of a store's tables: parts as tickers, customers as sessions, the panel as prices; the others are empty but for the exchanges."""
    have = store(s)
    have.ensure_tickers(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("ticker")), "US", "part")
    have.add("backtest_sessions", table(s, d, "customer").select(F.col("c_custkey").alias("session_id"), F.lit(None).cast("timestamp").alias("created"), F.create_map(F.lit("segment"), "c_mktsegment").alias("params")))
    have.save_prices(type_day(s, d), "US", "part", "events")
    return s.createDataFrame(sorted(have.counts().items()), "name string, n long")


@query
def ljung_box_q(s, d):
    return forecast.ljung_box(rets(s, d))


# -------------------------------------------------------------------------------- solvers and searches (rows only)


@query
def max_sharpe_weights(s, d):
    r = rets(s, d)
    return weights.solve(chosen(s, r), moments.expected(r), covs(r), "sharpe", 0.0, 0.5)


@query
def frontier_corners(s, d):
    r = rets(s, d)
    return weights.corners(chosen(s, r), moments.expected(r), covs(r), 0.0, 0.5)


@query
def target_return_weights(s, d):
    r = rets(s, d)
    return weights.solve(chosen(s, r), moments.expected(r), covs(r), "sharpe", 0.0, 0.6, target_return=0.0)


@query
def risk_parity_weights(s, d):
    r = rets(s, d)
    return weights.solve(chosen(s, r), moments.expected(r), covs(r), "parity", 0.0, 1.0)


@query
def min_return_weights(s, d):
    r = rets(s, d)
    return weights.solve(chosen(s, r), moments.expected(r), covs(r), "sharpe", 0.0, 1.0, min_return=0.12)


@query
def island_ga(s, d):
    """At the reference's sizes: 8,000 individuals, 70 generations."""
    r = rets(s, d)
    x = search.Inputs.of(moments.expected(r), covs(r))
    return search.island_search(s, x, search.Rules(3, 8, None), search.Genetic(population=8000, generations=70, elites=50, islands=8, interval=10, migration=0.1), SEED).drop("seconds")


@query
def best_island(s, d):
    r = rets(s, d)
    x = search.Inputs.of(moments.expected(r), covs(r))
    return search.best_over_islands(search.island_search(s, x, search.Rules(3, 8, None), search.Genetic(population=400, generations=10), SEED))


@query
def monte_carlo_10m(s, d):
    """Ten million trials in blocks; the best and its holdings."""
    r = rets(s, d)
    x = search.Inputs.of(moments.expected(r), covs(r))
    value, names, _ = benchmark._monte_carlo(10_000_000)(s, x, search.Rules(3, 10, None), SEED, None)
    return s.createDataFrame([(value, names)], "fitness double, holdings string")


@query
def cardinality_portfolios(s, d):
    """Choices scored by their best weights: 20 searches of 100 individuals and 6 generations."""
    r = rets(s, d)
    x = search.Inputs.of(moments.expected(r), covs(r))
    return search.cardinality_portfolios(s, x, search.Rules(3, 8, None), search.CARDINALITY, list(range(20)))


@query
def optimal_portfolio_weights(s, d):
    r = rets(s, d)
    return weights.optimal_weights(chosen(s, r), moments.expected(r), covs(r))


@query
def optimisation_inputs(s, d):
    """Expected returns as an optimisation starts from them: history, overridden by forecasts."""
    r = rets(s, d)
    f = written(some_forecasts(moments.expected(r), moments.variances(r)), "forecasts")
    return moments.inputs(panels.brand_month(s, d), f).mu


@query
def generational_ga(s, d):
    r = rets(s, d)
    x = search.Inputs.of(moments.expected(r), covs(r))
    how = search.Genetic(population=100, generations=6, islands=1, migration=0, elites=1, parents=0.1, crossover="point", crossover_rate=0.85, selection="rank", saturate=5)
    return search.island_search(s, x, search.Rules(3, 8, None), how, SEED).drop("seconds")


@query
def series_forecasts(s, d):
    p = brands(s, d)
    return forecast.forecasts(p, moments.log_returns(p))


@query
def copula_corr(s, d):
    r = rets(s, d)
    return forecast.copula_correlations(chosen(s, r), r)


@query
def copula_fit(s, d):
    r = rets(s, d)
    return forecast.copula_diagnostics(chosen(s, r), r)


@query
def arima_models(s, d):
    """The ARIMA of each daily type panel's price series."""
    return forecast.arima_orders(brands(s, d))


@query
def garch_models(s, d):
    return forecast.garch_fits(moments.log_returns(brands(s, d)))


@query
def copula_cov(s, d):
    """Covariances of each portfolio with its copula's correlations and the series' own variances."""
    r = rets(s, d)
    return forecast.copula_covariances(chosen(s, r), r, moments.variances(r))


@query
def negative_sharpe(s, d):
    r = rets(s, d)
    return portfolio.negative_sharpe(weights.random_weights(chosen(s, r), SEED), moments.expected(r), covs(r))


@query
def milp_sharpe(s, d):
    """Of the tickers that ``milp_select`` picks."""
    r = rets(s, d)
    mu, vol = moments.expected(r), moments.variances(r).select("ticker", F.sqrt("variance").alias("vol"))
    return search.milp_sharpe(search.milp(mu.withColumn("mu", F.col("mu") + 20), vol, 0.8, 10), mu, covs(r))


@query
def ga_elites(s, d):
    """The next generation of 200 parents and 200 children."""
    f = written(rated(s, d), "rated")
    return search.survivors(f.where("candidate_id < 200"), f.where("candidate_id >= 200"), 5, 30)


@query
def universe_first_rows(s, d):
    """Brands and types as tickers of one part each: the row of the first part key gives the name."""
    p = table(s, d, "part")
    part = lambda c: p.select(F.col(c).alias("ticker"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return universe.universe([("brand", part("p_brand")), ("type", part("p_type"))])


@query
def arm_backtest(s, d):
    """Two arms of fixed weights through path, metrics and summary."""
    m = backtest.metrics(written(steps(s, d), "steps"))
    arm = F.when(F.substring("portfolio_id", 2, 9).cast("int") % 2 == 0, "cc_random_weights").otherwise("random_random")
    return backtest.arms(m.select(arm.alias("category"), F.col("sharpe").alias("value")))


def kinds(s: SparkSession, d: str) -> DataFrame:
    """Returns of the universe of over a thousand names."""
    px = written(panels.kind_month(s, d), "kind-month")
    return written(moments.log_returns(clean.backward_fill(clean.forward_fill(clean.grid(clean.covered(px, "tenth"), px)))), "returns")


@query
def wide_covariances(s, d):
    """Tile by tile; of each name the sum and the largest of its covariances, and its own."""
    c = moments.covariances_gram(kinds(s, d), block=256)
    return c.groupBy(F.col("ti").alias("ticker")).agg(F.count("*").alias("n"), F.sum("cov").alias("total"), F.max("cov").alias("largest"), F.max(F.when(F.col("ti") == F.col("tj"), F.col("cov"))).alias("own"))


@query
def wide_monte_carlo(s, d):
    """A million trials over the universe of over a thousand names."""
    r = kinds(s, d)
    x = search.Inputs.of(moments.expected(r), written(moments.covariances_gram(r), "covariances"))
    value, names, _ = benchmark._monte_carlo(1_000_000)(s, x, search.Rules(8, 20, None), SEED, None)
    return s.createDataFrame([(value, names)], "fitness double, holdings string")


@query
def wide_cardinality(s, d):
    """Eight searches of 100 individuals and 6 generations over the universe of over a thousand names."""
    r = kinds(s, d)
    x = search.Inputs.of(moments.expected(r), written(moments.covariances_gram(r), "covariances"))
    return search.cardinality_portfolios(s, x, search.Rules(3, 15, None), search.CARDINALITY, list(range(8)))


# Solvers have no SQL; what their results must satisfy has.


def fits(solved: DataFrame, high: float) -> DataFrame:
    """(portfolio_id, n, whole, inside, status): whether weights sum to one and lie in their box."""
    w = F.col("weight")
    return solved.groupBy("portfolio_id").agg(F.count("*").alias("n"), (F.abs(F.sum(w) - 1) < 1e-9).alias("whole"), F.bool_and((w > -1e-9) & (w < high + 1e-9)).alias("inside"), F.max("status").alias("status"))


@query
def max_sharpe_check(s, d):
    """Weights fit, and no single holding mix of the two best corners or equal weights has a larger ratio."""
    r = rets(s, d)
    mu, cov, own = moments.expected(r), covs(r), written(chosen(s, r), "chosen")
    solved = written(weights.solve(own, mu, cov, "sharpe", 0.0, 0.5), "solved")
    count = own.groupBy("portfolio_id").agg(F.count("*").alias("k"))
    equal = own.join(count, "portfolio_id").select("portfolio_id", "ticker", (1 / F.col("k")).alias("weight"))
    ratio = lambda held: portfolio.evaluated(held, mu, cov)
    better = ratio(solved.drop("status")).select("portfolio_id", F.col("sharpe").alias("a")).join(ratio(equal).select("portfolio_id", F.col("sharpe").alias("b")), "portfolio_id")
    return fits(solved, 0.5).join(better.select("portfolio_id", (F.col("a") >= F.col("b") - 1e-9).alias("not_below_equal")), "portfolio_id")


@query
def target_return_check(s, d):
    """Weights fit, and the return is the target wherever the box can reach it."""
    r = rets(s, d)
    mu = moments.expected(r)
    solved = written(weights.solve(chosen(s, r), mu, covs(r), "sharpe", 0.0, 0.6, target_return=0.0), "solved")
    hit = portfolio.returns_of(solved, mu).select("portfolio_id", (F.abs("ret") < 1e-7).alias("hit"))
    return fits(solved, 0.6).join(hit, "portfolio_id").withColumn("hit", F.col("hit") | (F.col("status") != "optimal"))


@query
def risk_parity_check(s, d):
    """Weights fit, and all contributions to risk are equal where no bound is reached."""
    r = rets(s, d)
    cov = covs(r)
    solved = written(weights.solve(chosen(s, r), moments.expected(r), cov, "parity", 0.0, 1.0), "solved")
    rc = portfolio.risk_contributions(solved.drop("status"), cov).groupBy("portfolio_id").agg((F.max("rc") - F.min("rc") < 1e-8 * F.sum("rc")).alias("equal"))
    return fits(solved, 1.0).join(rc, "portfolio_id")


@query
def optimal_weights_check(s, d):
    r = rets(s, d)
    own = chosen(s, r)
    solved = weights.optimal_weights(own, moments.expected(r), covs(r))
    return fits(solved, 0.5).join(solved.join(own, ["portfolio_id", "ticker"], "left_anti").select(F.lit(1).alias("x")).agg((F.count("*") == 0).alias("own_only")), F.lit(True))


@query
def frontier_check(s, d):
    """Corners of each portfolio: optima to 1e-9, returns and risks rise, the last is the largest return of the box."""
    r = rets(s, d)
    c = written(weights.corners(chosen(s, r), moments.expected(r), covs(r), 0.0, 0.5), "corners")
    each = c.groupBy("portfolio_id", "corner", "ret", "risk").agg((F.max("residual") < 1e-9).alias("fine"), (F.abs(F.sum("weight") - 1) < 1e-9).alias("whole"))
    w = Window.partitionBy("portfolio_id").orderBy("corner")
    steps_ = each.withColumn("up", F.coalesce((F.col("ret") >= F.lag("ret").over(w) - 1e-12) & (F.col("risk") >= F.lag("risk").over(w) - 1e-12), F.lit(True)))
    return steps_.groupBy("portfolio_id").agg(F.bool_and("fine").alias("optimal"), F.bool_and("whole").alias("whole"), F.bool_and("up").alias("rising"), F.max("ret").alias("largest"))


@query
def copula_check(s, d):
    """Correlations of each pair of a portfolio: symmetric, one on the diagonal, inside the bounds."""
    r = rets(s, d)
    c = written(forecast.copula_correlations(chosen(s, r), r), "copula")
    other = c.select("portfolio_id", F.col("ti").alias("tj"), F.col("tj").alias("ti"), F.col("rho").alias("back"))
    both = c.join(other, ["portfolio_id", "ti", "tj"])
    return both.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("rho") - F.col("back")) < 1e-12).alias("symmetric"), F.bool_and(F.abs("rho") <= 1 + 1e-12).alias("bounded"), F.bool_and((F.col("ti") != F.col("tj")) | (F.abs(F.col("rho") - 1) < 1e-12)).alias("diagonal"))


@query
def garch_check(s, d):
    """Each series' skewed t fit is no worse than its normal one, and inside the model's bounds."""
    f = forecast.garch_fits(rets(s, d))
    keep = F.col("alpha") + F.col("gamma") / 2 + F.col("beta")
    return f.select("ticker", (F.col("loglik") >= F.col("normal_loglik") - 1e-9).alias("no_worse"), ((F.col("alpha") >= 0) & (F.col("beta") >= 0) & (F.col("alpha") + F.col("gamma") >= 0) & (keep < 1) & (F.abs("skew") < 1)).alias("inside"))


@query
def forecast_check(s, d):
    """A finite forecast of return and a positive one of variance for each ticker."""
    p = brands(s, d)
    f = forecast.forecasts(p, moments.log_returns(p))
    return f.select("ticker", (F.col("mu").isNotNull() & ~F.isnan("mu") & (F.abs("mu") < 1e6)).alias("finite"), (F.col("variance") > 0).alias("positive"))


@query
def benchmark_report(s, d):
    """Three algorithms on five seeds each through the runner, then the report's pairwise tests."""
    r = rets(s, d)
    x = search.Inputs.of(moments.expected(r), covs(r))
    have = store(s)
    failed = benchmark.run(s, x, search.Rules(3, 8, None), have, 5, 0, ["milp", "monte_carlo", "generational_ga"])
    if failed:
        raise RuntimeError("; ".join(failed))
    return benchmark.report(have, 10.0, 11)["wilcoxon"]
