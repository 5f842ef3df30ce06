"""Comparing algorithms: runs are (algorithm, seed, fitness); convergence is (algorithm, seed, time, best)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tangency.functions import pvalues

FEASIBLE = -1e3


def summary(runs: DataFrame, algorithms: DataFrame | None = None) -> DataFrame:
    """Order statistics of feasible runs; algorithms without any stay, with zero runs."""
    ok = runs.where(F.col("fitness") > FEASIBLE)
    q = [F.percentile("fitness", F.lit(p)).alias(n) for p, n in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"))]
    s = ok.groupBy("algorithm").agg(F.count("*").alias("runs"), *q, F.max("fitness").alias("best"), F.min("fitness").alias("worst"), F.avg("fitness").alias("mean"), F.stddev_pop("fitness").alias("std"))
    names = (algorithms if algorithms is not None else runs).select("algorithm").distinct()
    return names.join(s, "algorithm", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def average_rank(by: list[str], order: object) -> object:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*by)
    first = F.rank().over(w.orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*by, "__value"))
    return first + (ties - 1) / 2.0


def paired(runs: DataFrame) -> DataFrame:
    """Runs of the seeds that every algorithm has."""
    n = runs.agg(F.countDistinct("algorithm").alias("algorithms"))
    whole = runs.groupBy("seed").agg(F.countDistinct("algorithm").alias("k")).join(F.broadcast(n), F.col("k") == F.col("algorithms")).select("seed")
    return runs.join(whole, "seed", "left_semi")


def ranks(runs: DataFrame) -> DataFrame:
    own = paired(runs).withColumn("__value", F.col("fitness"))
    return own.withColumn("rank", average_rank(["seed"], F.desc("fitness"))).drop("__value")


def friedman(runs: DataFrame) -> DataFrame:
    """(n, k, chi2): with the correction for ties; null below three algorithms or three seeds."""
    r = ranks(runs)
    sums = r.groupBy("algorithm").agg(F.sum("rank").alias("total"), F.count("*").alias("n")).agg(F.sum(F.col("total") * F.col("total")).alias("squares"), F.max("n").alias("n"), F.count("*").alias("k"))
    ties = r.groupBy("seed", "fitness").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi2 = (12.0 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * (k * k * k - k)))
    return sums.join(ties, F.lit(True)).select("n", "k", F.when((F.col("n") >= 3) & (F.col("k") >= 3), chi2).alias("chi2"))


def mean_ranks(runs: DataFrame) -> DataFrame:
    return ranks(runs).groupBy("algorithm").agg(F.avg("rank").alias("mean_rank"))


def nemenyi(runs: DataFrame) -> DataFrame:
    """(a, b, q): rank differences in units of the studentized range."""
    m = ranks(runs).groupBy("algorithm").agg(F.avg("rank").alias("m"), F.count("*").alias("n"))
    k = m.agg(F.count("*").cast("double").alias("k"))
    a, b = m.select(F.col("algorithm").alias("a"), F.col("m").alias("ma"), "n"), m.select(F.col("algorithm").alias("b"), F.col("m").alias("mb"))
    q = F.abs(F.col("ma") - F.col("mb")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n"))) * F.sqrt(F.lit(2.0))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).join(F.broadcast(k), F.lit(True)).select("a", "b", q.alias("q"))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else pvalues.chi2_sf(a, b) for a, b in zip(x, df, strict=True)])


@F.pandas_udf(DoubleType())
def range_p(q: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([pvalues.range_sf(a, int(b)) for a, b in zip(q, k, strict=True)])


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, ranks: pd.Series, pairs: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else pvalues.signed_rank_p(a, list(r), int(n)) for a, r, n in zip(w, ranks, pairs, strict=True)])


def wilcoxon_pairs(runs: DataFrame) -> DataFrame:
    """(a, b, pairs, n, w, p) for each two algorithms: signed ranks over their common seeds, zero differences left out, p with ties; null below five seeds."""
    x = runs.select(F.col("algorithm").alias("a"), "seed", F.col("fitness").alias("x"))
    y = runs.select(F.col("algorithm").alias("b"), "seed", F.col("fitness").alias("y"))
    d = x.join(y, "seed").where("a < b").select("a", "b", "seed", (F.col("x") - F.col("y")).alias("d"))
    r = d.withColumn("__value", F.abs("d")).withColumn("zero", F.col("d") == 0)
    r = r.withColumn("rank", F.when(~F.col("zero"), average_rank(["a", "b", "zero"], F.abs("d"))))
    g = r.groupBy("a", "b").agg(
        F.count("*").alias("pairs"), F.count("rank").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0)).alias("minus"), F.collect_list("rank").alias("ranks")
    )
    w = F.when(F.col("pairs") >= 5, F.least("plus", "minus"))
    return g.select("a", "b", "pairs", "n", w.alias("w"), "ranks").withColumn("p", wilcoxon_p("w", "ranks", "pairs")).drop("ranks")


def wilcoxon(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w): the smaller signed-rank sum over common seeds, zero differences left out; null below five seeds."""
    own = wilcoxon_pairs(runs.where(F.col("algorithm").isin(a, b)))
    return own.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("w").alias("w"))  # one pair, or none


def boxes(runs: DataFrame) -> DataFrame:
    """What a box plot of each algorithm's feasible runs shows: quartiles, whiskers at the last values within 1.5 interquartile ranges, and how many lie beyond."""
    ok = runs.where(F.col("fitness") > FEASIBLE)
    q = [F.percentile("fitness", F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    own = ok.join(ok.groupBy("algorithm").agg(*q), "algorithm")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("fitness").between(F.col("q1") - reach, F.col("q3") + reach)
    return own.groupBy("algorithm", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("fitness"))).alias("low"), F.max(F.when(inside, F.col("fitness"))).alias("high"), F.count_if(~inside).alias("beyond"))


def best_so_far(records: DataFrame) -> DataFrame:
    w = Window.partitionBy("algorithm", "seed").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("best", F.max("best").over(w))


def aocc(records: DataFrame, budget: float, reference: float) -> DataFrame:
    """Area over the convergence curve: the mean shortfall from the reference over the budget, steps from the left, none before the first record.

    A run without a record inside the budget falls short by all of it, 1; without a positive reference all are infinite.
    """
    w = Window.partitionBy("algorithm", "seed").orderBy("time")
    inside = records.where(F.col("time") <= budget)
    until = F.coalesce(F.lead("time").over(w), F.lit(float(budget)))
    first = F.row_number().over(w) == 1
    short = F.greatest(F.lit(0.0), F.lit(float(reference)) - F.col("best"))
    area = short * (until - F.col("time")) + F.when(first, F.lit(float(max(0.0, reference))) * F.col("time")).otherwise(0.0)
    steps = inside.withColumn("area", area)
    every = records.select("algorithm", "seed").distinct()
    if reference <= 0:
        return every.withColumn("aocc", F.lit(float("inf")))
    sums = steps.groupBy("algorithm", "seed").agg((F.sum("area") / (budget * reference)).alias("aocc"))
    return every.join(sums, ["algorithm", "seed"], "left").withColumn("aocc", F.coalesce("aocc", F.lit(1.0)))


def on_grid(records: DataFrame, budget: float, points: int) -> DataFrame:
    """As-of values on a grid of times: records and grid points in one stream, the last value carried forward."""
    spark = records.sparkSession
    times = spark.range(points).select((F.col("id") * (budget / (points - 1))).alias("time"))  # a fixed number of points
    ok = records.where(F.col("best") > FEASIBLE)
    marks = ok.select("algorithm", "seed").distinct().join(F.broadcast(times), F.lit(True)).select("algorithm", "seed", "time", F.lit(None).cast("double").alias("best"), F.lit(1).alias("mark"))
    both = ok.select("algorithm", "seed", "time", "best", F.lit(0).alias("mark")).unionByName(marks)
    w = Window.partitionBy("algorithm", "seed").orderBy("time", "mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("best", ignorenulls=True).over(w)).where("mark = 1").select("algorithm", "seed", "time", "value")


def convergence(records: DataFrame, budget: float, points: int = 500) -> DataFrame:
    q = [F.percentile("value", F.lit(p)).alias(n) for p, n in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"))]
    return on_grid(records, budget, points).where("value is not null").groupBy("algorithm", "time").agg(*q)


def performance_profile(records: DataFrame, budget: float, share: float = 0.95, highest: float = 10.0, points: int = 500) -> DataFrame:
    """(algorithm, tau, solved): share of seeds whose time to ``share`` of the seed's best is within tau of the fastest."""
    target = records.groupBy("seed").agg((F.max("best") * share).alias("target")).where("target > 0")
    times = records.join(target, "seed").groupBy("algorithm", "seed").agg(F.coalesce(F.min(F.when(F.col("best") >= F.col("target"), F.col("time"))), F.lit(2.0 * budget)).alias("time"))
    fastest = times.groupBy("seed").agg(F.min("time").alias("fastest"))
    ratio = times.join(fastest, "seed").select("algorithm", F.coalesce(F.try_divide("time", "fastest"), F.lit(1.0)).alias("ratio"))
    step = (highest - 1) / (points - 1)
    # each ratio falls to the first tau that is not below it; a running count by algorithm does the rest
    tau = lambda i: 1 + i * step
    near = F.ceil((F.col("ratio") - 1) / step)
    first = F.when(tau(near - 1) >= F.col("ratio"), near - 1).when(tau(near) >= F.col("ratio"), near).otherwise(near + 1)
    counts = ratio.withColumn("id", F.greatest(first, F.lit(0))).groupBy("algorithm", "id").agg(F.count("*").alias("n"))
    every = counts.groupBy("algorithm").agg(F.sum("n").alias("all")).select("algorithm", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("id"))
    w = Window.partitionBy("algorithm").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    sums = every.join(counts, ["algorithm", "id"], "left").withColumn("below", F.sum(F.coalesce("n", F.lit(0))).over(w))
    return sums.select("algorithm", tau(F.col("id")).alias("tau"), (F.col("below") / F.col("all")).alias("solved"))
