"""Looking at panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_shares(laid: DataFrame) -> DataFrame:
    return laid.groupBy("ticker").agg(F.avg(F.col("close").isNull().cast("double")).alias("share"))


def longest_null_run(laid: DataFrame) -> DataFrame:
    """Gaps and islands; the first row does not count."""
    nulls = laid.where("t >= 1 and close is null")
    runs = nulls.withColumn("island", F.col("t") - F.row_number().over(Window.partitionBy("ticker").orderBy("t"))).groupBy("ticker", "island").agg(F.count("*").alias("run"))
    return laid.select("ticker").distinct().join(runs.groupBy("ticker").agg(F.max("run").alias("longest")), "ticker", "left").select("ticker", F.coalesce("longest", F.lit(0)).alias("longest"))


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    q = [F.percentile(c, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *q, F.max(c).alias("max"))


def extremes(rets: DataFrame) -> DataFrame:
    return rets.groupBy("ticker").agg(F.max("ret").alias("max_ret"), F.avg("ret").alias("mean_ret"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins of [low, high]; the top edge belongs to the last bin."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.where(F.col(column).between(low, high)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def shape(laid: DataFrame) -> DataFrame:
    return laid.agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"), F.count("*").alias("cells"), F.count("close").alias("present"))


def columns(laid: DataFrame) -> DataFrame:
    """(ticker, kind, cells, present, nulls) of each series: what a look at a wide panel's columns shows."""
    kind = dict(laid.dtypes)["close"]
    return laid.groupBy("ticker").agg(F.lit(kind).alias("kind"), F.count("*").alias("cells"), F.count("close").alias("present"), F.count_if(F.col("close").isNull()).alias("nulls"))


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """(below, above, missing): values that a histogram from ``low`` to ``high`` does not show."""
    c = F.col(column)
    return df.agg(F.count_if(c < low).alias("below"), F.count_if(c > high).alias("above"), F.count_if(c.isNull()).alias("missing"))
