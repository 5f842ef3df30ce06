"""Panel cleaning on long tables.  A grid is (ticker, t, date, close): one row for each ticker and date, t the date's ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_days(panel: DataFrame, days: int) -> DataFrame:
    """Rows of the last ``days`` calendar days before the last date."""
    edge = panel.agg(F.date_sub(F.max("date"), days).alias("edge"))
    return panel.join(F.broadcast(edge), panel["date"] >= F.col("edge")).drop("edge")


def thresholds(n: object, rule: str, share: float = 0.95) -> object:
    """Cells a ticker needs: 'int' truncates share x dates, 'exact' does not, 'tenth' is a tenth, 'nulls' allows under 1 - share missing."""
    if rule == "tenth":
        return F.floor(n / F.lit(10))
    if rule == "nulls":
        return F.floor(n * F.lit(share)) + 1
    return F.floor(n * F.lit(share)) if rule == "int" else n * F.lit(share)


def covered(panel: DataFrame, rule: str = "int", share: float = 0.95) -> DataFrame:
    """Tickers with enough closes among the dates of the panel."""
    dates = panel.agg(F.countDistinct("date").alias("n_dates"))  # one row
    counts = panel.where("close is not null").groupBy("ticker").agg(F.count("*").alias("cells"))
    keep = counts.join(F.broadcast(dates), F.col("cells") >= thresholds(F.col("n_dates"), rule, share)).select("ticker")
    return panel.join(keep, "ticker", "left_semi")


def grid(panel: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """All dates (of ``among``, or of the panel) for each ticker.  The dates travel as one array, so no ordering of the whole panel is needed for ordinals.

    Of rows that repeat a ticker and date the largest close counts.
    """
    dates = (panel if among is None else among).agg(F.sort_array(F.collect_set("date")).alias("dates"))  # trading days, one row
    # by ticker first: one shuffle serves both aggregates
    once = panel.where("date is not null").repartition("ticker").groupBy("ticker", "date").agg(F.max("close").alias("close"))
    own = once.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("date", "close"))).alias("closes"))
    laid = own.join(F.broadcast(dates), F.lit(True)).select("ticker", "closes", F.posexplode("dates").alias("t", "date"))
    return laid.select("ticker", "t", "date", F.try_element_at("closes", F.col("date")).alias("close"))


def _window() -> Window:
    return Window.partitionBy("ticker").orderBy("t")


def forward_fill(laid: DataFrame) -> DataFrame:
    w = _window().rowsBetween(Window.unboundedPreceding, 0)
    return laid.withColumn("close", F.last("close", ignorenulls=True).over(w))


def backward_fill(laid: DataFrame) -> DataFrame:
    w = _window().rowsBetween(0, Window.unboundedFollowing)
    return laid.withColumn("close", F.first("close", ignorenulls=True).over(w))


def zero_fill(laid: DataFrame) -> DataFrame:
    return laid.na.fill(0.0, ["close"])


def split(laid: DataFrame, skip: int, leave: int) -> DataFrame:
    """Rows from ordinal ``skip`` to all but the last ``leave``."""
    last = laid.agg((F.max("t") + 1 - leave).alias("stop"))
    return laid.join(F.broadcast(last), F.col("t") < F.col("stop")).where(F.col("t") >= skip).drop("stop")


def cleaned(panel: DataFrame, rule: str = "int", share: float = 0.95, days: int | None = None) -> DataFrame:
    """The loader's chain: date cut, coverage, grid, forward fill."""
    if days is not None:
        panel = last_days(panel, days)
    out = forward_fill(grid(covered(panel, rule, share)))
    return out
