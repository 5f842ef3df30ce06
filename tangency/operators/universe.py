"""Which securities there are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of common stocks, and words in names of other securities.
COMMON_SYMBOL = "^[A-Z]{1,5}$"
OTHER_SECURITIES = ("Warrant", "Rights", "Units", "Preferred", "Debenture", "Notes")


def universe(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(ticker, name, asset_type): the first of the parts that has a ticker counts; within a part its first row by the column ``ord``, or the least name where it has none.  Missing names are ''."""
    own = []
    for i, (kind, d) in enumerate(parts):
        at = F.col("ord") if "ord" in d.columns else F.lit(0)
        own.append(d.select("ticker", F.coalesce("name", F.lit("")).alias("name"), F.lit(kind).alias("asset_type"), F.lit(i).alias("prio"), at.cast("long").alias("ord")))
    if not own:
        raise ValueError("a universe needs a part")
    first = F.min(F.struct("prio", F.col("ord").isNull().alias("later"), "ord", "name", "asset_type")).alias("x")  # an aggregate: combined before the shuffle
    return reduce(DataFrame.unionByName, own).where("ticker is not null").groupBy("ticker").agg(first).select("ticker", "x.name", "x.asset_type")


def common_stocks(df: DataFrame) -> DataFrame:
    """Traded, no fund, no test issue, a plain symbol, and no word of another security in the name; a null name passes."""
    other = F.col("name").rlike("(?i)" + "|".join(OTHER_SECURITIES))
    return df.where((F.col("traded") == "Y") & (F.col("etf") == "N") & (F.col("test") == "N") & F.col("ticker").rlike(COMMON_SYMBOL) & ~F.coalesce(other, F.lit(False)))


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("asset_type").agg(F.count("*").alias("n"))


def restrict(panel: DataFrame, tickers: DataFrame) -> DataFrame:
    return panel.join(tickers.select("ticker"), "ticker", "left_semi")


def latest_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; of rows with one ``order`` the largest by the other columns in turn.  An aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*key, order)]
    last = df.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("x"))
    return last.select(*[F.col(c) if c in key else F.col("x")[c].alias(c) for c in df.columns])
