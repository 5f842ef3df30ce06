"""Prices as a stream: ticks to the last close of each ticker and day, late ticks up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_closes(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """(ticker, date, close) of a stream (ticker, ts, price); works on a static frame as well."""
    marked = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    day = F.window("ts", "1 day")
    return marked.groupBy("ticker", day).agg(F.max_by("price", "ts").alias("close")).select("ticker", F.to_date(F.col("window.start")).alias("date"), "close")
