"""Daily closes from a web service, as a batch data source: spark.read.format("closes").

Options: ``url``, a template with {ticker}, {start} and {end} whose answer is CSV with a header and the columns date and close (http, https or file);
``tickers``, separated by commas; ``start`` and ``end``, dates; ``batch``, tickers to a partition (500).  A ticker without an answer is left out; a service that cannot be
reached, or no close of any ticker in a partition that asked for some, is a ConnectionError.
"""

from __future__ import annotations

import csv
import datetime
import io
import urllib.error
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tangency.session import ship


class Batch(InputPartition):
    def __init__(self, tickers: list[str]) -> None:
        super().__init__(tickers)


class ClosesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.tickers = [t.strip() for t in self.options.get("tickers", "").split(",") if t.strip()]
        if "url" not in self.options or not self.tickers:
            raise ValueError("closes: the options url and tickers are needed")

    def partitions(self) -> list[InputPartition]:
        n = max(1, int(self.options.get("batch", 500)))
        return [Batch(self.tickers[i : i + n]) for i in range(0, len(self.tickers), n)]

    def read(self, partition: InputPartition):
        found = 0
        start, end = self.options.get("start", "0001-01-01"), self.options.get("end", "9999-12-31")
        for ticker in partition.value:
            try:
                with urllib.request.urlopen(self.options["url"].format(ticker=ticker, start=start, end=end), timeout=60) as answer:
                    text = answer.read().decode("utf-8-sig")
            except urllib.error.HTTPError:
                continue  # the service does not know it
            except urllib.error.URLError as e:
                if isinstance(e.reason, FileNotFoundError):
                    continue
                raise ConnectionError(f"closes: {e.reason}") from e
            for row in csv.DictReader(io.StringIO(text)):
                if row.get("close") and start <= row["date"][:10] <= end:
                    found += 1
                    yield ticker, datetime.date.fromisoformat(row["date"][:10]), float(row["close"])
        if not found:
            raise ConnectionError(f"closes: no close of any of {len(partition.value)} tickers")


class Closes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "closes"

    def schema(self) -> str:
        return "ticker string, date date, close double"

    def reader(self, schema: object) -> DataSourceReader:
        return ClosesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Closes)
