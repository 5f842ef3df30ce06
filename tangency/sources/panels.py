"""Price panels.  Inside the library a panel is long: (ticker STRING, date DATE, close DOUBLE); wide files are melted at the edge."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price of each brand in each month of shipping."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "month").alias("date"), "l_extendedprice", "l_quantity")
    # sums by part go first: the join then carries a row for each part and month
    line = line.groupBy("l_partkey", "date").agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "date").agg((F.sum("v") / F.sum("q")).alias("close"))


def kind_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit price of each brand and size in each month of shipping: a universe of over a thousand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("ticker"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "month").alias("date"), "l_extendedprice", "l_quantity")
    sums = line.groupBy("l_partkey", "date").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    joined = sums.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("ticker", "date").agg((F.sum("price") / F.sum("quantity")).alias("close"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value of each user on each day: a panel with holes."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("close"))


def type_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value of each event type on each day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("close"))


CELLS = 1 << 20  # of a wide file that a task melts at once


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide price file (first column the date, one column a ticker) as a long panel; empty and NaN cells are missing.

    Lines are melted as they are read, some at a time, so neither the plan nor a task grows with the number of columns.  Files of one path have one header.  A short line lacks its
    last cells, what a line has beyond the header is left out.
    """
    named = spark.read.option("header", True).option("inferSchema", False).csv(path)
    tickers = named.columns[1:]
    if not tickers:
        raise ValueError("a price file needs a column for each ticker")
    lines = spark.read.text(path)
    header = lines.where("trim(value) <> ''").first()["value"]
    ship(spark)
    several = max(1, CELLS // len(tickers))

    def melted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, several):
                who, when, what = [], [], []
                for cells in csv.reader(x for x in batch.column(0).slice(start, several).to_pylist() if x.strip()):
                    own = [(t, c) for t, c in zip(tickers, cells[1:], strict=False) if c and not c.isspace()]
                    who += [t for t, _ in own]
                    what += [c for _, c in own]
                    when += [cells[0]] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (who, when, what)], names=["ticker", "day", "said"])

    long = lines.where(F.col("value") != header).mapInArrow(melted, "ticker string, day string, said string")
    close = F.expr("try_cast(said as double)")
    return long.select("ticker", F.to_date(F.substring("day", 1, 10)).alias("date"), F.when(~F.isnan(close), close).alias("close")).dropna()


def to_wide(panel: DataFrame) -> DataFrame:
    """For export only: a column for each ticker."""
    return panel.groupBy("date").pivot("ticker").agg(F.first("close")).orderBy("date")


def save_csv(panel: DataFrame, path: str) -> None:
    to_wide(panel).write.mode("overwrite").option("header", True).csv(path)


def tickers_csv(spark: SparkSession, path: str, column: str = "Tickers") -> DataFrame:
    """A list of tickers; read as text, so that the symbol NAN is a symbol.  A byte-order mark is dropped by the reader."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿"): c for c in df.columns}
    if column not in names:
        raise ValueError(f"no column {column} in {path}")
    out = df.select(F.trim(F.col(f"`{names[column]}`")).alias("ticker")).where("ticker is not null and ticker <> ''")
    if out.isEmpty():
        raise ValueError(f"no tickers in {path}")
    return out


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """The symbols of a list, whatever its first column is named; read as text, without the byte-order mark and empty cells."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("ticker")).where("ticker is not null and ticker <> ''")


def symbol_file(spark: SparkSession, path: str) -> DataFrame:
    """A '|'-separated symbol directory without its footer row."""
    df = spark.read.option("header", True).option("sep", "|").csv(path)
    return df.where(~F.coalesce(F.col(df.columns[0]).startswith("File Creation Time"), F.lit(False)))


def sec_tickers(spark: SparkSession, path: str) -> DataFrame:
    """The regulator's ticker file, {"0": {"cik_str", "ticker", "title"}, ...}, as rows."""
    raw = spark.read.option("wholetext", True).text(path)
    kind = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
    return raw.select(F.explode(F.map_values(F.from_json("value", kind))).alias("r")).select("r.*")


def sec_tickers_with_exchange(spark: SparkSession, path: str) -> DataFrame:
    """Its other form, {"fields": [...], "data": [[...], ...]}, as rows (cik, name, ticker, exchange)."""
    raw = spark.read.option("wholetext", True).text(path)
    one = raw.select(F.explode(F.from_json("value", "fields array<string>, data array<array<string>>")["data"]).alias("r"))
    return one.select(F.col("r")[0].cast("long").alias("cik"), F.col("r")[1].alias("name"), F.col("r")[2].alias("ticker"), F.col("r")[3].alias("exchange"))


def securities(df: DataFrame, **wanted: list[str] | None) -> DataFrame:
    """Security metadata narrowed by the arguments that are given: country, sector, industry, exchange, category_group, category, family."""
    for column, values in wanted.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df
