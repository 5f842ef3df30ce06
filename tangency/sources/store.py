"""History of runs as Parquet tables, and a log of commits that readers go through.

Data files are written first, each save in folders of its own; a commit then names the folders that a save adds and removes, in one small file that only one writer can create.  What is not named
by a commit is not seen, so a save of several tables is seen whole or not at all, and a writer that comes second checks its keys again.  Prices are laid out by exchange and year; a save
rewrites the years it touches, merged, so there is one row a key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.operators import clean
from tangency.operators.universe import latest_by

TABLES = {
    "exchanges": "code string, name string, currency string",
    "tickers": "symbol string, exchange string, asset_type string",
    "prices": "ticker string, date date, close double, ingest long, exchange string, year int",
    "forecast_runs": "run_id long, created timestamp, n_periods int, elapsed_seconds double, notes string, exchange string",
    "forecasts": "run_id long, ticker string, mu double, variance double",
    "data_sources": "id long, source string, exchange string, downloaded timestamp, first_date date, last_date date, num_tickers int, num_rows long, notes string",
    "optimisation_runs": "run_id long, created timestamp, script string, params map<string,string>, results map<string,double>",
    "portfolio_holdings": "run_id long, ticker string, weight double",
    "backtest_sessions": "session_id long, created timestamp, params map<string,string>",
    "backtest_results": "session_id long, category string, idx int, metrics map<string,double>, holdings array<struct<ticker: string, weight: double>>",
    "benchmark_runs": "algorithm string, seed long, fitness double, seconds double, holdings string",
    "benchmark_records": "algorithm string, seed long, time double, generation int, best double, mean double",
}
#: Exchanges of a new store.
EXCHANGES = [("US", "US markets", "USD"), ("NZX", "New Zealand Exchange", "NZD"), ("ASX", "Australian Securities Exchange", "AUD")]


#: Tables in folders by these columns, the last in their schemas.
LAYOUT = {"prices": ["exchange", "year"]}
TRIES = 50  # of a writer whom others overtake


class Conflict(RuntimeError):
    """Another writer has changed what this one read."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._known: dict[str, dict] = {}  # commits by name; they do not change

    # --------------------------------------------------------------------------------------------------- log

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self) -> object:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[tuple[int, dict]]:
        files, log = self._files(), self._path("_log")
        if not files.exists(log):
            return []
        out = []
        for f in files.listStatus(log):
            name = f.getPath().getName()
            if name not in self._known:
                stream = files.open(f.getPath())
                try:
                    said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                try:
                    self._known[name] = json.loads(said)
                except ValueError:
                    continue  # being written, or its writer has died: nothing of it is seen
            out.append((int(name.split(".")[0]), self._known[name]))
        return sorted(out, key=lambda c: c[0])

    def _last(self) -> int:
        """The number of the newest commit, finished or not."""
        files, log = self._files(), self._path("_log")
        return max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(log)), default=0) if files.exists(log) else 0

    def folders(self, name: str) -> list[str]:
        """The folders that hold a table now, in the order of their commits."""
        now: dict[str, None] = {}
        for _, commit in self._commits():
            for f in commit.get("remove", {}).get(name, []):
                now.pop(f, None)
            now |= dict.fromkeys(commit.get("add", {}).get(name, []))
        return list(now)

    def commit(self, change: Callable[[], tuple[dict[str, list[str]], dict[str, list[str]]]]) -> int:
        """Makes a change visible: ``change`` checks against the store as it is and gives the folders to add and to remove.  It is called again if another writer was first."""
        files = self._files()
        files.mkdirs(self._path("_log"))
        for _ in range(TRIES):
            number = self._last() + 1
            add, remove = change()
            for table, gone in remove.items():
                if not set(gone) <= set(self.folders(table)):
                    raise Conflict(f"{table}: rewritten by another writer")
            try:
                stream = files.create(self._path(f"_log/{number:012d}.json"), False)
            except Exception as e:  # noqa: BLE001  a Java exception: the number is taken
                if "AlreadyExists" in str(e) or "already exists" in str(e):
                    continue
                raise
            stream.write(bytearray(json.dumps({"add": add, "remove": remove}).encode()))
            stream.close()
            return number
        raise Conflict("too many writers")

    def _written(self, name: str, df: DataFrame) -> list[str]:
        """Data files of a table in new folders, which no reader sees yet."""
        batch = f"{name}/batch=b{uuid.uuid4().hex}"
        want = self.spark.createDataFrame([], TABLES[name]).schema
        writer = df.select(*[F.col(f.name).cast(f.dataType) for f in want]).write
        by = LAYOUT.get(name, [])
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{batch}")
        if not by:
            return [batch]
        files, found = self._files(), [batch]
        for _ in by:
            found = [f"{f}/{x.getPath().getName()}" for f in found for x in files.listStatus(self._path(f)) if x.isDirectory() and "=" in x.getPath().getName()]
        return found

    def read(self, name: str) -> DataFrame:
        folders = self.folders(name)
        if not folders:
            return self.spark.createDataFrame(EXCHANGES if name == "exchanges" else [], TABLES[name])
        return self._of(name, folders)

    def _of(self, name: str, folders: list[str]) -> DataFrame:
        """Rows of folders; columns in folder names are pruned by filters on them."""
        reader = self.spark.read.schema(TABLES[name]).option("basePath", f"{self.root}/{name}")
        names = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema]
        return reader.parquet(*[f"{self.root}/{f}" for f in folders]).select(*names)

    def vacuum(self) -> int:
        """Deletes folders that no commit holds any more; how many.  Not while others read or write."""
        files, gone = self._files(), 0
        for name in TABLES:
            held = set(self.folders(name))
            if not files.exists(self._path(name)):
                continue
            for batch in files.listStatus(self._path(name)):
                own = f"{name}/{batch.getPath().getName()}"
                inner = [f for f in held if f == own or f.startswith(f"{own}/")]
                if not inner:
                    gone += files.delete(self._path(own), True)
                    continue
                parts = [own]
                for _ in LAYOUT.get(name, []):
                    parts = [f"{f}/{x.getPath().getName()}" for f in parts for x in files.listStatus(self._path(f)) if x.isDirectory() and "=" in x.getPath().getName()]
                for f in parts:
                    if f not in held:
                        gone += files.delete(self._path(f), True)
        return gone

    def add(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """Appends; ``key`` must be new and without repeats."""
        self.add_all({name: (df, key)})

    def add_all(self, rows: dict[str, tuple[DataFrame, list[str] | None]]) -> None:
        """Appends to several tables at once: all of it is seen, or nothing."""
        written = {name: self._written(name, df) for name, (df, _) in rows.items()}
        new = {name: self._of(name, folders) for name, folders in written.items() if folders}
        for name, (_, key) in rows.items():
            if key and name in new and not new[name].groupBy(*key).count().where("count > 1").isEmpty():
                raise ValueError(f"{name}: a key is repeated")

        def change() -> tuple[dict, dict]:
            for name, (_, key) in rows.items():
                if key and name in new and not new[name].join(self.read(name), key, "left_semi").isEmpty():
                    raise ValueError(f"{name}: a key exists")
            return written, {}

        self.commit(change)

    def _row(self, name: str, **values: object) -> DataFrame:
        want = self.spark.createDataFrame([], TABLES[name]).schema
        return self.spark.createDataFrame([tuple(values.get(f.name) for f in want)], want)

    def _one(self, name: str, **values: object) -> None:
        self.add(name, self._row(name, **values))

    def _next(self, name: str, key: str) -> int:
        """A new number, claimed by an empty file that only one writer can create."""
        n = int(self.read(name).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]) + 1
        files = self._files()
        files.mkdirs(self._path("_numbers"))
        while not files.createNewFile(self._path(f"_numbers/{name}-{n}")):
            n += 1
        return n

    # ------------------------------------------------------------------------------------------------ prices

    def exchange(self, code: str) -> str:
        if self.read("exchanges").where(F.col("code") == code).isEmpty():
            raise ValueError(f"no exchange {code}")
        return code

    def ensure_tickers(self, symbols: DataFrame, exchange: str, asset_type: str | None = None) -> None:
        new = symbols.select(F.col("ticker").alias("symbol")).distinct().withColumn("exchange", F.lit(self.exchange(exchange))).withColumn("asset_type", F.lit(asset_type).cast("string"))
        self.add("tickers", new.join(self.read("tickers"), ["symbol", "exchange"], "left_anti"))

    def save_prices(self, panel: DataFrame, exchange: str, asset_type: str = "etf", source: str | None = None) -> int:
        """Saves closes and where they came from, at once; the number of the source's row.

        A later save of one (exchange, ticker, date) counts, and of one save's rows the largest close.  Missing closes are left out.  The years that ``panel`` touches are
        written anew, merged with what they held: there is one row a key.
        """
        self.ensure_tickers(panel, exchange, asset_type)
        own = panel.where("close is not null and not isnan(close)").select("ticker", "date", "close", F.lit(time.time_ns()).alias("ingest"), F.lit(exchange).alias("exchange"), F.year("date").alias("year"))
        fresh = self._written("prices", latest_by(own, ["exchange", "ticker", "date"], "ingest"))
        s = own.agg(F.min("date"), F.max("date"), F.countDistinct("ticker"), F.count("*")).first()
        number = self._next("data_sources", "id")
        about = self._written("data_sources", self._row("data_sources", id=number, source=source or ("nzx" if exchange == "NZX" else "yahoo"), exchange=exchange, first_date=s[0], last_date=s[1], num_tickers=s[2], num_rows=s[3]))
        place = lambda f: f.split("/", 2)[2]  # noqa: E731  exchange and year of a folder

        def change() -> tuple[dict, dict]:
            touched = {place(f) for f in fresh}
            old = [f for f in self.folders("prices") if place(f) in touched]
            merged = fresh
            if old:
                both = self._of("prices", [*fresh, *old])
                merged = self._written("prices", latest_by(both, ["exchange", "ticker", "date"], "ingest"))
            return {"prices": merged, "data_sources": about}, {"prices": old}

        self.commit(change)
        return number

    def prices(self, exchange: str | None = None, start: str | None = None, end: str | None = None, tickers: list[str] | None = None) -> DataFrame:
        """Closes within inclusive dates; exchange and years prune folders, the other filters reach the scan."""
        p = self.read("prices")
        if exchange is not None:
            p = p.where(F.col("exchange") == self.exchange(exchange))
        for bound, less in ((start, False), (end, True)):
            if bound is not None:
                day = F.lit(bound).cast("date")
                p = p.where((F.col("date") <= day) & (F.col("year") <= F.year(day)) if less else (F.col("date") >= day) & (F.col("year") >= F.year(day)))
        if tickers is not None:
            p = p.where(F.col("ticker").isin(*tickers) if tickers else F.lit(False))
        return p.select("exchange", "ticker", "date", "close")

    def panel(self, exchange: str | None = None, start: str | None = None, end: str | None = None, tickers: list[str] | None = None, min_coverage: float | None = 0.95) -> DataFrame:
        """(ticker, t, date, close) ready for use: all dates of the selection, tickers with ``min_coverage`` of them (None or 0: all), gaps filled forward.

        A ticker that several exchanges have is one; of one date the largest close counts.
        """
        found = self.prices(exchange, start, end, tickers).select("ticker", "date", "close")
        kept = clean.covered(found, "int", min_coverage) if min_coverage else found
        return clean.forward_fill(clean.grid(kept, found))

    # --------------------------------------------------------------------------------------- forecasts, runs

    def save_forecast(self, mu: DataFrame, variance: DataFrame, **about: object) -> int:
        run = self._next("forecast_runs", "run_id")
        both = mu.where("mu is not null and not isnan(mu)").join(variance.where("variance is not null and not isnan(variance)"), "ticker", "full_outer")
        rows = both.select(F.lit(run).alias("run_id"), "ticker", "mu", "variance")
        self.add_all({"forecast_runs": (self._row("forecast_runs", run_id=run, **about), None), "forecasts": (rows, ["run_id", "ticker"])})
        return run

    def forecast(self, run_id: int | None = None) -> DataFrame:
        f = self.read("forecasts")
        run = self.read("forecast_runs").agg(F.max("run_id").alias("run_id")) if run_id is None else self.spark.createDataFrame([(run_id,)], "run_id long")
        return f.join(F.broadcast(run), "run_id", "left_semi").drop("run_id")

    def latest_forecast(self) -> DataFrame:
        return self.read("forecast_runs").orderBy(F.desc("run_id")).limit(1)

    def save_run(self, script: str, params: dict, results: dict, holdings: DataFrame) -> int:
        run = self._next("optimisation_runs", "run_id")
        about = self._row("optimisation_runs", run_id=run, script=script, params={k: str(v) for k, v in params.items()}, results={k: float(v) for k, v in results.items()})
        self.add_all({"optimisation_runs": (about, None), "portfolio_holdings": (holdings.select(F.lit(run).alias("run_id"), "ticker", "weight"), ["run_id", "ticker"])})
        return run

    def recent_runs(self, n: int = 10, script: str | None = None) -> DataFrame:
        r = self.read("optimisation_runs")
        return (r.where(F.col("script") == script) if script else r).orderBy(F.desc("run_id")).limit(n)

    def holdings(self, run_id: int) -> DataFrame:
        return self.read("portfolio_holdings").where(F.col("run_id") == run_id).orderBy(F.desc("weight"))

    def save_session(self, params: dict) -> int:
        s = self._next("backtest_sessions", "session_id")
        self._one("backtest_sessions", session_id=s, params={k: str(v) for k, v in params.items()})
        return s

    def save_result(self, session_id: int, category: str, idx: int, metrics: dict, holdings: list[tuple[str, float]] | None = None) -> None:
        self._one("backtest_results", session_id=session_id, category=category, idx=idx, metrics={k: float(v) for k, v in metrics.items()}, holdings=holdings)

    def recent_backtests(self, n: int = 5) -> DataFrame:
        return self.read("backtest_sessions").orderBy(F.desc("session_id")).limit(n)

    def results(self, session_id: int) -> DataFrame:
        return self.read("backtest_results").where(F.col("session_id") == session_id).orderBy("category", "idx")

    def results_json(self, session_id: int) -> DataFrame:
        return self.results(session_id).withColumn("holdings", F.to_json("holdings"))

    def save_data_source(self, source: str, exchange: str | None = None, first_date: object = None, last_date: object = None, num_tickers: int | None = None, num_rows: int | None = None, notes: str | None = None) -> None:
        self._one("data_sources", id=self._next("data_sources", "id"), source=source, exchange=exchange, first_date=first_date, last_date=last_date, num_tickers=num_tickers, num_rows=num_rows, notes=notes)

    def latest_data_source(self, source: str | None = None) -> DataFrame:
        d = self.read("data_sources")
        return (d.where(F.col("source") == source) if source else d).orderBy(F.desc("id")).limit(1)

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in TABLES}

    def import_folder(self, folder: str, listing: dict) -> list[str]:
        """``import_csvs`` of a folder's files, as ``listing`` has them: {"prices": {file: (exchange, asset type)}, "forecasts": [(mu, variance, exchange)], "tickers": as prices}."""
        at = lambda name: f"{folder.rstrip('/')}/{name}"
        named = lambda kind: {at(n): tuple(v) for n, v in listing.get(kind, {}).items()}
        return self.import_csvs(named("prices"), [(at(m), at(v), e) for m, v, e in listing.get("forecasts", [])], named("tickers"))

    def import_csvs(self, prices: dict[str, tuple[str, str]], forecasts: list[tuple[str, str, str]] = (), tickers: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Loads price files {path: (exchange, asset type)}, forecast pairs (mu path, variance path, exchange) and ticker lists (as price files; the first column); missing files are named."""
        from pyspark.errors import AnalysisException

        from tangency.sources.panels import first_column, wide_csv

        missing = []
        for path, (exchange, kind) in prices.items():
            try:
                self.save_prices(wide_csv(self.spark, path), exchange, kind, "csv")
            except AnalysisException:
                missing.append(path)
        for mu_path, var_path, exchange in forecasts:
            try:
                mu, var = (self.spark.read.option("header", True).csv(p).toDF("ticker", "x").select("ticker", F.expr("try_cast(x as double)").alias(n)) for p, n in ((mu_path, "mu"), (var_path, "variance")))
                self.save_forecast(mu, var, exchange=exchange, notes="csv")
            except AnalysisException:
                missing.append(mu_path)
        for path, (exchange, kind) in (tickers or {}).items():
            try:
                self.ensure_tickers(first_column(self.spark, path), exchange, kind)
            except AnalysisException:
                missing.append(path)
        return missing
