"""Running algorithms against each other: one engine, five strategies, one set of rules for all.

    python -m tangency.plans.benchmark --prices FILE --output-dir DIR [--quick] [--time-budget S] [--runs N] [--seed N] [--algorithms NAME ...] [--analyze-only]
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.durable import written
from tangency.operators import moments, stats
from tangency.operators.search import Genetic, Inputs, Rules, best_over_islands, drawn_places, fitness, island_search, sparse_fitness
from tangency.session import session, ship
from tangency.sources.panels import wide_csv
from tangency.sources.store import Store

#: (fitness, holdings, records of (seconds, generation, best, mean)) of one run within a budget of seconds, None for no limit.
Found = tuple[float, str, list[tuple[float, int, float, float]]]
Adapter = Callable[[SparkSession, Inputs, Rules, int, float | None], Found]
BLOCK = 1000  # trials drawn together
SIGNIFICANT = 0.05


def _genetic(g: Genetic) -> Adapter:
    def run(spark: SparkSession, x: Inputs, rules: Rules, seed: int, budget: float | None) -> Found:
        history = island_search(spark, x, rules, g, seed, budget)
        top = best_over_islands(history).first()
        seen = history.groupBy("generation").agg(F.max("seconds").alias("s"), F.max("best_fitness").alias("b"), F.avg("mean_fitness").alias("m")).orderBy("generation").collect()
        return float(top["best_fitness"]), top["holdings"], [(r["s"], r["generation"], r["b"], r["m"]) for r in seen]

    return run


def _monte_carlo(trials: int) -> Adapter:
    def run(spark: SparkSession, x: Inputs, rules: Rules, seed: int, budget: float | None) -> Found:
        ship(spark)
        shared, n = spark.sparkContext.broadcast((x, rules)), len(x.names)  # a universe of thousands at most
        began = time.time()

        def search(frames):
            data, rule = shared.value
            for pdf in frames:
                for block in pdf["id"]:
                    if budget is not None and time.time() - began > budget:
                        return
                    count = min(BLOCK, trials - BLOCK * int(block))
                    rng = np.random.default_rng([seed, int(block)])
                    places, k = drawn_places(rng, count, n, rule.least, rule.most)
                    f = sparse_fitness(places, k, data, rule)
                    i = int(np.argmax(f))
                    yield pd.DataFrame({"seconds": [time.time() - began], "block": [int(block)], "fitness": [float(f[i])], "mean": [float(f.mean())], "holdings": [",".join(data.names[j] for j in sorted(places[i, : k[i]].tolist()))]})

        found = spark.range(-(-max(1, trials) // BLOCK)).mapInPandas(search, "seconds double, block long, fitness double, mean double, holdings string")
        # a row for each thousand trials; the best of each second are records
        rows = sorted(found.groupBy(F.floor("seconds").alias("second")).agg(F.max(F.struct("fitness", "holdings")).alias("top"), F.avg("mean").alias("mean"), F.max("seconds").alias("at")).collect(), key=lambda r: r["at"])
        if not rows:
            return rules.penalty, "", []
        top = max(rows, key=lambda r: (r["top"]["fitness"], r["top"]["holdings"]))["top"]
        return float(top["fitness"]), top["holdings"], [(r["at"], i, r["top"]["fitness"], r["mean"]) for i, r in enumerate(rows)]

    return run


def _milp(aversion: float = 0.8) -> Adapter:
    def run(spark: SparkSession, x: Inputs, rules: Rules, seed: int, budget: float | None) -> Found:
        """The exact optimum of the linear form; its ratio at equal weights is the fitness."""
        del spark, seed, budget
        began = time.time()
        score = x.mu - aversion * np.sqrt(np.maximum(np.diag(x.cov), 0))
        order = [i for i in np.argsort(-score, kind="stable") if score[i] > 0][: rules.most]
        genes = np.zeros((1, len(x.names)), bool)
        genes[0, order] = True
        value = float(fitness(genes, x, Rules(1, rules.most, None))[0]) if order else 0.0
        return value, ",".join(x.names[i] for i in sorted(order)), [(time.time() - began, 0, value, value)]

    return run


ADAPTERS: dict[str, Adapter] = {
    "island_ga": _genetic(Genetic(population=2000, generations=200, elites=50, interval=10, migration=0.1)),
    "generational_ga": _genetic(Genetic(islands=1, migration=0, generations=6, elites=1, parents=0.1, crossover="point", crossover_rate=0.85, selection="rank", saturate=5)),
    "no_migration_ga": _genetic(Genetic(migration=0, parents=0.01, generations=50)),
    "monte_carlo": _monte_carlo(100_000),
    "milp": _milp(),
}


def pending(spark: SparkSession, store: Store, names: Iterable[str], seeds: Iterable[int]) -> DataFrame:
    """(algorithm, seed) of the work list that the store has no run of."""
    work = spark.createDataFrame([(n, int(s)) for n in names for s in seeds], "algorithm string, seed long")
    return work.join(store.read("benchmark_runs").select("algorithm", "seed"), ["algorithm", "seed"], "left_anti")


def run(spark: SparkSession, x: Inputs, rules: Rules, store: Store, runs: int = 5, base_seed: int = 0, names: Iterable[str] | None = None, budget: float | None = None) -> list[str]:
    """Runs what is not in the store yet, a row at a time; failures are returned and do not stop the rest."""
    names = list(names or ADAPTERS)
    unknown = [n for n in names if n not in ADAPTERS]
    if unknown:
        raise ValueError(f"unknown algorithms {', '.join(unknown)}; there are {', '.join(ADAPTERS)}")
    todo = {(r[0], r[1]) for r in pending(spark, store, names, range(base_seed, base_seed + runs)).collect()}
    failed = []
    for name in names:
        for seed in range(base_seed, base_seed + runs):
            if (name, seed) not in todo:
                continue
            began = time.time()
            try:
                value, held, records = ADAPTERS[name](spark, x, rules, seed, budget)
            except Exception as e:  # noqa: BLE001  one algorithm must not end the others
                failed.append(f"{name}, seed {seed}: {e}")
                continue
            if records:
                store.add("benchmark_records", spark.createDataFrame([(name, seed, float(t), int(g), float(b), float(m)) for t, g, b, m in records], "algorithm string, seed long, time double, generation int, best double, mean double"))
            store._one("benchmark_runs", algorithm=name, seed=seed, fitness=value, seconds=time.time() - began, holdings=held)
    return failed


def report(store: Store, budget: float = 120.0, points: int = 500) -> dict[str, DataFrame]:
    """Tables of all analyses.  ``nemenyi`` has rows only if Friedman's p is under ``SIGNIFICANT``; convergence tables need records."""
    runs = store.read("benchmark_runs").select("algorithm", "seed", "fitness")
    records = stats.best_so_far(store.read("benchmark_records").select("algorithm", "seed", "time", "best"))
    f = stats.friedman(runs).withColumn("p", stats.chi2_p("chi2", (F.col("k") - 1).cast("double")))
    best = runs.where(F.col("fitness") > stats.FEASIBLE).agg(F.max("fitness")).first()[0]
    areas = stats.aocc(records, budget, float(best) if best is not None else 0.0)
    gate = f.select("k", "p").where(F.col("p") < SIGNIFICANT)
    return {
        "summary": stats.summary(runs), "aocc": areas.groupBy("algorithm").agg(F.median("aocc").alias("median"), F.avg("aocc").alias("mean")), "friedman": f, "mean_ranks": stats.mean_ranks(runs),
        "nemenyi": stats.nemenyi(runs).join(F.broadcast(gate), F.lit(True)).withColumn("p", stats.range_p("q", F.col("k").cast("double"))).drop("k"),
        "wilcoxon": stats.wilcoxon_pairs(runs).withColumn("significant", F.col("p") < SIGNIFICANT), "boxes": stats.boxes(runs),
        "convergence": stats.convergence(records, budget, points), "profile": stats.performance_profile(records, budget, points=points),
    }


def export_json(store: Store, path: str) -> None:
    """All runs with their records, a JSON object a line."""
    records = store.read("benchmark_records").groupBy("algorithm", "seed").agg(F.sort_array(F.collect_list(F.struct("time", "generation", "best", "mean"))).alias("records"))
    store.read("benchmark_runs").join(records, ["algorithm", "seed"], "left").write.mode("overwrite").json(path)


def load_json(store: Store, path: str) -> None:
    """Adds the runs of an export that the store has not."""
    schema = "algorithm string, seed long, fitness double, seconds double, holdings string, records array<struct<time: double, generation: int, best: double, mean: double>>"
    every = store.spark.read.schema(schema).json(path)
    new = written(every.join(store.read("benchmark_runs").select("algorithm", "seed"), ["algorithm", "seed"], "left_anti"), "runs")
    store.add("benchmark_records", new.select("algorithm", "seed", F.explode("records").alias("r")).select("algorithm", "seed", "r.*"))
    store.add("benchmark_runs", new.drop("records"), ["algorithm", "seed"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Runs search algorithms against each other and reports on them.")
    p.add_argument("--prices", help="a wide price file")
    p.add_argument("--output-dir", default="benchmark_results")
    p.add_argument("--time-budget", type=float, default=120.0, help="seconds a run")
    p.add_argument("--runs", type=int, default=30)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--quick", action="store_true", help="30 seconds, 5 runs")
    p.add_argument("--algorithms", nargs="+", choices=list(ADAPTERS))
    p.add_argument("--least", type=int, default=3)
    p.add_argument("--most", type=int, default=15)
    p.add_argument("--analyze-only", action="store_true")
    a = p.parse_args(argv)
    budget, runs = (30.0, 5) if a.quick else (a.time_budget, a.runs)
    spark = session("benchmark")
    store = Store(spark, f"{a.output_dir}/store")
    if a.analyze_only:
        if store.read("benchmark_runs").isEmpty():
            print(f"no runs in {a.output_dir}", file=sys.stderr)
            return 1
    else:
        if not a.prices:
            p.error("--prices is needed")
        given = moments.inputs(wide_csv(spark, a.prices))
        x = Inputs.of(given.mu, moments.covariance_matrix(given.rets))
        for line in run(spark, x, Rules(a.least, a.most, None), store, runs, a.seed, a.algorithms, budget):
            print(line, file=sys.stderr)
        export_json(store, f"{a.output_dir}/runs")
    for name, df in report(store, budget).items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output_dir}/{name}")
        if name not in ("convergence", "profile"):
            print(f"\n{name}\n{df.toPandas().to_string(index=False)}")
    print(json.dumps({"output": a.output_dir}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
