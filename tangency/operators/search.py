"""Cardinality search: which tickers to hold.  Candidates are sparse, (candidate_id, ticker); every random choice is a hash of its key."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tangency.durable import written
from tangency.functions.randomness import digest, uniform
from tangency.operators import weights
from tangency.operators.portfolio import equal_weight_fitness
from tangency.session import ship

UNIVERSE = 100_000  # tickers that are sent to all tasks at most; a ticker is some bytes

# ------------------------------------------------------------------------------------------- set-based operators


def small(tickers: DataFrame) -> DataFrame:
    """The universe as a table that may be broadcast: an error beyond ``UNIVERSE`` tickers, where a search over all of them has no sense."""
    names = tickers.select("ticker").limit(UNIVERSE + 1).collect()
    if len(names) > UNIVERSE:
        raise ValueError(f"over {UNIVERSE} tickers: narrow the universe first")
    return F.broadcast(tickers.sparkSession.createDataFrame(names, "ticker string"))


def bernoulli(ids: DataFrame, tickers: DataFrame, most: int, n: int, seed: int, least: int = 0) -> DataFrame:
    """Each ticker with probability most / n; with ``least``, candidates below it take the ``least`` first tickers by hash instead."""
    if not 0 < most <= n:
        raise ValueError("the largest number of holdings must lie in 1 .. number of tickers")
    each = ids.select("candidate_id").join(small(tickers), F.lit(True))
    gene = uniform(seed, "init", F.col("candidate_id"), F.col("ticker")) < most / n
    if not least:
        return each.where(gene)
    w = Window.partitionBy("candidate_id")
    marked = each.withColumn("gene", gene).withColumn("k", F.sum(F.col("gene").cast("int")).over(w)).withColumn("r", F.row_number().over(w.orderBy(digest(seed, "fill", F.col("candidate_id"), F.col("ticker")))))
    return marked.where(F.when(F.col("k") >= least, F.col("gene")).otherwise(F.col("r") <= least)).select("candidate_id", "ticker")


def numbered(tickers: DataFrame) -> tuple[DataFrame, int]:
    """((at, ticker) by name, for broadcast; how many): places are from 0."""
    names = sorted(r[0] for r in small(tickers).distinct().collect())
    return F.broadcast(tickers.sparkSession.createDataFrame(list(enumerate(names)), "at long, ticker string")), len(names)


def subsets(ids: DataFrame, tickers: DataFrame, least: int, most: int, seed: int) -> DataFrame:
    """Uniform subsets of k tickers without replacement, k uniform in least .. most.

    Floyd's draws: the j-th of the last k places draws one of the places up to it, and takes its own where that one is taken.  A candidate costs k draws, whatever the universe.
    """
    names, n = numbered(tickers)
    k = least + F.floor(uniform(seed, "k", F.col("candidate_id")) * (most - least + 1))
    drawn = ids.select("candidate_id", k.alias("k")).withColumn("k", F.least("k", F.lit(n)))
    turns = F.transform(F.sequence(F.lit(n) - F.col("k"), F.lit(n - 1).cast("long")), lambda j: F.struct(j.alias("own"), F.floor(uniform(seed, "pick", F.col("candidate_id"), j) * (j + 1)).alias("draw")))
    places = F.aggregate(turns, F.array().cast("array<bigint>"), lambda got, j: F.array_append(got, F.when(F.array_contains(got, j["draw"]), j["own"]).otherwise(j["draw"])))
    return drawn.where(F.col("k") > 0).select("candidate_id", F.explode(places).alias("at")).join(names, "at").select("candidate_id", "ticker")


def best(fitness: DataFrame, n: int) -> DataFrame:
    """The n fittest of each island, ties by id; selection and elitism both."""
    return fitness.withColumn("rank", F.row_number().over(Window.partitionBy("island").orderBy(F.desc("fitness"), "candidate_id"))).where(F.col("rank") <= n)


def crossover(parents: DataFrame, genes: DataFrame, tickers: DataFrame, children: int, seed: int) -> DataFrame:
    """(island, child, ticker): two parents by hash (they may be one), each gene from either by a coin."""
    spark = parents.sparkSession
    n = parents.groupBy("island").agg(F.max("rank").alias("n"))
    kids = n.join(F.broadcast(spark.range(children).withColumnRenamed("id", "child")), F.lit(True))
    pick = lambda s: 1 + F.floor(uniform(seed, s, F.col("island"), F.col("child")) * F.col("n"))
    kids = kids.select("island", "child", pick("p1").alias("r1"), pick("p2").alias("r2"))
    for i in ("1", "2"):
        kids = kids.join(parents.select("island", F.col("rank").alias(f"r{i}"), F.col("candidate_id").alias(f"c{i}")), ["island", f"r{i}"])
    held = genes.select("candidate_id", "ticker").withColumn("one", F.lit(1))
    each = kids.join(small(tickers), F.lit(True))
    for i in ("1", "2"):
        each = each.join(held.select(F.col("candidate_id").alias(f"c{i}"), "ticker", F.col("one").alias(f"g{i}")), [f"c{i}", "ticker"], "left")
    gene = F.when(uniform(seed, "coin", F.col("island"), F.col("child"), F.col("ticker")) < 0.5, F.coalesce("g1", F.lit(0))).otherwise(F.coalesce("g2", F.lit(0)))
    return each.select("island", "child", "ticker", gene.alias("gene"))


def mutate(offspring: DataFrame, rate: float, seed: int) -> DataFrame:
    flip = uniform(seed, "flip", F.col("island"), F.col("child"), F.col("ticker")) < rate
    return offspring.withColumn("gene", F.when(flip, 1 - F.col("gene")).otherwise(F.col("gene")))


def migrants(fitness: DataFrame, islands: int, n: int) -> DataFrame:
    """(island, candidate_id): the n fittest of each island, sent to the next of the ring."""
    return best(fitness, n).select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "candidate_id", "fitness")


def milp(mu: DataFrame, vol: DataFrame, aversion: float, most: int) -> DataFrame:
    """Maximises sum of (mu - aversion x volatility) over at most ``most`` tickers.  Separable, so the exact optimum is the top positive scores."""
    score = F.col("mu") - F.lit(aversion) * F.col("vol")
    return mu.join(vol, "ticker").select("ticker", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "ticker").limit(most)


def milp_sharpe(picked: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """(n, ret, sharpe): equal weights over a selection (ticker, ...); one row, zeros if the selection is empty."""
    own = picked.select(F.lit(0).alias("candidate_id"), "ticker")
    rated = equal_weight_fitness(own, mu, cov, 0, UNIVERSE, None)
    return rated.agg(F.coalesce(F.max("k"), F.lit(0)).alias("n"), F.coalesce(F.max("ret"), F.lit(0.0)).alias("ret"), F.coalesce(F.max("fitness"), F.lit(0.0)).alias("sharpe"))


def survivors(parents: DataFrame, children: DataFrame, elites: int, size: int) -> DataFrame:
    """(island, candidate_id, fitness, elite): the next generation of each island, its ``elites`` fittest parents as they are and the fittest children beside them, ``size`` in all."""
    kept = best(parents, elites).select("island", "candidate_id", "fitness", F.lit(True).alias("elite"))
    new = best(children, size - elites).select("island", "candidate_id", "fitness", F.lit(False).alias("elite"))
    return kept.unionByName(new)


def monte_carlo(spark: SparkSession, mu: DataFrame, cov: DataFrame, trials: int, least: int, most: int, seed: int) -> DataFrame:
    """Fitness of random subsets, as one relational plan."""
    ids = spark.range(trials).withColumnRenamed("id", "candidate_id")
    return equal_weight_fitness(subsets(ids, mu.select("ticker"), least, most, seed), mu, cov, least, most, None)


# ------------------------------------------------------------------------------------------------ dense search


@dataclass(frozen=True)
class Inputs:
    """What searches need of a universe: names, expected returns, covariance.  Thousands of tickers at most."""

    names: tuple[str, ...]
    mu: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(mu: DataFrame, cov: DataFrame) -> Inputs:
        """Names and returns, and the covariance as a row of numbers for each name."""
        got = sorted((r["ticker"], r["mu"]) for r in mu.select("ticker", "mu").collect())
        names = tuple(r[0] for r in got)
        if not names:
            raise ValueError("no tickers")
        number = mu.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "ticker string, i int")
        i, j = number.select(F.col("ticker").alias("ti"), "i"), number.select(F.col("ticker").alias("tj"), F.col("i").alias("j"))
        rows = cov.join(F.broadcast(i), "ti").join(F.broadcast(j), "tj").groupBy("i").agg(F.collect_list("j").alias("j"), F.collect_list("cov").alias("cov"))
        c = np.zeros((len(names), len(names)))
        for batch in rows.toArrow().to_batches():
            for k, at, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                c[k, at.values.to_numpy()] = values.values.to_numpy(zero_copy_only=False)
        return Inputs(names, np.array([r[1] for r in got], dtype=float), c)


@dataclass(frozen=True)
class Rules:
    least: int = 8
    most: int = 20
    min_return: float | None = 0.12
    penalty: float = -1e4


def fitness(genes: np.ndarray, x: Inputs, rules: Rules) -> np.ndarray:
    """Equal-weight Sharpe of 0/1 rows with penalties, all rows at once."""
    k = genes.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = genes / np.maximum(k, 1)[:, None]
        ret = w @ x.mu
        var = np.einsum("ij,ij->i", w @ x.cov, w)
        out = np.where(var > 0, ret / np.sqrt(np.maximum(var, 1e-300)), 0.0)
    bad = (k < rules.least) | (k > rules.most)
    if rules.min_return is not None:
        bad |= ret < rules.min_return
    return np.where(bad, rules.penalty, out)


def drawn_places(rng: np.random.Generator, count: int, n: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes) of ``count`` uniform subsets by Floyd's draws, ``most`` columns of which the first of each row's size count."""
    most = min(most, n)
    k = rng.integers(min(least, most), most + 1, count)
    places = np.zeros((count, most), np.int64)
    for step in range(most):
        own = n - k + step
        draw = (rng.random(count) * (own + 1)).astype(np.int64)
        taken = (places[:, :step] == draw[:, None]).any(axis=1)
        places[:, step] = np.where(taken, own, draw)
    places[np.arange(most)[None, :] >= k[:, None]] = 0
    return places, k


def sparse_fitness(places: np.ndarray, k: np.ndarray, x: Inputs, rules: Rules) -> np.ndarray:
    """``fitness`` of subsets given as places: gathers of k returns and k x k covariances, no row as wide as the universe."""
    use = np.arange(places.shape[1])[None, :] < k[:, None]
    ret = np.where(use, x.mu[places], 0.0).sum(axis=1) / np.maximum(k, 1)
    total = np.zeros(len(k))
    for i in range(places.shape[1]):
        line = x.cov[places[:, [i]], places[:, : i + 1]]
        line[:, :i] *= 2
        total += np.where(use[:, [i]] & use[:, : i + 1], line, 0.0).sum(axis=1)
    var = total / np.maximum(k, 1) ** 2
    out = np.where(var > 0, ret / np.sqrt(np.maximum(var, 1e-300)), 0.0)
    bad = (k < rules.least) | (k > rules.most)
    if rules.min_return is not None:
        bad |= ret < rules.min_return
    return np.where(bad, rules.penalty, out)


@dataclass(frozen=True)
class Genetic:
    """One engine for all evolutionary strategies.  ``crossover``: uniform or single point; ``selection``: truncation or linear rank."""

    population: int = 400
    generations: int = 20
    elites: int = 10
    parents: float = 0.5
    crossover: str = "uniform"
    crossover_rate: float = 1.0
    selection: str = "truncation"
    mutation: float | None = None  # per gene; 1 / n if none
    islands: int = 4
    interval: int = 5
    migration: float = 0.05  # share of an island that migrates; 0 for none
    saturate: int | None = None  # generations without gain after which a run stops


def evolve(genes: np.ndarray, x: Inputs, rules: Rules, g: Genetic, rounds: int, rng: np.random.Generator, until: float | None = None, score=fitness) -> tuple[np.ndarray, list[tuple[float, float, float, np.ndarray]]]:
    """``rounds`` generations of one island; of each (wall clock, best and mean fitness, best genes) is recorded before it is replaced.

    Stops after the generation in which the clock passes ``until``, and after ``g.saturate`` generations without gain.
    """
    n = genes.shape[1]
    rate, seen = g.mutation if g.mutation is not None else 1.0 / n, []
    for _ in range(rounds):
        f = score(genes, x, rules)
        order = np.argsort(-f, kind="stable")
        seen.append((time.time(), float(f[order[0]]), float(f.mean()), genes[order[0]].copy()))
        if until is not None and seen[-1][0] > until:
            break
        if g.saturate and len(seen) > g.saturate and seen[-1][1] <= seen[-1 - g.saturate][1]:
            break
        elite = genes[order[: g.elites]]
        pool = order[: max(2, int(g.parents * len(genes)))]
        weight = None
        if g.selection == "rank":
            weight = np.arange(len(pool), 0, -1.0)
            weight /= weight.sum()
        kids = len(genes) - len(elite)
        p1, p2 = rng.choice(pool, kids, p=weight), rng.choice(pool, kids, p=weight)
        if g.crossover == "uniform":
            mask = rng.random((kids, n)) < 0.5
        else:
            mask = np.arange(n)[None, :] < rng.integers(1, max(2, n), kids)[:, None]
        mask |= (rng.random(kids) >= g.crossover_rate)[:, None]
        child = np.where(mask, genes[p1], genes[p2])
        child ^= rng.random((kids, n)) < rate
        genes = np.concatenate([elite, child])
    return genes, seen


HISTORY = "island int, generation int, seconds double, best_fitness double, mean_fitness double, holdings string"


STATE = "island int, bits binary, tops binary, clock array<double>, best array<double>, mean array<double>, held array<string>"


def island_search(spark: SparkSession, x: Inputs, rules: Rules, g: Genetic, seed: int, budget: float | None = None) -> DataFrame:
    """(island, generation, seconds, best_fitness, mean_fitness, holdings): islands in parallel tasks, ring migration between rounds.

    Populations are rows keyed by island in the shared folder: a round reads the last one's table, joins each island with what its neighbour sends, and writes the next; a lost task is run again
    from it.  To the driver come each generation's best, mean and holdings.  Random numbers are those of one generator of ``seed``; an island draws its part of the first populations itself.
    ``budget`` seconds end the search with the generation that passes them.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast((x, rules, g))  # a universe of thousands at most
    size, n = max(2, g.population // g.islands), len(x.names)
    rng = np.random.Generator(np.random.PCG64(seed).advance(g.islands * size * n))  # behind the first populations
    began, history, done = time.time(), [], [0] * g.islands
    until = None if budget is None else began + budget
    move = int(g.migration * size) if g.islands > 1 else 0

    def packed(genes: np.ndarray) -> bytes:
        return np.packbits(genes).tobytes()

    def unpacked(bits: bytes, rows: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bits, np.uint8))[: rows * n].reshape(rows, n).astype(bool)

    def step(frames):
        data, rule, how = shared.value
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if r.bits is None:
                    own = np.random.Generator(np.random.PCG64(seed).advance(int(r.island) * size * n))
                    genes = own.random((size, n)) < min(rule.most, n) / n
                else:
                    genes = unpacked(r.bits, size)
                    if move:
                        genes[np.asarray(r.leave, int)] = unpacked(r.incoming, move)
                genes, seen = evolve(genes, data, rule, how, int(r.rounds), np.random.default_rng(r.seed), until)
                tops = np.argsort(-fitness(genes, data, rule), kind="stable")[:move]
                held = [",".join(np.array(data.names)[best]) for *_, best in seen]
                out.append((r.island, packed(genes), packed(genes[tops]), [s[0] for s in seen], [s[1] for s in seen], [s[2] for s in seen], held))
            yield pd.DataFrame(out, columns=["island", "bits", "tops", "clock", "best", "mean", "held"])

    state, leave = None, [[] for _ in range(g.islands)]
    while max(done) < g.generations and (until is None or time.time() <= until):
        rounds = min(g.interval, g.generations - max(done))
        start = [(i, int(rng.integers(1 << 31)), rounds, leave[i]) for i in range(g.islands)]
        turn = spark.createDataFrame(start, "island int, seed long, rounds int, leave array<int>")
        if state is None:
            turn = turn.withColumns({"bits": F.lit(None).cast("binary"), "incoming": F.lit(None).cast("binary")})
        else:
            sent = state.select(((F.col("island") + 1) % g.islands).alias("island"), F.col("tops").alias("incoming"))
            turn = turn.join(state.select("island", "bits"), "island").join(sent, "island")
        state = written(turn.repartition(g.islands, "island").mapInPandas(step, STATE), "islands")
        found = sorted(state.drop("bits", "tops").collect(), key=lambda r: r["island"])
        for r in found:
            i = r["island"]
            history += [(i, done[i] + k, max(0.0, c - began), b, m, h) for k, (c, b, m, h) in enumerate(zip(r["clock"], r["best"], r["mean"], r["held"], strict=True))]
            done[i] += len(r["best"])
        if min(len(r["best"]) for r in found) < rounds:
            break  # saturated, or out of time
        if move:
            leave = [rng.choice(size, move, replace=False).tolist() for _ in range(g.islands)]
    return spark.createDataFrame(history, HISTORY)


def best_over_islands(history: DataFrame) -> DataFrame:
    """(island, generation, best_fitness, holdings) of the largest fitness; of equals the first island and generation."""
    return history.orderBy(F.desc("best_fitness"), "island", "generation").limit(1).select("island", "generation", "best_fitness", "holdings")


# ------------------------------------------------------------------------------- choices scored by their best weights


@dataclass(frozen=True)
class Box:
    """Bounds of weights in ``optimised_fitness``."""

    low: float = 0.0
    high: float = 0.45


def optimised_fitness(genes: np.ndarray, x: Inputs, rules: Rules, box: Box = Box()) -> np.ndarray:
    """Of 0/1 rows: the best ratio of the chosen names (-1 below two), less the squared excess or lack of names.

    Each different row is solved once, exactly (``weights.max_sharpe``).
    """
    different, of = np.unique(genes, axis=0, return_inverse=True)
    k = different.sum(axis=1)
    out = np.full(len(different), -1.0)
    for i in np.flatnonzero(k >= 2):
        out[i] = weights.best_ratio(x.mu[different[i]], x.cov[np.ix_(different[i], different[i])], box.low, box.high)
    return (out - np.maximum(0, k - rules.most) ** 2 - np.maximum(0, rules.least - k) ** 2)[of.ravel()]


#: The generational search over choices scored by their best weights.
CARDINALITY = Genetic(population=100, generations=6, elites=0, parents=0.1, crossover="point", crossover_rate=0.85, selection="rank", islands=1, migration=0, saturate=5)


def cardinality_portfolios(spark: SparkSession, x: Inputs, rules: Rules, g: Genetic, seeds: list[int], box: Box = Box(), budget: float | None = None) -> DataFrame:
    """(portfolio, generations, fitness, mean_fitness, ticker): one search for each seed, each a task; a row for each name held.

    A first individual with under ``rules.least`` names is drawn anew.  ``fitness`` is the best seen, ``mean_fitness`` the last generation's.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast((x, rules, g, box))  # a universe of thousands at most

    def run(frames):
        data, rule, how, bounds = shared.value
        n = len(data.names)
        for pdf in frames:
            for portfolio, seed in zip(pdf["portfolio"], pdf["seed"], strict=True):
                rng = np.random.default_rng(int(seed))
                genes = rng.random((how.population, n)) < min(rule.most, n) / n
                while (few := genes.sum(axis=1) < min(rule.least, n)).any():
                    genes[few] = rng.random((int(few.sum()), n)) < max(rule.most, 1) / n
                until = None if budget is None else time.time() + budget
                _, seen = evolve(genes, data, rule, how, how.generations, rng, until, lambda a, b, c: optimised_fitness(a, b, c, bounds))
                _, best, _, top = max(seen, key=lambda s: s[1])
                yield pd.DataFrame({"portfolio": int(portfolio), "generations": len(seen), "fitness": best, "mean_fitness": seen[-1][2], "ticker": [data.names[i] for i in np.flatnonzero(top)]})

    rows = spark.createDataFrame(list(enumerate(seeds)), "portfolio long, seed long").repartition(len(seeds), "portfolio")
    return rows.mapInPandas(run, "portfolio long, generations int, fitness double, mean_fitness double, ticker string")
