"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words without outer punctuation and the first four and six characters of each; they are
hashed to 2^20 buckets.  On a bounded sample of labelled rows (``Params.sample``, the stated bound) the buckets that tell the
classes apart (likelihood ratio) are kept, and of all others those that tell more together with another bucket than both do
alone, by more than the best of as many pairs would by chance.  Pairs are counted for every two buckets that share enough sampled rows to carry that much, task by task, each over
a part of the buckets.  A machine of second order,

    score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)   over the distinct buckets of a text,

learns what single terms and pairs of terms say: two terms that are harmless alone can weigh together.  Every text is scored whole.

Nulls: a null text is empty; its score is that of a text without terms.  Rows with a null id or label are never learnt from.  With no
labelled rows, or one class only, the score is the share of toxic rows (0 without any).  Repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangency.llm.common import fold_is, labelled_texts, map_arrow, partitions, rows, texts_of

BITS = 20
EDGE = ".,;:!?#$%&*|<>()[]{}\"'"


@dataclass(frozen=True)
class Params:
    sample: int = 16_000  # labelled rows learnt from, at most
    least_docs: int = 4  # sampled rows that a kept bucket is in, at least
    least_gain: float = 3.0  # log likelihood ratio of a kept bucket, at least
    rank: int = 4
    epochs: int = 12
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7


class Terms:
    """Hashed buckets of a word: whole, and its first four and six characters."""

    def __init__(self, limit: int = 300_000) -> None:
        self.of, self.limit = {}, limit

    def word(self, raw: bytes) -> tuple[int, ...]:
        import xxhash

        w = raw.decode("utf-8", "replace").strip(EDGE)
        names = {f"w:{w}"} if w else set()
        names |= {f"{n}:{w[:n]}" for n in (4, 6) if len(w) >= n}
        return tuple(xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in names)

    def __call__(self, text: bytes) -> set[int]:
        if len(self.of) > self.limit:
            self.of.clear()
        found: set[int] = set()
        for w in set(text.lower().split()):
            x = self.of.get(w)
            if x is None:
                x = self.of[w] = self.word(w)
            found.update(x)
        return found


@dataclass
class Machine:
    buckets: np.ndarray  # sorted hashed buckets
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, at: list[int]) -> float:
        if not at:
            return self.bias
        v = self.vectors[at]
        total = v.sum(0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum()))


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


def train(samples: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, p: Params) -> Machine:
    """AdaGrad on the logistic loss, rows weighted so that both classes count alike in the first epochs' gradients."""
    rng = np.random.default_rng(p.seed)
    m = len(buckets)
    n1 = int(labels.sum())
    if n1 in (0, len(labels)):
        share = n1 / len(labels) if len(labels) else 0.0
        return Machine(buckets, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(m), np.zeros((m, p.rank)))
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, p.rank))
    b = float(np.log(n1 / (len(labels) - n1)))
    gw, gv, gb = np.full(m, 1e-3), np.full((m, p.rank), 1e-3), 1e-3
    for _ in range(p.epochs):
        for r in rng.permutation(len(samples)):
            at = samples[r]
            va = v[at]
            total = va.sum(0)
            x = b + w[at].sum() + 0.5 * (total @ total - (va * va).sum())
            g = sigmoid(x) - labels[r]
            if abs(g) < 1e-4:
                continue
            gb += g * g
            b -= p.rate * g / gb**0.5
            if len(at):
                dw = g + p.decay * w[at]
                gw[at] += dw * dw
                w[at] -= p.rate * dw / np.sqrt(gw[at])
                dv = g * (total - va) + p.decay * va
                gv[at] += dv * dv
                v[at] = va - 0.2 * p.rate * dv / np.sqrt(gv[at])
    return Machine(buckets, b, w, v)


def _likelihood(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Log likelihood of k toxic rows of n under their own share."""
    n, k = np.maximum(n, 0.0), np.clip(k, 0.0, np.maximum(n, 0.0))
    return k * np.log(np.maximum(k, 1.0) / np.maximum(n, 1.0)) + (n - k) * np.log(np.maximum(n - k, 1.0) / np.maximum(n, 1.0))


@dataclass
class Sample:
    """Sampled rows as one array of buckets: row r has at[edge[r] : edge[r + 1]], places in ``buckets``, ascending; toxic rows come first."""

    buckets: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    toxic: int

    @staticmethod
    def of(found: pa.Table, least_docs: int) -> tuple[Sample, np.ndarray, np.ndarray]:
        """The sample with buckets of so many rows at least, and the rows and toxic rows of each."""
        labels = found.column("toxic").to_numpy()
        lists = found.column("at").combine_chunks()
        del found  # tens of MB each, and the driver is small
        lists = lists.take(pa.array(np.argsort(-labels, kind="stable")))
        offsets, at = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        toxic = int(labels.sum())
        n = np.bincount(at, minlength=1 << BITS)
        k = np.bincount(at[: int(offsets[toxic] - offsets[0])], minlength=1 << BITS)
        buckets = np.flatnonzero(n >= least_docs)
        place = np.full(1 << BITS, -1, np.int32)
        place[buckets] = np.arange(len(buckets), dtype=np.int32)
        own = place[at]
        del lists, at
        kept = own >= 0
        before = np.zeros(len(own) + 1, np.int32)
        np.cumsum(kept, out=before[1:])
        edge = before[offsets - offsets[0]].astype(np.int64)
        del before
        return Sample(buckets, own[kept], edge, toxic), n[buckets], k[buckets]

    def only(self, kept: np.ndarray) -> list[np.ndarray]:
        """Rows with places in ``kept`` (ascending places) only."""
        place = np.full(len(self.buckets), -1, np.int64)
        place[kept] = np.arange(len(kept))
        return [x[x >= 0] for x in (place[self.at[a:b]] for a, b in zip(self.edge[:-1], self.edge[1:], strict=True))]


def pair_need(p: Params, m: int, rows_: int, hits: int) -> tuple[float, int]:
    """(gain in log likelihood that a pair must reach, rows that it must be in): the best of m (m - 1) / 2 pairs by chance, and what rows can carry, each ln(1 / share) at most."""
    gain = p.least_gain + np.log(max(1.0, m * (m - 1) / 2))
    share = min(hits, rows_ - hits) / max(rows_, 1)
    return gain, max(p.least_docs, int(np.ceil(gain / np.log(1 / share)))) if 0 < share < 1 else rows_ + 1


def telling_in_pairs(s: Sample, n: np.ndarray, k: np.ndarray, hits: int, p: Params, part: int = 0, parts: int = 1) -> np.ndarray:
    """Places of buckets that with another one tell the classes apart better than both do alone, of the pairs whose lower place falls to this part."""
    rows_, m = len(s.edge) - 1, len(s.buckets)
    need, docs = pair_need(p, m, rows_, hits)
    n, k = n.astype(float), k.astype(float)
    alone = _likelihood(n, k) + _likelihood(rows_ - n, hits - k)
    base = float(_likelihood(np.array([float(rows_)]), np.array([float(hits)]))[0])
    own = np.flatnonzero((s.at % parts == part) & (n[s.at] >= docs))  # entries of this part's buckets
    row = np.searchsorted(s.edge, own, side="right") - 1
    order = np.argsort(s.at[own], kind="stable")  # by bucket; toxic rows stay first
    own, row = own[order], row[order]
    of = s.at[own]
    found: set[int] = set()
    if not len(of):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(of)), strict=True):
        i = int(of[a])
        ends = s.edge[row[a:b] + 1]
        # partners behind it in each of its rows: every pair is met once
        partners = [s.at[e + 1 : f] for e, f in zip(own[a:b].tolist(), ends.tolist(), strict=True)]
        first = int(np.searchsorted(row[a:b], s.toxic))
        c = np.bincount(np.concatenate(partners), minlength=m)
        j = np.flatnonzero(c >= docs)
        if not len(j):
            continue
        both = c[j].astype(float)
        toxic = np.bincount(np.concatenate(partners[:first]), minlength=m)[j].astype(float) if first else np.zeros(len(j))
        cells = _likelihood(both, toxic) + _likelihood(n[j] - both, k[j] - toxic) + _likelihood(n[i] - both, k[i] - toxic) + _likelihood(rows_ - n[j] - n[i] + both, hits - k[j] - k[i] + toxic)
        good = j[cells - alone[i] - alone[j] + base >= need]
        if len(good):
            found.add(i)
            found.update(good.tolist())
    return np.array(sorted(found), dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), where: object | None = None) -> Machine:
    """Learns from at most ``p.sample`` labelled rows of ``docs``; ``where`` narrows the labelled rows (a fold)."""
    joined = labelled_texts(docs, labels, p.sample, where=where, columns=("toxic",)).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    out = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32()))])

    def run(batches):
        terms = Terms()
        for batch in batches:
            yield rows(out, batch.column(2), [sorted(terms(t)) for t in texts_of(batch)])

    seen = map_arrow(joined, run, "toxic int, at array<int>")
    # at most p.sample rows, each with the buckets of a text
    s, n, k = Sample.of(seen.toArrow(), p.least_docs)
    size, hits = len(s.edge) - 1, s.toxic
    y = (np.arange(size) < hits).astype(float)
    share = hits / max(size, 1)

    def gained(a: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log(np.maximum(a, 1) / np.maximum(expected, 1e-300)), 0.0)

    strong = np.flatnonzero(gained(k, n * share) + gained(n - k, n * (1 - share)) >= p.least_gain) if 0 < hits < size else np.zeros(0, np.int64)
    paired = _paired(docs.sparkSession, s, n, k, hits, p) if 0 < hits < size else strong
    kept = np.union1d(strong, paired).astype(np.int64)
    both = sorted((tuple(at.tolist()), t) for at, t in zip(s.only(kept), y.tolist(), strict=True))
    return train([np.array(at, dtype=np.int64) for at, _ in both], np.array([t for _, t in both]), s.buckets[kept], p)


def _paired(spark: SparkSession, s: Sample, n: np.ndarray, k: np.ndarray, hits: int, p: Params) -> np.ndarray:
    """``telling_in_pairs``, a task for each part of the buckets; the sample goes to all tasks."""
    parts = 4 * partitions(spark)
    shared = spark.sparkContext.broadcast((s, n, k))

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(telling_in_pairs(*shared.value, hits, p, part, parts))], names=["at"])

    found = map_arrow(spark.range(0, parts, 1, parts), run, "at long").distinct().toArrow()  # places of buckets
    shared.destroy()
    return np.sort(found.column(0).to_numpy())


class Scorer:
    """Scores texts; what the buckets of a word are is remembered."""

    def __init__(self, machine: Machine, limit: int = 400_000) -> None:
        self.model, self.terms, self.limit = machine, Terms(), limit
        self.place = {int(b): i for i, b in enumerate(machine.buckets)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: bytes) -> float:
        known, place = self.known, self.place
        if len(known) > self.limit:
            known.clear()
        at: set[int] = set()
        for w in set(text.lower().split()):
            x = known.get(w)
            if x is None:
                x = known[w] = tuple(place[b] for b in self.terms.word(w) if b in place)
            if x:
                at.update(x)
        return sigmoid(self.model.raw(sorted(at)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each row, from the whole text."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2^20 buckets at most

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield rows(out, batch.column(0), [scorer(t) for t in texts_of(batch)])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), held_out_fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of the held-out fold are never looked at."""
    machine = fit(docs, labels, p, ~fold_is("doc_id", held_out_fold, 0))
    return score(docs, machine).select("doc_id", fold_is("doc_id", held_out_fold, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as they were."""
    machine = fit(docs, labels, p, ~fold_is("doc_id", 5, 0))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) < threshold for t in texts_of(batch)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
