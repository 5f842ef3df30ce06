"""Importance resampling with hashed n-gram models (after Xie et al., "Data Selection for Language Models via Importance Resampling").

A text is a bag of hashed words and word pairs in ``Params.buckets`` buckets.  Two generative bag models are estimated, with add-one
smoothing: one of the target, one of all raw texts; a text's log weight is its log likelihood ratio.  A Gumbel variate from a hash of
the id is added to each log weight, and the texts of the k largest sums are a sample without replacement in proportion to the weights.

The target is stated text: rows labelled good, at most ``Params.target_rows`` of them (the bound of the fit), or a table of texts.  The raw
model counts all rows.  The k-th largest sum is found by counting, not by sorting: rounds of histograms between the bounds of the cell that holds it.

Nulls: a null text is empty, its log weight is 0.  Null ids hash as the empty text.  Without target rows all weights are 0 and the sample is uniform.
Repeated rows have equal sums; of ties at the threshold, which are equal rows, as many are kept as the sample lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import U64, WordHashes, labelled_texts, map_arrow, mix, rows, texts_of, written


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    target_rows: int = 20_000
    share: float = 0.8  # of all rows that the sample has
    seed: int = 11


def bag(text: bytes, hashes: WordHashes, buckets: int) -> np.ndarray:
    """Hashed buckets of the words and word pairs of a text, A-Z lower-cased."""
    h = hashes(text.lower().split())
    if not len(h):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = h[:-1] * U64(3) ^ mix(h[1:], 1)
    return (mix(np.concatenate([h, pairs]), 2) % U64(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets over all rows: a row of ``buckets`` numbers from each task, added up on executors."""
    out = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        hashes, total = WordHashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in texts_of(batch):
                total += np.bincount(bag(t, hashes, buckets), minlength=buckets)
        yield rows(out, np.arange(buckets, dtype=np.int32), total)

    summed = map_arrow(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in summed.collect():  # Params.buckets rows
        total[r[0]] = r[1]
    return total


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the smoothed target over the smoothed raw probability of each bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def weighed(docs: DataFrame, ratio: np.ndarray, p: Params) -> DataFrame:
    """(doc_id, log_weight, perturbed) of each row."""
    import xxhash

    out = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("perturbed", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # Params.buckets numbers

    def gumbel(i: int | None) -> float:
        u = (xxhash.xxh64_intdigest(b"" if i is None else str(i).encode(), p.seed) + 0.5) / 2.0**64
        return float(-np.log(-np.log(min(max(u, 1e-300), 1 - 1e-16))))

    def run(batches):
        hashes, of = WordHashes(), shared.value
        for batch in batches:
            w = [float(of[bag(t, hashes, p.buckets)].sum()) for t in texts_of(batch)]
            yield rows(out, batch.column(0), w, [x + gumbel(i) for x, i in zip(w, batch.column(0).to_pylist(), strict=True)])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, log_weight double, perturbed double")


def kth_largest(keys: DataFrame, column: str, k: int, width: int = 4096) -> tuple[float, int]:
    """(the k-th largest value, how many larger ones there are), by rounds of histograms of at most ``width`` rows.

    Each round counts the values between two bounds in equal cells and goes on in the cell of the k-th; 64-bit doubles settle in a few rounds.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        step = (high - low) / width
        if step == 0 or low + step == low:
            break
        cell = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(width - 1))
        inside = keys.where(F.col(column).between(F.lit(low), F.lit(high))).groupBy(cell.alias("cell"))
        cells = {int(r["cell"]): r for r in inside.agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for c in sorted(cells, reverse=True):
            if above + cells[c]["n"] >= k:
                if (cells[c]["lo"], cells[c]["hi"]) == (low, high):
                    step = 0
                low, high = cells[c]["lo"], cells[c]["hi"]
                break
            above += cells[c]["n"]
        if step == 0:
            break
    return high, above


def resampled(docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, log_weight, perturbed, kept) of each row; kept marks the sample of ``p.share`` of the rows."""
    ratio = log_ratio(bucket_counts(target, p.buckets), bucket_counts(docs, p.buckets))
    scored = written(weighed(docs, ratio, p), "weights")
    n = scored.count()
    k = round(p.share * n)
    if not k:
        return scored.withColumn("kept", F.lit(False))
    edge, above = kth_largest(scored, "perturbed", k)
    at_edge = scored.where(F.col("perturbed") == F.lit(edge))
    ties = at_edge.count()
    if above + ties == k:
        return scored.withColumn("kept", F.col("perturbed") >= F.lit(edge))
    # such rows are equal but for coincidences: numbered where they lie (a task's number, then a row's), and kept up to one number
    numbered = written(at_edge.withColumn("number", F.monotonically_increasing_id()), "ties")
    stop, left = 0, k - above
    for task, n in sorted(tuple(r) for r in numbered.groupBy(F.shiftright("number", 33).alias("task")).agg(F.count("*").alias("n")).collect()):  # a row for each task
        stop = (task << 33) + min(n, left)
        left -= min(n, left)
        if not left:
            break
    ranked = numbered.withColumn("kept", F.col("number") < F.lit(stop)).drop("number")
    return scored.where(F.col("perturbed") != F.lit(edge)).withColumn("kept", F.col("perturbed") > F.lit(edge)).unionByName(ranked)


def good_rows(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Texts labelled good, at most ``p.target_rows``."""
    return labelled_texts(docs, labels, p.target_rows, where="quality = 1", columns=("quality",)).select("text")
