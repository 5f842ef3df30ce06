"""Product codes of vectors: a codebook for each part position, found by Yinyang Lloyd rounds in exact integers.

Entries of a codebook are clustered into groups once.  Each vector part carries its entry and one lower bound for each group: no entry of the group but its own is
nearer.  After a round the bound sinks by the largest drift of the group; the distance to the part's own entry is computed anew, and only groups whose bound
is not above it are scanned.  Bounds are fixed-point numbers rounded down, drifts rounded up, so a skipped group cannot hold the nearest entry nor one at the
same distance; what is scanned is compared by (integer squared distance, index).  So the codes are Lloyd's own, ties included.

Tasks hold one batch of vectors.  A round writes (vector, codes, bounds) to the shared folder; to the driver come sums and counts of entries only (parts x
entries rows, whatever the input).

Components are floor(256 x).  Rows whose vector is null or holds a null or non-finite component are left out.  Vectors must be of one length, a multiple of
``parts``, with components under 2^18 in size, else ValueError (squared distances and their sums are 64-bit integers).  Codebooks begin with the vectors of the least ids (a null id is the
largest; of equal ids the least vector is first); with fewer rows than ``entries`` they are shorter.  Repeated rows are coded each.  An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import map_arrow, slices, written

SCALE = 256
LARGEST = 1 << 26  # of an integer component
UNIT = 16  # bounds are in sixteenths
FULL = (1 << 15) - 1  # the largest bound that is kept


@dataclass(frozen=True)
class Params:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    groups: int = 8


@dataclass
class Books:
    """Codebooks (parts x entries x width), the group of each entry, and how far each group may have moved in the last round (sixteenths, rounded up)."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of rows with a whole, finite vector; v: the components as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", v.alias("v"))


def integers(values: np.ndarray) -> np.ndarray:
    out = np.floor(values * SCALE)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} or more in size")
    return out.astype(np.int64)


def first_books(kept: DataFrame, p: Params) -> Books | None:
    """From the least ids; ``entries`` vectors come to the driver."""
    rows = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(p.entries).collect()
    if not rows:
        return None
    lengths = {len(r[1]) for r in rows}
    if len(lengths) > 1 or min(lengths) % p.parts or not min(lengths):
        raise ValueError(f"vectors of one length, a multiple of {p.parts}, are wanted: {sorted(lengths)}")
    x = integers(np.array([r[1] for r in rows], float)).reshape(len(rows), p.parts, -1).transpose(1, 0, 2)
    return Books(np.ascontiguousarray(x), np.array([grouped(book, p.groups) for book in x]), np.zeros((p.parts, p.groups), np.int64))


def grouped(book: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: centres far from each other, then a few rounds of means; any grouping gives the same codes."""
    centres = book[[0]].astype(float)
    while len(centres) < groups:
        gap = ((book[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, book[[int(gap.argmax())]]])
    for _ in range(5):
        own = ((book[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centres[g] = book[own == g].mean(axis=0)
    return own


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to the rows of ``y``, one component at a time."""
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - y[None, :, k]
        out += d * d
    return out


def low_bounds(d2: np.ndarray) -> np.ndarray:
    """Distances in sixteenths, rounded down (a unit less, for the square root's own rounding)."""
    return np.clip(np.floor(np.sqrt(d2.astype(float)) * UNIT) - 1, 0, FULL).astype(np.int64)


def scan(x: np.ndarray, book: np.ndarray, groups: np.ndarray, drift: np.ndarray, own: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, bounds, squared distance, distances computed) of the rows of ``x``, given their last entry and bounds; without these all groups are scanned."""
    n, far = len(x), np.iinfo(np.int64).max
    if own is None:
        own, best = np.full(n, len(book)), np.full(n, far)
        bounds, above = np.zeros((n, len(drift)), np.int64), np.zeros((n, len(drift)), bool)
        cost = 0
    else:
        best = ((x - book[own]) ** 2).sum(axis=1)
        bounds = np.maximum(bounds - drift[None, :], 0)
        # a bound of 0 says nothing; the own distance is rounded up
        above = bounds > np.ceil(np.sqrt(best.astype(float)) * UNIT)[:, None] + 1
        cost = n
    before, before2 = own.copy(), best.copy()
    first, second = np.full((n, len(drift)), far), np.full((n, len(drift)), far)
    for g in range(len(drift)):
        members = np.flatnonzero(groups == g)
        if not len(members):
            bounds[:, g] = FULL
            continue
        rows = np.flatnonzero(~above[:, g])
        if not len(rows):
            continue
        d2 = squares(x[rows], book[members])
        cost += d2.size
        at = d2.argmin(axis=1)  # members ascend, so the first least is the least index
        least = d2[np.arange(len(rows)), at]
        first[rows, g] = least
        if len(members) > 1:
            second[rows, g] = np.partition(d2, 1, axis=1)[:, 1]
        index = members[at]
        nearer = (least < best[rows]) | ((least == best[rows]) & (index < own[rows]))
        best[rows[nearer]], own[rows[nearer]] = least[nearer], index[nearer]
    home = groups[own]
    for g in range(len(drift)):
        rows = np.flatnonzero(first[:, g] < far)
        bounds[rows, g] = low_bounds(np.where(home[rows] == g, second[rows, g], first[rows, g]))
    # the entry that a part left is one of its group's others now, if the group was not scanned
    left = np.flatnonzero((before != own) & (before < len(book)))
    if len(left):
        g = groups[before[left]]
        skipped = above[left, g]
        rows, g = left[skipped], g[skipped]
        bounds[rows, g] = np.minimum(bounds[rows, g], low_bounds(before2[rows]))
    return own, bounds, best, cost


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of a matrix as lists."""
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(values.ravel(), kind))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    if batch.num_rows and not (np.diff(column.offsets.to_numpy()) == width).all():
        raise ValueError(f"vectors of {width} components are wanted")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


STATE = "vec_id {id}, label {label}, v array<int>, code array<smallint>, bounds array<smallint>, error long, scanned long"


def assigned(rows: DataFrame, books: Books, begun: bool) -> DataFrame:
    """Each part's entry under ``books``; ``begun``: ``rows`` have codes and bounds of the round before."""
    entries, groups, drift = books.entries, books.groups, books.drift
    parts, _, width = entries.shape
    kinds = dict(rows.dtypes)
    schema = STATE.format(id=kinds["vec_id"], label=kinds["label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000):
            v = matrix(batch, "v", parts * width)
            x = v.astype(np.int64) if begun else integers(v)
            code, error, cost = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64), 0
            bounds = np.zeros((len(x), parts, drift.shape[1]), np.int64)
            if begun:
                code[:], bounds[:] = matrix(batch, "code", parts), matrix(batch, "bounds", bounds[0].size if len(x) else parts * drift.shape[1]).reshape(bounds.shape)
            for p in range(parts):
                own, near = (code[:, p].copy(), bounds[:, p].copy()) if begun else (None, None)
                code[:, p], bounds[:, p], best, done = scan(x[:, p * width : (p + 1) * width], entries[p], groups[p], drift[p], own, near)
                error += best
                cost += done
            scanned = np.zeros(len(x), np.int64)
            scanned[:1] = cost
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("label")), lists(x, pa.int32()), lists(code, pa.int16()), lists(bounds.reshape(len(x), -1), pa.int16()), pa.array(error), pa.array(scanned)],
                names=["vec_id", "label", "v", "code", "bounds", "error", "scanned"],
            )

    return map_arrow(rows, run, schema)


def moved(state: DataFrame, books: Books) -> Books:
    """Entries at the floor of their parts' mean, and the drifts.  Sums are made in each task, added by (part, entry), and come to the driver."""
    entries = books.entries
    parts, size, width = entries.shape
    names = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            x, code = matrix(batch, "v", parts * width).astype(np.int64).reshape(-1, parts, width), matrix(batch, "code", parts)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=size)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), *[pa.array(sums[p, e, k]) for k in range(width)]], names=["part", "entry", "n", *names])

    partial = map_arrow(state.select("v", "code"), run, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in names))
    new = entries.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        new[r["part"], r["entry"]] = [r[c] // r["n"] for c in names]
    gone = np.ceil(np.sqrt(((new - entries) ** 2).sum(axis=2).astype(float)) * UNIT).astype(np.int64) + 1
    gone[(new == entries).all(axis=2)] = 0
    drift = np.zeros_like(books.drift)
    for p in range(parts):
        np.maximum.at(drift[p], books.groups[p], gone[p])
    return Books(new, books.groups, drift)


def compressed(vectors: DataFrame, p: Params = Params()) -> tuple[DataFrame, Books | None]:
    """(vec_id, label, v, code, bounds, error, scanned) of each kept row, and the codebooks; scanned: distances computed, on the first row of each batch."""
    kept = kept_rows(vectors)
    books = first_books(kept, p)
    if books is None:
        kinds = dict(kept.dtypes)
        return vectors.sparkSession.createDataFrame([], STATE.format(id=kinds["vec_id"], label=kinds["label"])), None
    state = kept
    for i in range(p.rounds):
        state = written(assigned(state, books, i > 0), f"codes-{i}")
        books = moved(state, books)
    return written(assigned(state, books, p.rounds > 0), "codes"), books


def codes(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    coded, books = compressed(vectors, p)
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own_label")
    text = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    out = coded.join(total, coded["label"].eqNullSafe(total["own_label"]))
    return out.select("vec_id", text.alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
