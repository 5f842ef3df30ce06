"""Shared pieces of the text operators: tokenisation, durable intermediate tables, bounded label samples, packing.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D and lower case is taken over A-Z only, both on UTF-8 bytes;
``bytes.split()`` and ``bytes.lower()`` are exactly these two operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tangency.durable import written  # noqa: F401  the operators take it from here
from tangency.session import ship

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle deals out to; the cluster sizes it with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ------------------------------------------------------------------------------------------------ Arrow mapping


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts of a batch; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b"" if t is None else t for t in col.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``size`` rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def rows(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------------------------------------------- hashing


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser of splitmix kind over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * _MIX1
        x = (x ^ (x >> U64(27))) * _MIX2
        return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit XXH64 of words, remembered up to ``limit`` distinct ones."""

    def __init__(self, limit: int = 150_000) -> None:
        import xxhash

        super().__init__()
        self.limit, self.hash = limit, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        x = self[word] = self.hash(word)
        return x

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_BLANK = re.compile(rb"[ \t-\r]")
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.where(_GAP, U64(0), mix(np.arange(256, dtype=U64), 77))
_FACTOR = 0x9E3779B97F4A7C15


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, U64(factor & 0xFFFFFFFFFFFFFFFF))
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


_NEAR = _powers(_FACTOR, 1 << 12)


def _hashed_words(text: bytes, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where words begin, their hashes), in pieces of about ``piece`` bytes that end between words."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + piece)
        end = cut.start() if cut else len(text)
        a, begin = np.frombuffer(text, np.uint8, end - at, at), at
        at = end
        gap = _GAP[a]
        first = ~gap
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        a, begin = a[starts[0] :], begin + starts[0]
        starts = starts - starts[0]
        sizes = np.diff(np.append(starts, len(a)))
        place = np.arange(len(a)) - np.repeat(starts, sizes)
        top = int(sizes.max()) >> 12
        power = _NEAR[place & 0xFFF] * _powers(pow(_FACTOR, 1 << 12, 1 << 64), top + 1)[place >> 12] if top else _NEAR[place]
        yield begin + starts, mix(np.add.reduceat(_BYTE[a] * power, starts), 78)


def word_hashes(text: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of ``text.split()``, without making the words: sums of byte values times powers, then mixed.

    Works on pieces of about ``piece`` bytes that end between words.
    """
    out = [h for _, h in _hashed_words(text, piece)]
    return np.concatenate(out) if out else np.zeros(0, U64)


def word_hashes_of_each(texts: list[bytes], piece: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of lower-cased texts, one after the other, and how many each text has."""
    found = list(_hashed_words(b" ".join(texts).lower(), piece))
    starts = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in found)])
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return np.concatenate([np.zeros(0, U64), *(h for _, h in found)]), np.diff(ends, prepend=0)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; a shorter, non-empty text is one shingle."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, U64)
        for i in range(k):
            out = (out ^ words[i : n - k + 1 + i]) * _MIX1
            out ^= out >> U64(29)
    return out


# ---------------------------------------------------------------------------------------------------- labels


def labelled_sample(labels: DataFrame, bound: int, *, where: object | None = None, columns: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """At most ``bound`` labelled rows, those of the smallest hash of doc_id: the same rows on every run and partitioning.

    Null ids and null labels are left out; of rows with one doc_id the least labels count.
    """
    clean = labels.select("doc_id", *columns).dropna()
    if where is not None:
        clean = clean.where(where)
    clean = clean.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    return clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int, **how: object) -> DataFrame:
    """(doc_id, text, labels) of at most ``bound`` labelled documents; of rows that repeat an id the text of the least hash counts."""
    chosen = labelled_sample(labels, bound, **how)
    # the id list has at most ``bound`` rows, so it is sent to all tasks
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", *chosen.columns[1:])).alias("x")
    return joined.groupBy("doc_id").agg(first).select("doc_id", "x.text", *[f"x.{c}" for c in chosen.columns[1:]])


def fold_is(doc_id: object, modulus: int, remainder: int) -> object:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
