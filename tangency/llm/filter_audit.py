"""What each of several filters removes, in every order in which they can be applied.

Verdicts (one row a document: its part, whether it fails each filter, its labels) are computed once and written.  The trie of orders is walked depth first: a state is
the set of filters applied so far, whatever their order, so each of the 2^n states is visited once; its survivors are a DataFrame of their own, made from the
parent's survivors by one filter, persisted while its subtree is walked and given back then.  One aggregation over a state's survivors counts what each filter
not yet applied removes from them: the edges that leave the state.  Counts are written edge by edge; nothing but the walk is on the driver.  A lost
executor costs at most n filters over the written verdicts.

Nulls: a null text is the empty text, a null part the part ''.  A document with a null id has no labels and is nobody's copy.  Rows of one id are documents each; none is the
other's copy, and a label counts if any of the id's rows has it.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.durable import new_path
from tangency.llm.common import map_arrow, slices, texts_of, written

FILTERS = "ABCDE"
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def judged(text: bytes) -> tuple[int, int, int]:
    """(words, distinct words, failed: A 1, B 2, C 4, D 8)."""
    words = text.split()
    n, m = len(words), len(set(words))
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _INNER)))
    upper = len(text) - len(text.translate(None, _UPPER))
    return n, m, (n < 200) + 2 * (100 * m < 50 * n) + 4 * (100 * upper > 3 * points) + 8 * (len(text.translate(None, _MARKS)) < len(text))


def looked_at(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed: bits of A-D, h1, h2: 128-bit hash of the text) of each row."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            texts = texts_of(batch)
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), "<i8").reshape(-1, 2)
            failed = pa.array([judged(t)[2] for t in texts], pa.int32())
            part = batch.column(batch.schema.get_field_index("part"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), part, failed, pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "part", "failed", "h1", "h2"])

    wanted = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return map_arrow(wanted, run, f"doc_id {kinds['doc_id']}, part string, failed int, h1 long, h2 long")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E: fails the filter?, good, toxic) of each row of ``docs``, written.

    The least id of each repeated text and the labels of each id are combined before their shuffles; joins are of narrow rows, one partner each.
    """
    seen = written(looked_at(docs), "looked-at")
    first = seen.where(F.col("doc_id").isNotNull()).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # a table of its own: each side of the join is a plain shuffle then, which Spark can split at a text that many documents repeat
    first = written(first.where(F.col("first_id") < F.col("last_id")).drop("last_id"), "repeated-texts")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where((F.coalesce(F.col("good"), F.lit(0)) + F.coalesce(F.col("toxic"), F.lit(0))) > 0)
    all_ = seen.join(first, ["h1", "h2"], "left").join(marks, "doc_id", "left")
    bits = [F.col("failed").bitwiseAND(1 << k) != 0 for k in range(4)] + [F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))]
    return written(all_.select("part", *[b.alias(f) for f, b in zip(FILTERS, bits, strict=True)], *[(F.coalesce(F.col(c), F.lit(0)) == 1).alias(c) for c in ("good", "toxic")]), "verdicts")


EDGES = "part string, state int, filter string, kept long, removed long, good_lost long, toxic_lost long"


def edges(judged_rows: DataFrame, names: str) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost): an edge of the trie for each part that has survivors; ``state``: bits of the filters applied before."""
    spark = judged_rows.sparkSession
    path = new_path(spark, "edges")
    done: set[int] = set()

    def counted(survivors: DataFrame, state: int, left: list[int]) -> DataFrame:
        sums = []
        for k in left:
            f = names[k]
            sums += [F.count_if(~F.col(f)).alias(f"kept_{f}"), F.count_if(f).alias(f"removed_{f}"), *[F.count_if(F.col(f) & F.col(c)).alias(f"{c}_{f}") for c in ("good", "toxic")]]
        one = survivors.groupBy("part").agg(*sums)
        each = [F.struct(F.lit(names[k]).alias("filter"), *[F.col(f"{c}_{names[k]}").alias(o) for c, o in (("kept", "kept"), ("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]) for k in left]
        return one.select("part", F.lit(state).alias("state"), F.explode(F.array(*each)).alias("e")).select("part", "state", "e.*")

    def walk(survivors: DataFrame, state: int) -> None:
        done.add(state)
        left = [k for k in range(len(names)) if not state >> k & 1]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted(survivors, state, left).write.mode("append").parquet(path)
            for k in left:
                if state | 1 << k not in done:
                    walk(survivors.where(~F.col(names[k])).drop(names[k]), state | 1 << k)
        finally:
            survivors.unpersist()

    walk(judged_rows, 0)
    return spark.read.schema(EDGES).parquet(path)


def orders(names: str) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, state before it) of each step of each order: n * n! rows for each part, so n is at most seven."""
    if len(names) > 7:
        raise ValueError("at most seven filters: their orders are all listed")
    out = []
    for order in itertools.permutations(range(len(names))):
        state = 0
        for i, k in enumerate(order):
            out.append(("".join(names[j] for j in order), i + 1, names[k], state))
            state |= 1 << k
    return out


def audited(judged_rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part, order and step.

    ``judged_rows``: (part, a boolean column for each letter of ``names``, good, toxic).
    """
    spark, n = judged_rows.sparkSession, len(names)
    edge = edges(judged_rows, names)
    every = (1 << n) - 1
    bit = F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(1 << k))])
    share = F.create_map(*[F.lit(x) for s in range(n) for x in (s, math.factorial(s) * math.factorial(n - 1 - s))])
    whole = edge.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("state") + bit[F.col("filter")] == every, F.col("removed")).otherwise(0)).alias("unique_fails"),
        # a state of s filters comes before a filter in s! (n - 1 - s)! of the orders
        F.sum(F.col("removed") * share[F.bit_count("state")]).cast("long").alias("shapley"),
    )
    steps = spark.createDataFrame(orders(names), "filter_order string, step int, filter string, state int")
    # n * n! rows at most: a product of parts and orders is the result itself
    grid = whole.join(F.broadcast(steps), "filter")
    out = grid.join(edge, ["part", "filter", "state"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("part", "filter_order", "step", "filter", zero("kept"), zero("removed"), (F.col("fails") - F.coalesce(F.col("removed"), F.lit(0))).alias("redundant"), "unique_fails", zero("good_lost"), zero("toxic_lost"), "shapley")
