"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one aggregate and one join on edge rows, written to the shared folder; the driver only sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import written

FEW, EDGES = 16, 500_000  # tasks that write a step at least, and edges a task


def apart(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a key that the planner takes for another: an aggregate's rows are dealt out anew before a join, which adaptive execution can then split where one key has many partners."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(apart(low, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(apart(low, "u"), "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its least node.  Empty edges give an empty table."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, n = None, now.count()
    for _ in range(max_steps):
        # steps add no edges: a table of few is written by few tasks
        now = written(_small_star(_large_star(now)).coalesce(max(FEW, -(-n // EDGES))), "stars")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            break
        seen, n = (mark["n"], mark["h"]), mark["n"]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
