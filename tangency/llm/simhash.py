"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into seven blocks.  Two fingerprints that differ in at most four bits agree in at least three whole
blocks, so every such pair meets in one of the 35 buckets keyed by three blocks; buckets verify the Hamming distance.  Equal
fingerprints are one row from the start, and a bucket emits a spanning forest, never all its pairs.  A bucket of over ``LARGE`` fingerprints is split again by the bits outside its key.

Nulls: a null text is empty; a null id stays in the result and never becomes a component id.  Empty texts have fingerprint zero and
link like any other.  Repeated rows come back repeated.  Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import U64, free_name, map_arrow, mix, partitions, rows, texts_of, written
from tangency.llm.graph import apart, connected_components

BLOCKS = (10, 9, 9, 9, 9, 9, 9)
RADIUS = 4
LARGE = 2048  # fingerprints of a bucket that are compared at once
SHARED = len(BLOCKS) - RADIUS


def _masks() -> list[np.uint64]:
    starts = [0, *accumulate(BLOCKS)]
    block = [((1 << w) - 1) << s for w, s in zip(BLOCKS, starts, strict=False)]
    return [U64(sum(block[i] for i in c)) for c in combinations(range(len(BLOCKS)), SHARED)]


MASKS = _masks()


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").view(U64).reshape(n, 8)
    # eight counters to a 64-bit lane hold up to 255 rows each
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, k: int = 4) -> int:
    """SimHash of the XXH64 (seed 42) of the ``k``-word shingles of a text, A-Z lower-cased."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        return digest(joined, 42)
    ends = list(accumulate(map(len, words)))
    starts = [0, *(e + i + 1 for i, e in enumerate(ends))]
    return majority_bits(np.array([digest(joined[starts[i] : ends[i + k - 1] + i + k - 1], 42) for i in range(n - k + 1)], dtype=U64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, k) for t in texts_of(batch)], dtype=U64).view(np.int64)
            yield rows(out, batch.column(0), fps)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges from each fingerprint to the least of its linked group.  What is found leaves the search, so a dense group costs little."""
    edges, rest = [], fps
    while len(rest) > 1:
        group, front, rest = [rest[0]], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found = list(rest[near])
                group += found
                front += found
                rest = rest[~near]
        if len(group) > 1:
            low = min(group)
            edges += [(x, low) for x in group if x != low]
    return edges


def linked(fps: np.ndarray, mask: np.uint64, radius: int = RADIUS) -> list[tuple[int, int]]:
    """``forest`` of a bucket.  A large one is split again: of ``radius`` + 1 parts of the bits outside ``mask``, two linked fingerprints share one."""
    if len(fps) <= LARGE:
        return forest(fps, radius)
    rest = [b for b in range(64) if not int(mask) >> b & 1]
    edges: list[tuple[int, int]] = []
    for part in range(radius + 1):
        own = U64(sum(1 << b for b in rest[part :: radius + 1]))
        keys = fps & own
        order = np.argsort(keys, kind="stable")
        mine, keys = fps[order], keys[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s > 1:
                edges += forest(mine[s:e], radius)
    return edges


def bucket_edges(fps: np.ndarray, masks: list[np.uint64] | None = None, picks: list[np.ndarray] | None = None, radius: int = RADIUS) -> np.ndarray:
    """Forest edges of all buckets; ``picks[i]`` are the fingerprints dealt to this task under mask i."""
    edges: list[tuple[int, int]] = []
    pairs: list[np.ndarray] = []
    for i, mask in enumerate(masks or MASKS):
        mine = fps if picks is None else picks[i]
        if len(mine) < 2:
            continue
        keys = mine & mask
        order = np.argsort(keys, kind="stable")
        mine, keys = mine[order], keys[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(cuts)
        two = cuts[:-1][size == 2]
        close = two[np.bitwise_count(mine[two] ^ mine[two + 1]) <= radius]
        if len(close):
            pairs.append(np.stack([np.maximum(mine[close], mine[close + 1]), np.minimum(mine[close], mine[close + 1])], axis=1))
        for s, m in zip(cuts[:-1][size > 2], size[size > 2], strict=True):
            edges += linked(mine[s : s + m], mask, radius)
    if edges:
        pairs.append(np.array(edges, dtype=U64))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), U64)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprint pairs within ``radius`` bits.  ``fps``: distinct fp."""
    if radius > RADIUS:
        raise ValueError(f"the blocks guarantee pairs up to {RADIUS} bits")
    n = partitions(fps.sparkSession)
    packed = pa.schema([("bucket", pa.int32()), ("mask", pa.int32()), ("fps", pa.binary())])

    def deal(batches):
        for batch in batches:
            mine = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for i, mask in enumerate(MASKS):
                to = (mix(mine & mask, i) % U64(n)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0, [True])))
                sorted_fps = mine[order]
                if len(mine):
                    yield rows(packed, to[order][cuts[:-1]].astype(np.int32), np.full(len(cuts) - 1, i, np.int32), [sorted_fps[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    ends = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches):
        picks: list[list[np.ndarray]] = [[] for _ in MASKS]
        for batch in batches:
            for i, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                picks[i].append(np.frombuffer(x, U64))
        edges = bucket_edges(np.zeros(0, U64), MASKS, [np.concatenate(p) if p else np.zeros(0, U64) for p in picks], radius).view(np.int64)
        for s in range(0, len(edges), 100_000):
            yield rows(ends, edges[s : s + 100_000, 0], edges[s : s + 100_000, 1])

    dealt = map_arrow(fps.select("fp"), deal, "bucket int, mask int, fps binary")
    return map_arrow(dealt.repartition(n, "bucket"), meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the least id reachable over links, null if there is none."""
    prints = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "classes")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(apart(firsts, "root"), "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that of the least id.  Rows that repeat an id count once; rows without an id stay."""
    groups = written(near_duplicates(docs, id_col, text_col, k), "groups")
    key = free_name(docs, "kept_id")
    keep = groups.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n_rows"))
    single, several = keep.where("n_rows = 1").select(key), keep.where("n_rows > 1").select(key)
    once = docs.join(single, F.col(id_col) == F.col(key), "left_semi")
    if not several.isEmpty():
        once = once.union(docs.join(several, F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col]))
    return once if groups.where("doc_id is null").isEmpty() else once.union(docs.where(F.col(id_col).isNull()))
