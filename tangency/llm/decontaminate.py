"""Benchmark decontamination by SimHash over item-sized windows.

Every text is covered by windows of the sizes of the benchmark items.  A window's fingerprint is the majority, bit by bit, of the
64-bit hashes of its five-word shingles; running byte counters give all windows of a size at once.  Sizes go in steps of two to four
shingles and windows slide by as much (``step``) from the start of each text, the last one ending with it, so some window lies within a shingle or two of any item-sized passage; every alignment in between is
tried again at verification, at the item's own size.  Windows whose reach has too few shingles of the benchmark to match any item are not fingerprinted.  Multi-index blocks: a
fingerprint within ``RADIUS`` bits of an item's agrees with it up to ``RADIUS // 8`` bits in one of eight 8-bit blocks, so one table of 256
entries per block, with the items within that many bits of each value as bits, yields all items in the radius; the distance decides.
Candidates are verified exactly: the weighted Jaccard similarity (multisets of shingles) of the item and an item-sized window is 0.8 or more.

The benchmark is a stated set and goes to all tasks, in parts of at most ``ITEM_BYTES`` bytes (some hundred bytes of index an item); a benchmark within that
takes one scan of the texts, a larger one a scan for each part.

Nulls: a null text is empty; an empty item matches nothing; null ids are reported as null.  A text or item under five words is one shingle.
Items with equal texts are each reported.  Texts shorter than an item by over a fifth cannot match it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import U64, map_arrow, mix, rows, shingle_hashes, slices, texts_of, word_hashes

SHINGLE = 5
SIMILAR = 0.8
CHUNK = 8192  # shingles of several texts looked at together
RADIUS = 18
BLOCKS = 8
BLOCK_RADIUS = RADIUS // BLOCKS
ALIGN = 12  # texts looked at together begin at multiples of this, a multiple of every step
ITEM_BYTES = 32 << 20
PAIRS = 8 << 20  # windows times items that are compared at once
_NEAR = np.array([[(v ^ w).bit_count() <= BLOCK_RADIUS for w in range(256)] for v in range(256)])


def lanes(h: np.ndarray) -> np.ndarray:
    """Each 64-bit hash as 64 bytes of 0 or 1."""
    return np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(len(h), 64)


def step(size: int) -> int:
    """By how much sizes of this order differ and their windows slide."""
    return 2 if size < 20 else 3 if size < 28 else 4


def window_prints(running: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of the windows of ``size`` shingles at ``starts``; ``running`` are counts before each shingle.

    Counters wrap around, so their type holds ``size``.
    """
    counts = running[starts + size] - running[starts]
    return np.packbits(counts > size // 2, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """Benchmark items of one part, by class of size."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids, self.words = [], []
        for i, t in items:
            s = shingle_hashes(word_hashes(t.lower()), SHINGLE)
            if len(s):
                self.ids.append(i)
                self.words.append(s)
        self.all = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, U64)
        by: dict[int, list[int]] = {}
        for n, s in enumerate(self.words):
            k = step(len(s))
            by.setdefault(max(len(s) // k * k, min(len(s), k)), []).append(n)
        self.classes = [(size, members, self._index(members)) for size, members in sorted(by.items())]

    def _index(self, members: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Prints of the items, and per block the items near each value as bits."""
        prints = np.array([self.print_of(self.words[m]) for m in members], dtype="<u8")
        values = prints.view(np.uint8).reshape(-1, BLOCKS)
        return prints, [np.packbits(_NEAR[:, values[:, b]], axis=1, bitorder="little") for b in range(BLOCKS)]

    @staticmethod
    def print_of(s: np.ndarray) -> int:
        bits = lanes(mix(s, 3)).sum(axis=0, dtype=np.int64) > len(s) // 2
        return int(np.packbits(bits, bitorder="little").view("<u8")[0])

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, item, start) of windows whose print is in the radius and whose shared shingles can suffice."""
        found: list[tuple[int, int, int]] = []
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if not lengths.sum() or not self.classes:
            return found
        room = -(-lengths // ALIGN) * ALIGN
        begins = np.cumsum(room) - room
        n = int(room.sum())
        shingles, owner = np.zeros(n, U64), np.full(n, -1)
        for t, (at, of) in enumerate(zip(begins.tolist(), texts, strict=True)):
            shingles[at : at + len(of)] = of
            owner[at : at + len(of)] = t
        place = np.minimum(np.searchsorted(self.all, shingles), len(self.all) - 1)
        shared = np.concatenate(([0], np.cumsum((self.all[place] == shingles) & (owner >= 0))))
        whole = shared[begins + lengths] - shared[begins]
        running = None
        for size, members, (items, tables) in self.classes:
            k = step(size)
            # a text a little shorter or longer than the item is looked at whole
            for t in np.flatnonzero((lengths < size + 2 * k) & (lengths >= SIMILAR * size) & (whole >= SIMILAR * size)):
                found += [(int(t), m, at) for m in members for at in ((0, k) if lengths[t] > size else (0,))]
            if n < size:
                continue
            # windows at each text's own 0, k, 2k, ..., and the last one
            last = (begins + lengths - size)[(lengths >= size) & ((lengths - size) % k != 0)]
            starts = np.concatenate((np.arange(0, n - size + 1, k), last))
            # all shingles that the benchmark shares in reach of the window, which lies in one text
            able = shared[np.minimum(starts + size + 2 * k, n)] - shared[np.maximum(starts - k, 0)] >= SIMILAR * size
            able &= (owner[starts] == owner[starts + size - 1]) & (owner[starts] >= 0)
            starts = starts[able]
            if not len(starts):
                continue
            if running is None:
                kind = np.uint8 if self.classes[-1][0] < 256 else np.uint32
                running = np.zeros((n + 1, 64), kind)
                np.cumsum(lanes(mix(shingles, 3)), axis=0, dtype=kind, out=running[1:])
            together = max(1, PAIRS // len(members))
            for s in range(0, len(starts), together):
                at = starts[s : s + together]
                prints = window_prints(running, at, size)
                values = prints.view(np.uint8).reshape(-1, BLOCKS)
                hit = tables[0][values[:, 0]]
                for b in range(1, BLOCKS):
                    hit |= tables[b][values[:, b]]
                w, i = np.nonzero(np.unpackbits(hit, axis=1, count=len(members), bitorder="little"))
                close = np.bitwise_count(prints[w] ^ items[i]) <= RADIUS
                found += [(int(owner[at[x]]), members[y], int(at[x] - begins[owner[at[x]]])) for x, y in zip(w[close], i[close], strict=True)]
        return found

    def matches(self, texts: list[np.ndarray]) -> dict[int, list[tuple[int, int, int, float]]]:
        """By text: (item id, first word, words, similarity) of the best verified window of each item."""
        near: dict[tuple[int, int], set[int]] = {}
        for text, item, start in self.candidates(texts):
            k = step(len(self.words[item]))
            near.setdefault((text, item), set()).update(range(max(0, start - k), start + k + 1))
        out: dict[int, list[tuple[int, int, int, float]]] = {}
        for (text, item), starts in sorted(near.items()):
            bag, size, best = Counter(self.words[item].tolist()), len(self.words[item]), None
            for s in sorted(starts):
                window = texts[text][s : s + size]
                if len(window) < SIMILAR * size:
                    continue
                seen = Counter(window.tolist())
                both = sum(min(c, seen[x]) for x, c in bag.items())
                similar = both / (size + len(window) - both)
                if similar >= SIMILAR and (best is None or similar > best[0]):
                    best = (similar, s, len(window))
            if best:
                out.setdefault(text, []).append((self.ids[item], best[1], best[2] + SHINGLE - 1, best[0]))
        return out


class Scanner:
    """Looks texts through for a part of the items, several short texts or a piece of a long one at a time."""

    def __init__(self, block: list[tuple[int, bytes]]) -> None:
        self.items = Items(block)
        self.overlap = max((len(w) for w in self.items.words), default=0) + 8

    def __call__(self, texts: list[bytes]) -> list[dict]:
        """For each text its best window of each item: {item id: (first word, words, similarity)}."""
        found: list[dict] = [{} for _ in texts]
        pieces: list[np.ndarray] = []
        whose: list[tuple[int, int]] = []

        def flush() -> None:
            for piece, hits in self.items.matches(pieces).items():
                text, at = whose[piece]
                for item, start, n, v in hits:
                    if item not in found[text] or v > found[text][item][2]:
                        found[text][item] = (at + start, n, v)
            pieces.clear()
            whose.clear()

        held = 0
        for i, t in enumerate(texts):
            s = shingle_hashes(word_hashes(t.lower()), SHINGLE)
            for at in range(0, len(s), CHUNK):
                pieces.append(s[at : at + CHUNK + self.overlap])
                whose.append((i, at))
                held += len(pieces[-1])
                if held >= CHUNK:
                    flush()
                    held = 0
        if pieces:
            flush()
        return found


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark in parts of bounded size, read one at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).orderBy(id_col, text_col).toLocalIterator():
        t = (r[1] or "").encode()
        if held and size + len(t) > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append((r[0], t))
        size += len(t)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each item in each text that has one."""
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
    ddl = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    found = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most ITEM_BYTES bytes

        def run(batches, shared=shared):
            scanner = Scanner(shared.value)
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                hits = [(d, item, *best) for d, of in zip(ids, scanner(texts_of(batch)), strict=True) for item, best in of.items()]
                if hits:
                    yield rows(out, *map(list, zip(*hits, strict=True)))

        one = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ddl)
        found = one if found is None else found.union(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], ddl)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the texts that hold a benchmark passage; columns as they were."""
    left = docs
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most ITEM_BYTES bytes

        def run(batches, shared=shared):
            scanner = Scanner(shared.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not of for of in scanner(texts_of(batch))], pa.bool_()))

        left = map_arrow(left, run, docs.schema)
    return left
