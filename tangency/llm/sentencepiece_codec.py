"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are cut into marked words (each starts with its run of U+2581, the mark of a space).  The distinct words of a batch are sorted,
which lays them out as a trie, and walked depth-first: forward states belong to prefixes, so words with a common prefix compute
its states once and only the new characters of the next word are added.  A state is its last piece and where that begins; ids are
read back from the end of a word, so memory is linear in the longest word.

The recurrence at a prefix depends on the vocabulary's kind.  For a unigram vocabulary it is Viterbi's: the best score of a last piece plus
the state before it.  A byte-pair vocabulary (such as the 32k one) is not a maximum of score sums: there the state of a prefix is its
one byte-pair segmentation, and its last piece is the only one that merges would also leave next to the piece before (``compatible``).
So the same pass gives exactly the ids that byte-pair merging gives.  Pieces of marks alone have equal ranks in such vocabularies, which the pass cannot
tell apart; words that begin with several marks are merged by definition, with a heap.

Characters outside the vocabulary, and U+2581 itself in a text, become byte pieces; decoding restores every text exactly.  The model file is
read on the driver and sent to tasks (a vocabulary, ``MODEL_BYTES`` at most).

Nulls: a null text is empty; an empty text has no ids.  Repeated rows are encoded each.  Words of any length are handled.
"""

from __future__ import annotations

import copy
import gc
import re
import struct
from array import array
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import map_arrow, rows, slices

MARK = "▁"
MODEL_BYTES = 64 << 20
UNKNOWN_PENALTY = 10.0  # fixed value: by how much an unknown character scores below the worst piece
HELD_CHARS = 16 << 20  # of words whose ids are kept
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << s
        if c < 128:
            return x, i
        s += 7


def _fields(b: bytes) -> Iterable[tuple[int, int | bytes]]:
    """Protocol buffer fields of a message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Vocabulary:
    """Pieces, scores and kind of a SentencePiece model file."""

    def __init__(self, model: bytes) -> None:
        if len(model) > MODEL_BYTES:
            raise ValueError(f"a model of over {MODEL_BYTES} bytes")
        self.pieces, self.scores, self.kinds, self.bpe = [], [], [], False
        for field, value in _fields(model):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 2:
                self.bpe = any(f == 3 and v == 2 for f, v in _fields(value))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == 6}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.spelled = [bytes([byte_of[i]]) if i in byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        if len(self.bytes) != 256:
            raise ValueError("byte pieces are needed for texts to come back exactly")
        self.longest = max(map(len, self.ids), default=1)
        own = [self.scores[i] for i, k in enumerate(self.kinds) if k == 1]
        self.unknown = min(own, default=0.0) - UNKNOWN_PENALTY
        # a piece that a user defined is taken before any other of its length
        self.value = {i: self.scores[i] if self.kinds[i] == 1 else len(p.encode()) * max(own, default=0.0) - 0.1 for p, i in self.ids.items()}


class Encoder:
    """Ids of marked words; what is known of words and of pairs of pieces is kept up to a bound."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 600_000) -> None:
        self.v, self.limit = vocabulary, limit
        self.words: dict[str, bytes] = {}  # ids of 32 bits
        self.held = 0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.stand_in = MARK
        self.usable = self.tails = None
        if vocabulary.bpe:
            # pieces of two characters or more that merging makes of their own characters, and the longest by last three
            self.usable = {p: p for p in vocabulary.ids if len(p) > 1 and self.merged(p) == [p]}
            self.tails = {}
            for p in self.usable:
                if len(p) > 2:
                    self.tails[p[-3:]] = max(len(p), self.tails.get(p[-3:], 3))

    def merged(self, word: str) -> list[str]:
        """Byte-pair merging by definition: the best adjacent pair first, the leftmost of equals."""
        ids, scores, n = self.v.ids, self.v.scores, len(word)
        ends = list(range(1, n + 1))  # of the part that begins here, 0 for none
        begins = list(range(-1, n))  # of the part that ends here
        heap = []
        for i in range(n - 1):
            k = ids.get(word[i : i + 2])
            if k is not None:
                heap.append((-scores[k], i, i + 1, i + 2))
        heapify(heap)
        while heap:
            _, i, j, e = heappop(heap)
            if ends[i] != j or ends[j] != e:
                continue
            ends[i], ends[j], begins[e] = e, 0, i
            if i:
                k = ids.get(word[begins[i] : e])
                if k is not None:
                    heappush(heap, (-scores[k], begins[i], i, e))
            if e < n:
                k = ids.get(word[i : ends[e]])
                if k is not None:
                    heappush(heap, (-scores[k], i, e, ends[e]))
        return [word[i:e] for i, e in enumerate(ends) if e]

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def _grow_bpe(self, word: str, common: int, last: list[str], starts: array) -> None:
        """Adds the states (last piece, its start) of the prefixes of ``word`` longer than ``common``."""
        usable, tails, pairs = self.usable, self.tails, self.pairs
        for end in range(common + 1, len(word) + 1):
            # pieces of three characters or more that end as this prefix does are no longer than this
            start = end - tails.get(word[end - 3 : end], 2) if end > 2 else 0
            if start < 0:
                start = 0
            while start < end - 1:
                piece = word[start:end]
                if piece in usable:
                    if not start:
                        piece = usable[piece]  # one string for all states
                        break
                    fits = pairs.get((last[start], piece))
                    if fits is None:
                        fits = self.compatible(last[start], piece)
                    if fits:
                        piece = usable[piece]
                        break
                start += 1
            else:
                start = end - 1
                piece = word[start]
            last.append(piece)
            starts.append(start)

    def _grow_unigram(self, word: str, common: int, last: list[str], starts: array) -> None:
        """The same by Viterbi's recurrence, with the best score of each prefix."""
        ids, value, longest, best = self.v.ids, self.v.value, self.v.longest, self.best
        del best[common + 1 :]
        for end in range(common + 1, len(word) + 1):
            top, at = best[end - 1] + self.v.unknown, end - 1  # an unknown character, by its bytes
            for start in range(max(0, end - longest), end):
                k = ids.get(word[start:end])
                if k is not None and best[start] + value[k] > top:
                    top, at = best[start] + value[k], start
            best.append(top)
            last.append(word[at:end])
            starts.append(at)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        k = self.v.ids.get(piece)
        return (k,) if k is not None else tuple(self.v.bytes[b] for b in piece.replace(self.stand_in, MARK).encode("utf-8", "surrogatepass"))

    def _ids(self, last: list[str], starts: array, end: int) -> bytes:
        """Ids of the prefix of length ``end``, read back from its state."""
        back = []
        while end:
            back.append(last[end])
            end = starts[end]
        return self._of(reversed(back))

    def _of(self, pieces: Iterable[str]) -> bytes:
        out: list[bytes] = []
        for p in pieces:
            own = self.ids_of.get(p)
            if own is None:
                own = self.ids_of[p] = array("i", self.piece_ids(p)).tobytes()
            out.append(own)
        return b"".join(out)

    def learn(self, distinct: Iterable[str]) -> None:
        """Encodes words in sorted order, a depth-first walk of their trie: states of the common prefix stay on the stack."""
        before, last, starts, self.best = "", [""], array("i", [0]), [0.0]
        grow, words = self._grow_bpe if self.v.bpe else self._grow_unigram, self.words
        if len(self.ids_of) > self.limit:
            self.ids_of.clear()
        for word in sorted(distinct):
            self.held += len(word)
            if self.v.bpe and word.startswith(MARK * 2):
                words[word] = self._of(self.merged(word))
                continue
            common, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                common = most
            else:
                while before[common] == word[common]:
                    common += 1
            del last[common + 1 :], starts[common + 1 :]
            grow(word, common, last, starts)
            before = word
            words[word] = self._ids(last, starts, len(word))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [memoryview(x).cast("i").tolist() for x in self.coded(texts)]

    def coded(self, texts: list[str]) -> Iterable[bytes]:
        """The ids of each text, 32 bits each.  Texts are cut into words twice, so that only different words are held together."""
        fresh: set[str] = set()
        for t in texts:
            if MARK not in t:
                fresh.update(marked_words(t))
        if len(self.words) > self.limit or self.held > HELD_CHARS:
            self.words.clear()
            self.held = 0
        known = self.words
        fresh.difference_update(known)
        self.learn(fresh)
        del fresh
        for t in texts:
            yield self._with_marks(t) if MARK in t else b"".join(map(known.__getitem__, marked_words(t)))

    def _with_marks(self, text: str) -> bytes:
        """A text that has U+2581 itself: a character that it does not have stands for it, outside every vocabulary piece."""
        own = copy.copy(self)
        own.words, own.ids_of, own.pairs = {}, {}, {}
        own.stand_in = next(c for c in map(chr, range(0x10FFFF, 0xE000, -1)) if c not in text and c not in self.v.ids)
        words = marked_words(text, own.stand_in)
        own.learn(set(words))
        return b"".join(map(own.words.__getitem__, words))


def marked_words(text: str, stand_in: str = MARK) -> list[str]:
    return _WORDS.findall(MARK + text.replace(MARK, stand_in).replace(" ", MARK)) if text else []


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    out = b"".join(map(vocabulary.spelled.__getitem__, ids))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")


def read_model(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, exact): the ids of each whole text and whether decoding them gives it back."""
    vocabulary = read_model(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # MODEL_BYTES at most
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("exact", pa.bool_())])

    def run(batches):
        encoder = Encoder(shared.value)
        gc.disable()  # hundreds of thousands of words live long and have no cycles
        try:
            for part in slices(batches, 2000):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = list(encoder.coded(texts))
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
                yield rows(out, part.column(0), lists, sizes, [decode(encoder.v, memoryview(x).cast("i")) == t for x, t in zip(ids, texts, strict=True)])
        finally:
            gc.enable()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>, n_ids long, exact boolean")
