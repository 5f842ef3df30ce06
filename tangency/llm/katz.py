"""Katz backoff language model over words, with Good-Turing discounts and exactly normalised backoff weights.

    P(w | h) = d(c(h,w)) c(h,w) / c(h)          if c(h,w) > 0
             = alpha(h) P(w)                    else
    P(w)     = d(u(w)) u(w) / N                 if u(w) > 0,   the rest of the mass for the one unknown word

evaluated recursively for each token, end of text included; the first word's history is a begin mark.  For each history the weight is
alpha(h) = (1 - sum of discounted seen) / (1 - sum of P(w) over seen w), so that every P(. | h) sums to one over the known words
and the unknown one.  A history that discounting leaves no mass (all counts over five) gets one more pseudo-count for the backoff.

How it runs.  Documents are packed into groups of about ``GROUP`` tokens with a vocabulary of their own, a table.  A group sends each
distinct word (then each distinct bigram) once to the hash bucket that owns it, buckets add up the counts of all groups, and write to
a table, partitioned by kind, what each group asked for.  Groups then evaluate all their tokens.  Both shuffles carry distinct
n-grams of a group, never tokens.  A bigram goes to the bucket of its history; histories with more than 1/(8 buckets) of all tokens are
dealt out by the whole bigram and their sums (at most 8 x buckets rows) are added up afterwards and sent to all tasks.

Words are numbered in 32 bits; more than 4.29 billion different ones are an error, never a wrapped number.

Nulls: a null text is empty and has one token, the end.  A null id counts as the empty text for the fold.  Repeated rows are scored
and learnt from each.  Without any training token every text has probability one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import U64, fold_is, map_arrow, mix, partitions, rows, slices, texts_of, written

GROUP = 2_000_000
SPREAD = 3  # buckets to a shuffle partition: a task holds few
DISCOUNTED = 5
END, BEGIN = b"\n", b" "
BEGIN_ID = np.uint32(0xFFFFFFFF)


def pack(a: np.ndarray) -> bytes:
    """Byte planes, then zstd: small numbers in wide types take little."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""


def unpack(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a[:1] * 0)


# ------------------------------------------------------------------------------------------------------- groups


GROUPS = pa.schema([("group", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("vocab", pa.binary()), ("seen", pa.binary())])


def pack_groups(docs: DataFrame, modulus: int = 7, remainder: int = 2, size: int = GROUP) -> DataFrame:
    """Documents as token groups; ``seen`` has the training count of each word of ``vocab``."""

    def run(batches):
        import xxhash

        part, number = TaskContext.get().partitionId(), 0

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            words[END]
            return words, [], [], [], [], 0

        words, ids, train, lengths, tokens, n = fresh()

        def close():
            flat, size_ = np.concatenate(tokens), np.array(lengths, np.int32)
            learnt = flat[np.repeat(np.array(train), size_)]
            vocab = np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))
            return rows(GROUPS, [part << 32 | number], [ids], [train], [pack(size_)], [pack(flat)], [vocab.tobytes()], [pack(np.bincount(learnt, minlength=len(words)).astype(np.uint32))])

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                mine = [words[w] for w in t.lower().split()]
                mine.append(0)
                ids.append(i)
                train.append(zlib.crc32(b"" if i is None else str(i).encode()) % modulus != remainder)
                lengths.append(len(mine))
                tokens.append(np.array(mine, np.uint32))
                n += len(mine)
                if n >= size:
                    yield close()
                    number += 1
                    words, ids, train, lengths, tokens, n = fresh()
        if ids:
            yield close()

    ddl = "group long, doc_ids array<long>, train array<boolean>, lengths binary, tokens binary, vocab binary, seen binary"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ddl)


# ------------------------------------------------------------------------------------------------------ unigrams

ASK = pa.schema([("bucket", pa.int32()), ("group", pa.int64()), ("payload", pa.list_(pa.binary()))])
REPLY = pa.schema([("kind", pa.string()), ("group", pa.int64()), ("bucket", pa.int32()), ("payload", pa.list_(pa.binary())), ("h", pa.int64()), ("sums", pa.list_(pa.float64()))])
ASK_DDL = "bucket int, group long, payload array<binary>"
REPLY_DDL = "kind string, group long, bucket int, payload array<binary>, h long, sums array<double>"


def by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the buckets in it and where each begins."""
    order = np.argsort(buckets, kind="stable")
    in_order = buckets[order]
    cuts = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1], [True])))
    return order, in_order[cuts[:-1]], cuts


def word_buckets(vocab: np.ndarray, n: int) -> np.ndarray:
    return (mix(vocab, 1) % U64(n)).astype(np.int64)


def count_of_counts(c: np.ndarray) -> list[float]:
    return [float(x) for x in np.bincount(c[(c > 0) & (c <= DISCOUNTED + 1)].astype(np.int64), minlength=DISCOUNTED + 2)[1:]]


def count_words(groups: DataFrame, n: int) -> DataFrame:
    """Replies with (number, training count) of each word of a group, and sums (N, V, N_1 .. N_6) of each bucket."""

    def ask(batches):
        for batch in batches:
            for g, vocab, seen in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                v, c = np.frombuffer(vocab, U64), unpack(seen, np.uint32)
                order, which, cuts = by_bucket(word_buckets(v, n))
                yield rows(ASK, which.astype(np.int32), [g] * len(which), [[v[order[a:b]].tobytes(), pack(c[order[a:b]])] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def answer(batches):
        held = defaultdict(list)
        for batch in batches:
            for b, g, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held[b].append((g, np.frombuffer(p[0], U64), unpack(p[1], np.uint32)))
        for b, asked in held.items():
            keys = np.concatenate([k for _, k, _ in asked])
            distinct, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([c for _, _, c in asked]), minlength=len(distinct)).astype(np.uint64)
            yield rows(REPLY, ["sums"], [-1], [b], [[]], [None], [[float(total.sum()), float((total > 0).sum()), *count_of_counts(total)]])
            if len(distinct) * n + b >= int(BEGIN_ID):
                raise OverflowError("numbers of words have 32 bits: over 4.29 billion different words, raise the fold or cut the vocabulary")
            start = 0
            for g, k, _ in asked:
                mine = at[start : start + len(k)]
                start += len(k)
                yield rows(REPLY, ["words"], [g], [b], [[pack((mine * n + b).astype(np.uint32)), pack(total[mine])]], [None], [None])

    asked = map_arrow(groups.select("group", "vocab", "seen"), ask, ASK_DDL)
    return written(map_arrow(asked.repartition(n, "bucket"), answer, REPLY_DDL), "katz-words", ["kind"])


# ------------------------------------------------------------------------------------------------------- model


def discounts(counts: list[float]) -> np.ndarray:
    """d(0..5): Katz's Good-Turing discounts, or absolute ones where the counts of counts do not give values in (0, 1)."""
    n = np.array([0.0, *counts])
    k, d = DISCOUNTED, np.ones(DISCOUNTED + 1)
    if (n[1 : k + 2] > 0).all():
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            r = np.arange(1, k + 1)
            d[1:] = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - common) / (1 - common)
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        r = np.arange(1, k + 1)
        d[1:] = (r - off) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = c.astype(float)
    return c * d[np.where(c <= DISCOUNTED, c, 0).astype(np.int64)]


class Unigrams:
    def __init__(self, tokens: float, words: float, counts: list[float]) -> None:
        self.n, self.v, self.d = tokens, words, discounts(counts)
        small = sum(self.d[r] * r * counts[r - 1] for r in range(1, DISCOUNTED + 1))
        large = tokens - sum(r * counts[r - 1] for r in range(1, DISCOUNTED + 1))
        self.over = tokens
        rest = tokens - small - large
        if rest < 1e-9:  # nothing discounted: one pseudo-count
            self.over, rest = tokens + 1, 1.0
        self.unknown = rest / self.over

    def p(self, u: np.ndarray) -> np.ndarray:
        """P(w) of words with training counts ``u``."""
        return np.where(u > 0, discounted(u, self.d) / max(self.over, 1), self.unknown)

    def base(self, u: np.ndarray) -> np.ndarray:
        return np.log10((u.astype(float) + 1) / (self.n + (self.v + 1)))


def backoff(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, divisor of seen counts) from rows (c(h), n_1(h) .. n_5(h), sum of P(w) over seen w)."""
    total = sums[:, 0]
    r = np.arange(1, DISCOUNTED + 1)
    lost = sums[:, 1 : DISCOUNTED + 1] @ ((1 - d[1:]) * r)
    over = np.where(lost < 1e-9, total + 1, total)
    lost = np.where(lost < 1e-9, 1.0, lost)
    alpha = np.where(total > 0, lost / np.maximum(over, 1) / np.maximum(1 - sums[:, DISCOUNTED + 1], 1e-300), 1.0)
    return alpha, np.where(total > 0, over, 1.0)


# ------------------------------------------------------------------------------------------------------ bigrams


class Located:
    """A group's tokens with global word numbers and counts, and its distinct bigrams in the order of their buckets."""

    def __init__(self, row: dict, replies: list[list[bytes]], which: list[int], n: int, uni: Unigrams) -> None:
        self.tokens, self.lengths = unpack(row["tokens"], np.uint32), unpack(row["lengths"], np.int32)
        vocab = np.frombuffer(row["vocab"], U64)
        self.number, self.count = np.zeros(len(vocab) + 1, np.uint32), np.zeros(len(vocab) + 1, np.uint64)
        order, buckets, cuts = by_bucket(word_buckets(vocab, n))
        place = {int(b): i for i, b in enumerate(buckets)}
        for b, p in zip(which, replies, strict=True):
            at = order[cuts[place[b]] : cuts[place[b] + 1]]
            self.number[at], self.count[at] = unpack(p[0], np.uint32), unpack(p[1], np.uint64)
        self.number[-1] = BEGIN_ID
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(vocab)
        local = before.astype(U64) << U64(32) | self.tokens.astype(U64)
        distinct, self.at = np.unique(local, return_inverse=True)
        h, w = (distinct >> U64(32)).astype(np.int64), (distinct & U64(0xFFFFFFFF)).astype(np.int64)
        self.h, self.w, self.u = self.number[h], self.number[w], self.count[w]
        key = self.h.astype(U64) << U64(32) | self.w.astype(U64)
        # the begin mark is as frequent as texts are; it is always dealt out
        self.hot = (self.count[h].astype(float) * 8 * n > max(uni.n, 1)) | (self.h == BEGIN_ID)
        bucket = (np.where(self.hot, mix(key, 2), mix(self.h.astype(U64), 3)) % U64(n)).astype(np.int64)
        self.order = np.lexsort((key, bucket))
        in_order = bucket[self.order]
        self.cuts = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1], [True])))
        self.buckets = in_order[self.cuts[:-1]]


def located(row: dict, n: int, uni: Unigrams, kind: str = "words") -> Located:
    mine = [r for r in row["replies"] if r["kind"] == kind]
    return Located(row, [r["payload"] for r in mine], [r["bucket"] for r in mine], n, uni)


def runs(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))


def count_bigrams(groups: DataFrame, words: DataFrame, n: int, uni: Unigrams) -> DataFrame:
    """Replies with the count of each bigram of a group and the sums of its histories; sums of hot histories and N_1 .. N_6 by bucket."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = located(row, n, uni)
                learnt = np.repeat(np.array(row["train"]), g.lengths)
                c = np.bincount(g.at[learnt], minlength=len(g.h))
                for b, s, e in zip(g.buckets, g.cuts[:-1], g.cuts[1:], strict=True):
                    o = g.order[s:e]
                    h = g.h[o]
                    first = runs(h)
                    payload = [pack(deltas(h[first])), pack(np.diff(np.append(first, len(h))).astype(np.uint32)), pack(deltas(g.w[o])), pack(c[o].astype(np.uint32)), pack(g.u[o]), pack(g.hot[o[first]])]
                    yield rows(ASK, [int(b)], [row["group"]], [payload])

    def answer(batches):
        held = defaultdict(list)
        for batch in batches:
            for b, g, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held[b].append((g, p))
        for b in list(held):
            asked = held.pop(b)
            hs, ws, cs, us, hots, sizes = [], [], [], [], [], []
            for _, p in asked:
                first, length = np.cumsum(unpack(p[0], np.uint32), dtype=np.uint32), unpack(p[1], np.uint32)
                hs.append(np.repeat(first, length))
                ws.append(np.cumsum(unpack(p[2], np.uint32), dtype=np.uint32))
                cs.append(unpack(p[3], np.uint32))
                us.append(unpack(p[4], np.uint64))
                hots.append(np.repeat(unpack(p[5], np.bool_), length))
                sizes.append((first, len(ws[-1]), unpack(p[5], np.bool_)))
            key = np.concatenate(hs).astype(U64) << U64(32) | np.concatenate(ws).astype(U64)
            distinct, first_at, at = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(cs), minlength=len(distinct)).astype(np.uint64)
            known = total > 0
            h, p_w, c, hot = (distinct[known] >> U64(32)).astype(np.uint32), uni.p(np.concatenate(us)[first_at[known]]), total[known], np.concatenate(hots)[first_at[known]]
            cut = runs(h) if len(h) else np.zeros(0, np.int64)
            sums = np.stack([np.add.reduceat(x, cut) for x in (c.astype(float), *((c == r).astype(float) for r in range(1, DISCOUNTED + 1)), p_w)], axis=1) if len(h) else np.zeros((0, DISCOUNTED + 2))
            owner = h[cut]
            yield rows(REPLY, ["sums"], [-1], [b], [[]], [None], [count_of_counts(total)])
            for i in np.flatnonzero(hot[cut]) if len(h) else ():
                yield rows(REPLY, ["hot"], [-1], [b], [[]], [int(owner[i])], [sums[i].tolist()])
            start = 0
            for (g, _), (first, size, is_hot) in zip(asked, sizes, strict=True):
                mine = at[start : start + size]
                start += size
                cold = first[~is_hot]
                place = np.searchsorted(owner, cold)
                found = (place < len(owner)) & (owner[np.minimum(place, max(len(owner) - 1, 0))] == cold) if len(owner) else np.zeros(len(cold), bool)
                s = np.zeros((len(cold), DISCOUNTED + 2))
                s[found] = sums[place[found]]
                yield rows(REPLY, ["bigrams"], [g], [b], [[pack(total[mine]), pack(s[:, : DISCOUNTED + 1].astype(np.uint64).ravel()), pack(s[:, DISCOUNTED + 1]), pack(is_hot)]], [None], [None])

    asked = map_arrow(with_replies(groups, words.where("kind = 'words'")), ask, ASK_DDL)
    return written(map_arrow(asked.repartition(n, "bucket"), answer, REPLY_DDL), "katz-bigrams", ["kind"])


def with_replies(groups: DataFrame, replies: DataFrame) -> DataFrame:
    own = replies.groupBy("group").agg(F.collect_list(F.struct("kind", "bucket", "payload")).alias("replies"))
    return groups.join(own, "group")


# ----------------------------------------------------------------------------------------------------- evaluation


def evaluate(groups: DataFrame, replies: DataFrame, n: int, uni: Unigrams, d: np.ndarray, hot: dict[int, list[float]]) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    hot_ids = np.array(sorted(hot), dtype=np.uint32)
    hot_sums = np.array([hot[h] for h in sorted(hot)]).reshape(-1, DISCOUNTED + 2)
    shared = groups.sparkSession.sparkContext.broadcast((hot_ids, hot_sums))  # 8 x buckets + 1 rows at most

    def run(batches):
        ids, of_hot = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                g = located(row, n, uni)
                told = {r["bucket"]: r["payload"] for r in row["replies"] if r["kind"] == "bigrams"}
                p = np.zeros(len(g.h))
                for b, s, e in zip(g.buckets, g.cuts[:-1], g.cuts[1:], strict=True):
                    o = g.order[s:e]
                    h, reply = g.h[o], told[int(b)]
                    c, is_hot = unpack(reply[0], np.uint64), unpack(reply[3], np.bool_)
                    first = runs(h)
                    sums = np.zeros((len(first), DISCOUNTED + 2))
                    sums[~is_hot, : DISCOUNTED + 1] = unpack(reply[1], np.uint64).reshape(-1, DISCOUNTED + 1)
                    sums[~is_hot, DISCOUNTED + 1] = unpack(reply[2], np.float64)
                    if is_hot.any() and len(ids):
                        mine = h[first][is_hot]
                        at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                        sums[is_hot] = np.where((ids[at] == mine)[:, None], of_hot[at], 0.0)
                    alpha, over = backoff(sums, d)
                    length = np.diff(np.append(first, len(h)))
                    p[o] = np.where(c > 0, discounted(c, d) / np.repeat(over, length), np.repeat(alpha, length) * uni.p(g.u[o]))
                token_p = np.log10(p)[g.at]
                u = g.count[g.tokens]
                add = lambda x, s=g.starts: np.add.reduceat(x, s)
                size = len(row["doc_ids"])
                yield rows(out, row["doc_ids"], g.lengths.astype(np.int64), add((u > 0).astype(np.int64)), np.full(size, int(uni.n)), add(uni.base(u)), add(token_p))

    return map_arrow(with_replies(groups, replies), run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, group: int = GROUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns where crc32(doc_id) mod 7 is not 2."""
    n = SPREAD * partitions(docs.sparkSession)
    groups = written(pack_groups(docs, modulus, remainder, group), "katz-groups")
    words = count_words(groups, n)
    sums = [sum(x) for x in zip(*(r["sums"] for r in words.where("kind = 'sums'").select("sums").collect()), strict=True)]  # a row for each bucket
    sums = sums or [0.0] * (DISCOUNTED + 3)
    uni = Unigrams(sums[0], sums[1], sums[2:])
    bigrams = count_bigrams(groups, words, n, uni)
    counts = [sum(x) for x in zip(*(r["sums"] for r in bigrams.where("kind = 'sums'").select("sums").collect()), strict=True)] or [0.0] * (DISCOUNTED + 1)
    parts = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 2)]
    hot = {int(r[0]): list(r[1:]) for r in bigrams.where("kind = 'hot'").groupBy("h").agg(*parts).collect()}  # 8 x buckets + 1 rows at most
    replies = words.where("kind = 'words'").unionByName(bigrams.where("kind = 'bigrams'"))
    scored = evaluate(groups, replies, n, uni, discounts(counts), hot)
    return scored.select("doc_id", fold_is("doc_id", modulus, remainder).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
