"""Quality rules: base statistics of whole texts, then a learned decision list.

The base rule fails texts under 20 words and texts of which over 30 % of the words lie in repeated eight-word windows.  Among the rest a decision
list decides.  It is learned from labelled statistics (at most ``Params.sample`` rows) by sequential covering: a rule for
``reject`` is grown, threshold by threshold, on two thirds of the rows by information gain, pruned on the last third, and kept while its
precision there holds; covered rows leave and the next rule is learned.  The list becomes one ordered Spark CASE expression.

Nulls: a null text has no words and fails the base rule.  Null ids keep their row; null labels are not learnt from.  Without
labels of both classes the list is empty and every text that passes the base rule is kept.  Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import U64, WordHashes, labelled_sample, map_arrow, rows, shingle_hashes, texts_of, written

WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "bar_rate", "stop_rate", "distinct_rate", "top_rate", "longest")
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Params:
    sample: int = 20_000  # labelled rows learnt from, at most
    rules: int = 12
    conditions: int = 3
    precision: float = 0.9
    support: int = 8
    seed: int = 5
    cuts: int = 40  # thresholds tried for each statistic


def statistics(text: bytes, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The base counts of a text, then the rates that rules may use."""
    words = text.split()
    n = len(words)
    h = hashes(words)
    chars = len(text.decode("utf-8", "replace"))
    blanks = len(text) - sum(map(len, words))
    word_chars = chars - blanks
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    distinct, counts = np.unique(h, return_counts=True)
    if n >= WINDOW and len(distinct) <= n - 1:
        s = shingle_hashes(h, WINDOW)
        _, at, many = np.unique(s, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(many[at] > 1)
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:-1] > 0).sum())
    upper = sum(map(text.count, _UPPER)) if n else 0
    digits = len(text) - len(text.translate(None, b"0123456789"))
    marks = text.count(b"!") + text.count(b"?")
    base = [n, word_chars, symbols, dup, repeat]
    m, c = max(n, 1), max(word_chars, 1)
    rates = [
        float(n), word_chars / m, symbols / m, dup / max(len(lines), 1), repeat / m, upper / c, digits / c, marks / m, text.count(b"|") / m,
        sum(len(w) <= 3 for w in words) / m, len(distinct) / m, float(counts.max()) / m if n else 0.0, float(max(map(len, words), default=0)),
    ]
    return base, rates


_UPPER = [bytes([x]) for x in range(65, 91)]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, the base counts, x_ and the name of each rate) of each row."""
    names = ["doc_id", *BASE, *(f"x_{f}" for f in FEATURES)]
    out = pa.schema([(c, pa.float64() if c.startswith("x_") else pa.int64()) for c in names])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            base, rates = zip(*(statistics(t, hashes) for t in texts_of(batch)), strict=True) if batch.num_rows else ([], [])
            b, r = np.array(base, np.int64).reshape(-1, len(BASE)), np.array(rates, float).reshape(-1, len(FEATURES))
            yield rows(out, batch.column(0), *b.T, *r.T)

    ddl = ", ".join(f"{c} {'double' if c.startswith('x_') else 'long'}" for c in names)
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ddl)


# ------------------------------------------------------------------------------------------------- decision lists


@dataclass
class Rule:
    conditions: list[tuple[int, bool, float]] = field(default_factory=list)  # statistic, above?, threshold

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.conditions:
            out &= x[:, f] > t if above else x[:, f] <= t
        return out

    def expression(self) -> Column:
        out = None
        for f, above, t in self.conditions:
            c = F.col(f"x_{FEATURES[f]}")
            one = c > F.lit(float(t)) if above else c <= F.lit(float(t))
            out = one if out is None else out & one
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {t:.6g}" for f, above, t in self.conditions)


def _gain(p0: int, n0: int, p1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """FOIL's information gain of narrowing (p0, n0) to (p1, n1)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p1 * (np.log2(p1 / np.maximum(p1 + n1, 1)) - np.log2(p0 / (p0 + n0)))
    return np.where(p1 > 0, g, -np.inf)


def grow(x: np.ndarray, y: np.ndarray, p: Params) -> Rule:
    rule, live = Rule(), np.ones(len(x), bool)
    while len(rule.conditions) < p.conditions and (y[live] == 0).any():
        best = (1e-9, None)
        pos, neg = int(y[live].sum()), int((~y[live].astype(bool)).sum())
        for f in range(x.shape[1]):
            v = x[live, f]
            cuts = np.unique(np.quantile(np.concatenate([v, v[y[live] == 1]]), np.linspace(0, 1, p.cuts)))
            order = np.sort(v[y[live] == 1]), np.sort(v[y[live] == 0])
            p_le, n_le = np.searchsorted(order[0], cuts, "right"), np.searchsorted(order[1], cuts, "right")
            for above, a, b in ((False, p_le, n_le), (True, pos - p_le, neg - n_le)):
                g = _gain(pos, neg, a.astype(float), b.astype(float))
                i = int(np.argmax(g))
                if g[i] > best[0]:
                    best = (float(g[i]), (f, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        live = rule.covers(x)
    return rule


def worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    c = rule.covers(x)
    p, n = int(y[c].sum()), int(c.sum() - y[c].sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drops last conditions while the rule is worth no less on rows it was not grown on."""
    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if worth(shorter, x, y) >= worth(best, x, y):
            best = shorter
    return best


def learn(x: np.ndarray, bad: np.ndarray, p: Params = Params()) -> list[Rule]:
    """Ordered rules that reject, by sequential covering."""
    out: list[Rule] = []
    rng = np.random.default_rng(p.seed)
    while len(out) < p.rules and bad.sum() >= p.support and (bad == 0).any():
        pick = rng.permutation(len(x))
        cut = 2 * len(x) // 3
        g, h = pick[:cut], pick[cut:]
        if not bad[g].any() or not bad[h].any():
            break
        rule = prune(grow(x[g], bad[g], p), x[h], bad[h])
        c = rule.covers(x[h])
        every = rule.covers(x)
        if not rule.conditions or not c.any() or bad[h][c].mean() < p.precision or bad[every].sum() < p.support:
            break
        out.append(rule)
        x, bad = x[~every], bad[~every]
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered CASE expression of a list: false at the first rule that covers, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].expression(), F.lit(False))
    for r in rules[1:]:
        out = out.when(r.expression(), F.lit(False))
    return out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, p: Params = Params()) -> list[Rule]:
    """Rules from the labelled rows that the base rule passes; at most ``p.sample`` labelled rows."""
    chosen = labelled_sample(labels, p.sample, columns=("quality",))
    # the id list has at most p.sample rows, so it is sent to all tasks
    seen = stats.where(~base_failed()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*[f"x_{f}" for f in FEATURES], "quality")).alias("x")).select("x.*").collect()  # one row for an id
    if not seen:
        return []
    a = np.array(sorted(tuple(r) for r in seen), dtype=float)
    return learn(a[:, :-1], (a[:, -1] == 0).astype(int), p)


def judged(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    stats = written(described(docs), "text-statistics")
    rules = fit(stats, labels, p)
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
