"""Lines that many documents share are dropped, but for the document of the largest id that holds them.

Lines are exploded with their positions, as 128-bit hashes of their keys only; distinct documents are counted for each hash, combined before
each shuffle; positions of frequent lines come back to their text, which is put together again without them.  Texts travel once, and no list is longer than a text
has lines.

A key is the line without blanks (0x20, 0x09-0x0D) at its ends, A-Z in lower case; keys under ``least`` code points never go.

Nulls: a null text is the empty text, which has one empty line.  A null id is one document of its own, lower than all others.  Rows of one id are one
document, and each of them gets a row of the result; equal rows get equal results.  Ties do not occur: of the documents of a key the largest id keeps it, on all
its lines.  An empty table gives an empty table.  Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import free_name, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def key_of(line: Column) -> Column:
    """The key of a line.  ``lower`` is A-Z only on ASCII, and faster than ``translate``, which is for the rest."""
    key = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def hashed(x: Column) -> list[Column]:
    """128 bits: XXH64 under two seeds."""
    return [F.xxhash64(x), F.xxhash64(F.lit(1), x)]


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t1, t2: hash of the text; at: position, h1, h2: hash of the key) of each line that can go."""
    text = text_of(docs)
    t1, t2 = hashed(text)
    split = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    keyed = split.where(F.length("line") >= least).select("doc_id", "t1", "t2", "at", key_of(F.col("line")).alias("key")).where(F.length("key") >= least)
    h1, h2 = hashed(F.col("key"))
    return keyed.select("doc_id", "t1", "t2", "at", h1.alias("h1"), h2.alias("h2"))


def frequent_lines(lines: DataFrame, documents: int) -> DataFrame:
    """(h1, h2, n_docs, keeper) of keys in at least so many documents.

    Documents are counted in two steps, each combined before its shuffle: a line that a third of all documents have is one row for each task of the second.
    """
    each = lines.select("h1", "h2", "doc_id").distinct()
    counted = each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n_docs") >= documents)


def deduplicated(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """``docs`` with ``text`` less the lines that go, and n_lines, n_dropped (names are lengthened if ``docs`` has them)."""
    lines = lines_of(docs, least)
    frequent = written(frequent_lines(lines, documents), "frequent-lines")
    gone = lines.join(frequent, ["h1", "h2"]).where(~F.col("keeper").eqNullSafe(F.col("doc_id")))
    gone = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("gone")).toDF("g_id", "g_1", "g_2", "gone")

    names = {}
    for n in ("t1", "t2", "gone", "lines", "kept", "n_lines", "n_dropped"):
        names[n] = free_name(docs, n)
    t1, t2 = hashed(text_of(docs))
    hashes = docs.withColumns({names["t1"]: t1, names["t2"]: t2})
    g = gone.withColumnsRenamed({"gone": names["gone"]} | {c: free_name(hashes, c) for c in ("g_id", "g_1", "g_2")})
    same = hashes["doc_id"].eqNullSafe(g[free_name(hashes, "g_id")]) & (hashes[names["t1"]] == g[free_name(hashes, "g_1")]) & (hashes[names["t2"]] == g[free_name(hashes, "g_2")])
    both = hashes.join(g, same, "left").select(*[hashes[c] for c in docs.columns], g[names["gone"]])

    parted = both.withColumn(names["lines"], F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    n = F.size(names["lines"])
    # array_except is by hash, so a text of many lines takes time in proportion to them
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(F.col(names["gone"]), F.array().cast("array<int>")))
    parted = parted.withColumns({names["n_lines"]: n.cast("long"), names["kept"]: kept})
    whole = F.array_join(F.transform(names["kept"], lambda i: F.get(F.col(names["lines"]), i)), "\n")
    text = F.when(F.size(names["kept"]) == n, F.coalesce(F.col("text"), F.lit(""))).otherwise(whole)
    out = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return parted.select(*out, names["n_lines"], (F.col(names["n_lines"]) - F.size(names["kept"])).alias(names["n_dropped"]))


def digests(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""
    out = deduplicated(docs.select("doc_id", "text"), least, documents)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
