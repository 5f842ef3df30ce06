"""Text queries in SQL, for a second engine over the same tables, where the dialect can express them.  64-bit arithmetic is done in 128 bits, modulo 2^64."""

from __future__ import annotations

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M = "18446744073709551616::UHUGEINT"


def big(x: object) -> str:
    return f"({x})::UHUGEINT"


def times(x: str, p: int) -> str:
    return f"(({x}) * {big(p)} % {M})"


def plus(x: str, y: object) -> str:
    return f"((({x}) + {big(y)}) % {M})"


def turned(x: str, r: int) -> str:
    """Bits of ``x`` turned left; ``x`` is written twice, so it should be a column."""
    return f"((({x}) * {big(1 << r)} % {M}) + (({x}) // {big(1 << (64 - r))}))"


def word_at(hexed: str, byte: str, size: int) -> str:
    """The little-endian number of ``size`` bytes at a byte of a hexadecimal text."""
    return "('0x' || " + " || ".join(f"substr({hexed}, 2 * ({byte}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def xxh64(source: str, seed: int) -> str:
    """CTEs from ``source`` (s: distinct texts) to ``hashed`` (s, h): XXH64 of the UTF-8 bytes, stage by stage."""
    lane = lambda k: f"list_transform(range(0, n // 32), lambda i: {word_at('x', f'32 * i + {8 * k}', 8)})"
    start = [(seed + P1 + P2) % 2**64, (seed + P2) % 2**64, seed, (seed - P1) % 2**64]
    mixed = plus("acc", f"(v * {big(P2)} % {M})")
    stripe = lambda k: f"list_reduce(list_prepend({big(start[k])}, l{k}), lambda acc, v: {times(turned(mixed, 31), P1)})"
    one = lambda v: times(turned(times(v, P2), 31), P1)
    steps = f"""bytes AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {source}),
lanes AS (SELECT s, x, n, {", ".join(f"{lane(k)} AS l{k}" for k in range(4))}, list_transform(range(0, n % 32 // 8), lambda i: {one(word_at("x", "n // 32 * 32 + 8 * i", 8))}) AS eights FROM bytes),
accs AS (SELECT s, x, n, eights, {", ".join(f"{stripe(k)} AS a{k}" for k in range(4))} FROM lanes),
joined AS (SELECT s, x, n, eights, a0, a1, a2, a3, {plus(plus(plus(turned("a0", 1), turned("a1", 7)), turned("a2", 12)), turned("a3", 18))} AS m FROM accs)"""
    for k in range(4):
        source_ = "joined" if not k else f"m{k - 1}"
        steps += f",\nm{k} AS (SELECT s, x, n, eights, a0, a1, a2, a3, {plus(times(f'xor(m, {one(f'a{k}')})', P1), P4)} AS m FROM {source_})"
    step8 = plus(times(turned("xor(acc, v)", 27), P1), P4)
    return steps + f""",
begun AS (SELECT s, x, n, eights, {plus(f"CASE WHEN n >= 32 THEN m ELSE {big((seed + P5) % 2**64)} END", "n")} AS h FROM m3),
eighted AS (SELECT s, x, n, list_reduce(list_prepend(h, eights), lambda acc, v: {step8}) AS h FROM begun),
foured AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN xor(h, {times(word_at("x", "n // 8 * 8", 4), P1)}) END AS f, h FROM eighted),
ended AS (SELECT s, x, n, CASE WHEN f IS NOT NULL THEN {plus(times(turned("f", 23), P2), P3)} ELSE h END AS h FROM foured),
tailed AS (SELECT s, list_reduce(list_prepend(h, list_transform(range(n // 4 * 4, n), lambda i: {times(word_at("x", "i", 1), P5)})), lambda acc, v: {times(turned("xor(acc, v)", 11), P1)}) AS h FROM ended),
shaken AS (SELECT s, {times(f"xor(h, h // {big(1 << 33)})", P2)} AS h FROM tailed),
stirred AS (SELECT s, {times(f"xor(h, h // {big(1 << 29)})", P3)} AS h FROM shaken),
hashed AS (SELECT s, xor(h, h // {big(1 << 32)}) AS h FROM stirred)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SIMHASH_SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM words),
shingles AS (SELECT doc_id, s, count(*) AS c FROM cut GROUP BY ALL), kinds AS (SELECT DISTINCT s FROM shingles),
{xxh64("kinds", 42)},
counts AS (SELECT doc_id, sum(c) AS n, {", ".join(f"sum(c * ((h::UBIGINT >> {b}) & 1)::BIGINT) AS b{b}" for b in range(64))} FROM shingles JOIN hashed USING (s) GROUP BY doc_id),
prints AS (SELECT doc_id, {" | ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))} AS fp FROM counts),
own AS (SELECT d.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents d LEFT JOIN prints p USING (doc_id)),
different AS (SELECT DISTINCT fp FROM own),
links AS (SELECT a.fp AS a, b.fp AS b FROM different a JOIN different b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::UHUGEINT::BIT) <= 4),
reach AS (SELECT fp AS a, fp AS b FROM different UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT reach.a AS fp, min(doc_id) AS component_id FROM reach JOIN own ON own.fp = reach.b GROUP BY 1)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM own JOIN classes USING (fp)"""


MIX1, MIX2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15  # fixed values of the splitmix finaliser


def mixed(source: str, out: str, seed: int) -> str:
    """CTEs from ``source`` (k: distinct numbers) to ``out`` (k, m)."""
    add = (seed * STEP + STEP) % 2**64
    return f"""{out}_0 AS (SELECT k, {plus("k", add)} AS x FROM {source}),
{out}_1 AS (SELECT k, {times(f"xor(x, x // {big(1 << 30)})", MIX1)} AS x FROM {out}_0),
{out}_2 AS (SELECT k, {times(f"xor(x, x // {big(1 << 27)})", MIX2)} AS x FROM {out}_1),
{out} AS (SELECT k, xor(x, x // {big(1 << 31)}) AS m FROM {out}_2)"""


def again(ctes: str, name: str) -> str:
    """The stages of ``xxh64`` under names of their own."""
    for stage in ("bytes", "lanes", "accs", "joined", "m0", "m1", "m2", "m3", "begun", "eighted", "foured", "ended", "tailed", "shaken", "stirred", "hashed"):
        ctes = ctes.replace(f"{stage} AS (", f"{name}_{stage} AS (").replace(f"FROM {stage})", f"FROM {name}_{stage})")
    return ctes


BUCKETS, SHARE, SEED = 10_000, 0.8, 11  # as in importance.Params
IMPORTANCE_SQL = f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS s FROM words), kinds AS (SELECT DISTINCT s FROM placed),
{xxh64("kinds", 0)},
tokens AS (SELECT doc_id, i, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM placed JOIN hashed USING (s)),
ones AS (SELECT DISTINCT h AS k FROM hashed), {mixed("ones", "seconds", 1)},
grams AS (SELECT doc_id, h AS k FROM tokens UNION ALL SELECT doc_id, xor(h * 3 % {M}, m) FROM tokens JOIN seconds ON later = seconds.k),
bags AS (SELECT doc_id, k, count(*) AS c FROM grams GROUP BY ALL), every AS (SELECT DISTINCT k FROM bags), {mixed("every", "spots", 2)},
filled AS (SELECT doc_id, (m % {BUCKETS})::BIGINT AS bucket, sum(c) AS c FROM bags JOIN spots USING (k) GROUP BY ALL),
good AS (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL GROUP BY 1),
raw AS (SELECT bucket, sum(c) AS n FROM filled GROUP BY 1), wanted AS (SELECT bucket, sum(c) AS n FROM filled WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY 1),
totals AS (SELECT coalesce((SELECT sum(n) FROM raw), 0)::DOUBLE AS r, coalesce((SELECT sum(n) FROM wanted), 0)::DOUBLE AS t),
ratio AS (SELECT bucket, CASE WHEN t > 0 THEN ln((coalesce(wanted.n, 0) + 1)::DOUBLE / (t + {BUCKETS})) - ln((raw.n + 1)::DOUBLE / (r + {BUCKETS})) ELSE 0 END AS v FROM raw LEFT JOIN wanted USING (bucket) CROSS JOIN totals),
weights AS (SELECT doc_id, sum(c * v) AS weight FROM filled JOIN ratio USING (bucket) GROUP BY 1),
ids AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS s FROM documents),
{again(xxh64("ids", SEED), "id")},
sums AS (SELECT d.doc_id, coalesce(weight, 0.0) AS log_weight, coalesce(weight, 0.0) - ln(-ln((h::DOUBLE + 0.5) / 18446744073709551616.0::DOUBLE)) AS perturbed FROM documents d LEFT JOIN weights USING (doc_id) JOIN id_hashed ON s = coalesce(d.doc_id::VARCHAR, '')),
ranked AS (SELECT *, row_number() OVER (ORDER BY perturbed DESC) <= (SELECT round({SHARE}::DOUBLE * count(*)) FROM documents) AS kept FROM sums)
SELECT doc_id, round(log_weight, 6) AS log_weight, round(perturbed, 6) AS perturbed, kept FROM ranked"""


def _count(column: str, what: str) -> str:
    return f"(length({column}) - length(replace({column}, '{what}', ''))) // {len(what)}"


def _doubled(column: str, what: str) -> str:
    """How often a character has another of its kind behind it."""
    return f"coalesce(list_sum(list_transform(regexp_extract_all({column}, '{what}+'), lambda x: length(x) - 1)), 0)"


#: What op10 returns: a backslash before each backslash and the first character of each control string, 18, 6 and 15 characters of template a turn.
CHAT_SQL = f"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + {_count("text", chr(92))} + {_count("text", "<s>")} + {_count("text", "</s>")} + {_count("text", "[INST]")} + {_count("text", "[/INST]")} + {_doubled("text", "<")} + {_doubled("text", ">")} AS body,
length(role) + length(regexp_replace(role, '[^\\\\<>/]', '', 'g')) AS named FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(body + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE 15 + named END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""




_WORDS = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
AUDIT_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
f AS (SELECT part, len({_WORDS}) < 200 AS a, 100 * len(list_distinct({_WORDS})) < 50 * len({_WORDS}) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM d JOIN firsts USING (t)),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
grown AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM grown, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before
FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM grown WHERE length(filter_order) = 5)),
counts AS (SELECT part, filter_order, step, own, sum(n) FILTER (fails & (before | own) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & own <> 0) AS removed,
sum(n) FILTER (fails & before <> 0 AND fails & own <> 0) AS redundant, sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (fails & before = 0 AND fails & own <> 0) AS good_lost,
sum(toxic) FILTER (fails & before = 0 AND fails & own <> 0) AS toxic_lost FROM m, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, filter_order[step] AS "filter", coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM counts"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM cut),
keyed AS (SELECT doc_id, i, line, translate(trim(line, {_BLANKS}), '{UPPER}', '{LOWER}') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id"""


def _nearest(books: str) -> str:
    """The nearest entry of ``books`` (p, e, y) to each part of ``parts`` (vec_id, p, x)."""
    gap = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT vec_id, p, x, arg_min(e, (g, e)) AS e, min(g) AS g FROM (SELECT vec_id, p, x, e, {gap}::BIGINT AS g FROM parts JOIN {books} USING (p)) GROUP BY ALL"


def _moved(codes: str, books: str) -> str:
    """Entries at the floor of the mean of the parts that chose them."""
    means = f"SELECT p, e, list(m ORDER BY k) AS y FROM (SELECT p, e, k, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS k FROM {codes}) GROUP BY p, e, k) GROUP BY p, e"
    return f"SELECT p, e, coalesce(n.y, o.y) AS y FROM {books} o LEFT JOIN ({means}) n USING (p, e)"


CODES_SQL = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64),
b0 AS (SELECT p, e, x AS y FROM parts JOIN firsts USING (vec_id)), c0 AS ({_nearest("b0")}),
b1 AS ({_moved("c0", "b0")}), c1 AS ({_nearest("b1")}),
b2 AS ({_moved("c1", "b1")}), c2 AS ({_nearest("b2")}),
told AS (SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(g)::BIGINT AS error FROM c2 GROUP BY vec_id),
named AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM told JOIN kept USING (vec_id), named"""
