r"""Chat formatting from event logs.

A log row is an event on one message of a conversation: ``message`` (a whole text, starts the message), ``delta`` (appended),
``edit`` (replaces the text) or ``regenerate`` (empties it; later deltas build it anew).  Logs are partitioned by conversation
and sorted by message and sequence number; a fold over the sorted stream makes final messages one at a time and renders them, so a
conversation of any length needs the memory of one message.  An SHA-256 of a conversation is sequential by nature: one task
streams it.

Template: user ``<s>[INST] text [/INST]``, assistant `` text </s>``, any other role ``<<role>> text <</role>>``.  Inside texts and role
names a backslash goes before every backslash and before the first character of every control string, so that no control
string is left inside and the text can be read back exactly.

Nulls: a null text is empty, a null role is the empty role, a null event is ``message``, a null conversation id is a conversation of
its own; null turns come first.  Rows that repeat a ``message`` event each make a message, ordered by (turn, seq, role, text).
A ``delta``, ``edit`` or ``regenerate`` on a turn without a message starts one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangency.llm.common import map_arrow, partitions, rows

_ESCAPE = re.compile(r"\\|<(?=/?s>|<)|\[(?=/?INST\])|>(?=>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\] (?P<user>(?:\\.|(?! \[/INST\])[^\\])*) \[/INST\]|<<(?P<role>(?:\\.|(?!>>)[^\\])*)>> (?P<other>(?:\\.|(?! <</role>>)[^\\])*) <</role>>| (?P<assistant>(?:\\.|(?! </s>)[^\\])*) </s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where in it the loss applies (start, end; equal for turns without loss)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body} </s>", 1, 1 + len(body)
    name = re.sub(r"([\\<>/])", r"\\\1", role)
    return f"<<{name}>> {body} <</role>>", 0, 0


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns, read back."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            yield "user", unescape(m["user"])
        elif m["assistant"] is not None:
            yield "assistant", unescape(m["assistant"])
        else:
            yield unescape(m["role"]), unescape(m["other"])
        at = m.end()


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """Final messages (conversation, role, text) of a stream sorted by conversation, turn, seq."""
    here, role, parts = None, "", None
    for batch in batches:
        conv, turn, event, who, text = (batch.column(i).to_pylist() for i in range(5))
        for c, t, e, r, x in zip(conv, turn, event, who, text, strict=True):
            x, r = x or "", r or ""
            if parts is not None and (here != (c, t) or (e or "message") == "message"):
                yield here[0], role, "".join(parts)
                parts = None
            if parts is None:
                here, role, parts = (c, t), r, [x] if e != "regenerate" else []
            elif e == "delta":
                parts.append(x)
            elif e == "edit":
                parts = [x]
            else:
                parts = []
    if parts is not None:
        yield here[0], role, "".join(parts)


def _sorted_log(log: DataFrame) -> DataFrame:
    cols = {c: F.col(c) if c in log.columns else F.lit(None).cast("string") for c in ("event", "seq")}
    rows_ = log.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), cols["event"].cast("string").alias("event"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), cols["seq"].cast("long").alias("seq"),
    )
    return rows_.repartition(partitions(log.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text").drop("seq")


def formatted(log: DataFrame) -> DataFrame:
    """One row per formatted turn: (conv_id, part, text, loss_start, loss_end); the text of a conversation is its parts in order.

    Loss positions count code points from the start of the conversation's text.
    """
    out = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        at, part, conv, started, held = 0, 0, None, False, []
        for c, role, text in _messages(batches):
            if not started or c != conv:
                at, part, conv, started = 0, 0, c, True
            s, a, b = render(role, text)
            held.append((c, part, s, at + a, at + b))
            at, part = at + len(s), part + 1
            if len(held) >= 2000:
                yield rows(out, *map(list, zip(*held, strict=True)))
                held = []
        if held:
            yield rows(out, *map(list, zip(*held, strict=True)))

    return map_arrow(_sorted_log(log), run, "conv_id long, part long, text string, loss_start long, loss_end long")


def digests(parts: DataFrame) -> DataFrame:
    """What is read back from formatted parts, per conversation.  ``parts`` as ``formatted`` returns them, still in order."""
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    class Sum:
        def __init__(self, conv: int | None) -> None:
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, start: int, end: int) -> None:
            for role, said in parse(text):
                self.turns += 1
                self.all.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(text[start - self.chars : end - self.chars]) if end > start else ""
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(masked)
            self.chars += len(text)

        def row(self) -> tuple:
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches):
        now, done = None, []
        for batch in batches:
            for c, part, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or part == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Sum(c)
                now.add(text, a, b)
            if len(done) >= 2000:
                yield rows(out, *map(list, zip(*done, strict=True)))
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield rows(out, *map(list, zip(*done, strict=True)))

    return map_arrow(parts, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


