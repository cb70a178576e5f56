"""Chat formatting with a grammar round trip.

Grammar of the rendered text, one segment for each turn::

    conversation := segment*
    segment      := "<s>[" role "] " text " [/" role "]</s>"       (user, system, other roles)
                  | "<s>[" role "] " text " </s>"                 (assistant)

``role`` is written as ``INST`` for user, ``SYS`` for system, ``ASSIST`` for
assistant and ``ROLE:name`` for any other.  Control strings are ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``[SYS]``, ``[/SYS]``, ``[ASSIST]``,
``[/ASSIST]``, ``[ROLE:...]`` and ``[/ROLE:...]``, each also with backslashes
after its first character.

Every turn is rendered, reparsed by the deterministic parser and compared with
its source.  When they differ, the text's control strings are escaped (one
more backslash after the first character) and the turn is rendered again,
until the parse is identical.  Reading removes one backslash from each.  A
segment's body never holds a bare control string, so the segments of a
conversation parse back one by one.

*Loss mask*: the texts of assistant turns.

Scale: rendering and the round trip work on single turns, wherever they lie.
Only the digests of a conversation need its turns in order; they are folded
over the sorted stream of a partition with constant memory, so a conversation
of any length never sits in memory as one value.

Defined results: null text and null roles count as empty; turns are ordered by
turn number (nulls first), then role, text; repeated rows are repeated turns;
null conversation ids form one conversation.  An empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import named

NAMES = {"user": "INST", "system": "SYS", "assistant": "ASSIST"}
_ROLES = {v: k for k, v in NAMES.items()}
# A control string: first character, backslashes, rest.
CONTROL = r"(<)(\\*)(/?s>)|(\[)(\\*)(/?(?:INST|SYS|ASSIST|ROLE:[^\[\]]*)\])"
_CONTROL = re.compile(CONTROL)
_OPEN = re.compile(r"<s>\[(INST|SYS|ASSIST|ROLE:[^\[\]]*)\] ")


def _tag(role: str) -> str:
    # Brackets and per cent signs in a role's name are written as %XX.
    return NAMES.get(role) or "ROLE:" + re.sub(r"[\[\]%]", lambda m: f"%{ord(m.group()):02X}", role)


def _role(tag: str) -> str:
    return _ROLES.get(tag) or re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), tag[len("ROLE:"):])


def _ending(tag: str) -> str:
    return " </s>" if tag == "ASSIST" else f" [/{tag}]</s>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "")[1:] + (m[3] or m[6]), text)


def parse(rendered: str, start: int = 0) -> tuple[list[tuple[str, str, int, int]], int]:
    """(role, text, body start, body end) of each segment from ``start``, and where parsing stopped.

    Parsing stops at the end or at the first segment that does not fit the grammar.
    """
    turns = []
    while opened := _OPEN.match(rendered, start):
        tag, body = opened[1], opened.end()
        ending = _ending(tag)
        end = None
        # The body runs up to the first bare control string, which must begin the ending.
        for control in _CONTROL.finditer(rendered, body - 1):
            if not (control[2] or control[5]):
                end = control.start() - 1
                break
        if end is None or end < body or not rendered.startswith(ending, end):
            break
        turns.append((_role(tag), unescape(rendered[body:end]), body, end))
        start = end + len(ending)
    return turns, start


def render(role: str, text: str) -> str:
    """The segment of one turn; its parse gives back exactly the role and the text."""
    tag = _tag(role)
    body = text
    while True:
        segment = f"<s>[{tag}] {body}{_ending(tag)}"
        turns, stop = parse(segment)
        if stop == len(segment) and [t[:2] for t in turns] == [(role, text)]:
            return segment
        if body != text:
            raise ValueError(f"turn does not survive the round trip: {role!r}, {text[:80]!r}")
        body = escape(text)


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, segment) of every turn, in no order."""
    @F.arrow_udf("string")
    def segments(roles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([render(r, t) for r, t in zip(roles.to_pylist(), texts.to_pylist())], pa.string())

    rows = df.select(named(conv_col).alias("conv_id"), named(turn_col).alias("turn"),
                     F.coalesce(named(role_col), F.lit("")).alias("role"),
                     F.coalesce(named(text_col), F.lit("")).alias("text"))
    return rows.withColumn("segment", segments("role", "text"))


class _Digest:
    """What the read-back of one conversation adds up to."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str) -> None:
        found, stop = parse(segment)
        if stop != len(segment) or len(found) != 1:
            raise ValueError(f"not one segment: {segment[:80]!r}")
        role, text, _, _ = found[0]
        data = text.encode()
        self.turns += 1
        self.chars += len(segment)
        self.all.update(role.encode() + b"\n" + data + b"\n")
        if role == "assistant":
            self.loss += len(text)
            self.masked.update(data)

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                  ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    conv, digest = None, None
    for batch in batches:
        for own, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is None or own != conv:
                if digest is not None:
                    done.append(digest.row(conv))
                conv, digest = own, _Digest()
            digest.add(segment)
        if len(done) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _OUT)], schema=_OUT)
            done = []
    if digest is not None:
        done.append(digest.row(conv))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _OUT)], schema=_OUT)


def read_back(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``format_turns``, computed from the parse of its segments."""
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select(F.col("conv_id").cast("long"), "segment")
            .mapInArrow(_fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                               "loss_sha256 string, formatted_chars long"))


def with_fixed(df: DataFrame, conv: int, turns: list[tuple[str, str]]) -> DataFrame:
    """``df`` and one more conversation of these turns."""
    own = F.inline(F.array(*[F.struct(F.lit(conv).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                                      F.lit(r).alias("role"), F.lit(t).alias("text"))
                             for i, (r, t) in enumerate(turns)]))
    return df.select("conv_id", "turn", "role", "text").unionByName(df.sparkSession.range(1).select(own))


def escaped_length(text: Column) -> Column:
    """Characters that ``escape`` would give."""
    return F.length(text) + F.regexp_count(text, F.lit(CONTROL))
