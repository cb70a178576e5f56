"""Repair of damaged conversations by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows used up, state of the grammar ``(s?(ua)+)?``).
Edges keep, rerole or delete the next row or insert an empty turn.  A forward
heap grows from the start and a reverse heap from the ends; they stop only when
their tops add up to more than the best meeting, so every edge where cheapest
paths cross from one side to the other is known, and the least concatenated
audit over those crossings is the answer.  Both heaps order equal costs by
layer, so a node's audit is final when it leaves its heap (edges of cost 0
always use a row).

Two audits of one cost into one node are never a beginning of one another
(they use the same rows, and what one has in excess are inserts that cost), so
least audits may be built up piece by piece.  That lets a conversation of any
length be repaired in blocks: four states at a block's start times four at its
end, composed in order, with the audits as the only memory that grows.

Spark sorts each conversation (turn, null first; then role and text) and marks
faults by windows; the search sees initials and flags, never texts.  The edits
then run over the sorted rows as a stream in constant memory.  One conversation
is one stream, since its digest has to see its turns in order.

Defined results: null conversation ids are a conversation; null roles and
texts are one space; rows of equal turn go by role and text; of repeated rows
all but the first are duplicates; a conversation that loses all its rows has
zeros, an empty audit and no turns.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import WHITE_SPACE, named, shared, stored

# States of the grammar: nothing yet, after a system, user, assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = frozenset((START, ASSISTANT))
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Flags of a row.
SOUND, BLANK, DUPLICATE, CUT = "0123"
BLOCK = 256


def _inserts(state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, letter) of the inserts."""
    return [(to, INSERT, "I") for role, to in STEPS[state].items() if role in ROLES]


def _row_edges(state: int, initial: str, flag: str) -> list[tuple[int, int, str]]:
    """(next state, cost, letter) of the edits that use up a row."""
    edges = [(state, DELETE, "D")]
    if flag not in (BLANK, DUPLICATE):
        extra = TRUNCATED if flag == CUT else 0
        for role, to in STEPS[state].items():
            if role == initial:
                edges.append((to, extra, "K"))
            if role in ROLES:
                edges.append((to, REROLE + extra, "R"))
    return edges


def _graph(rows: str) -> tuple[dict, dict]:
    """Edges out of, and into, every node of the lattice of ``rows`` (initial and flag, two characters a row)."""
    after: dict = {}
    before: dict = {}
    n = len(rows) // 2
    for layer in range(n + 1):
        for state in STATES:
            edges = [((layer, to), cost, letter) for to, cost, letter in _inserts(state)]
            if layer < n:
                edges += [((layer + 1, to), cost, letter)
                          for to, cost, letter in _row_edges(state, rows[2 * layer], rows[2 * layer + 1])]
            after[layer, state] = edges
            for to, cost, letter in edges:
                before.setdefault(to, []).append(((layer, state), cost, letter))
    return after, before


class _Side:
    """One of the two searches: cheapest cost and least audit of the nodes it has settled."""

    def __init__(self, edges: dict, sources: list, direction: int) -> None:
        self.edges, self.direction = edges, direction
        self.best = {node: (0, "") for node in sources}
        self.heap = [(0, direction * node[0], node) for node in sources]
        heapq.heapify(self.heap)
        self.settled: dict = {}

    def top(self) -> int | None:
        while self.heap and (self.heap[0][2] in self.settled or self.best[self.heap[0][2]][0] < self.heap[0][0]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self) -> tuple:
        """Takes the nearest node off the heap (``top`` has just cleared it) and relaxes its edges."""
        cost, _, node = heapq.heappop(self.heap)
        audit = self.best[node][1]
        self.settled[node] = (cost, audit)
        for other, step, letter in self.edges.get(node, ()):
            found = (cost + step, audit + letter if self.direction > 0 else letter + audit)
            known = self.best.get(other)
            if other not in self.settled and (known is None or found < known):
                self.best[other] = found
                heapq.heappush(self.heap, (found[0], self.direction * other[0], other))
        return node


@lru_cache(maxsize=1 << 15)
def cheapest(rows: str, source: int, targets: frozenset[int]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows`` that lead from a state to one of the targets."""
    after, before = _graph(rows)
    n = len(rows) // 2
    ahead = _Side(after, [(0, source)], 1)
    back = _Side(before, [(n, t) for t in sorted(targets)], -1)
    meeting = None
    while True:
        a, b = ahead.top(), back.top()
        if a is None or b is None or (meeting is not None and a + b > meeting):
            break
        side, other = (ahead, back) if a <= b else (back, ahead)
        node = side.settle()
        if node in other.best:
            cost = side.settled[node][0] + other.best[node][0]
            meeting = cost if meeting is None else min(meeting, cost)
    # Every cheapest path is settled ahead up to its end, or has an edge from a node settled ahead to one settled behind.
    found = []
    for node, (cost, audit) in ahead.settled.items():
        if node[0] == n and node[1] in targets:
            found.append((cost, audit))
        for to, step, letter in after[node]:
            if to in back.settled:
                found.append((cost + step + back.settled[to][0], audit + letter + back.settled[to][1]))
    return min(found, default=None)


class Search:
    """Cheapest edits of a conversation whose rows come one after another."""

    def __init__(self) -> None:
        self.rows: list[str] = []
        self.reached: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, initial: str, flag: str) -> None:
        if len(self.rows) == BLOCK:
            block = "".join(self.rows)
            self.reached = {t: best for t in STATES if (best := self._through(block, frozenset((t,)))) is not None}
            self.rows = []
        self.rows.append((initial if initial in ("s", "u", "a") else "-") + flag)

    def _through(self, block: str, targets: frozenset[int]) -> tuple[int, str] | None:
        ways = ((reached, cheapest(block, state, targets)) for state, reached in self.reached.items())
        return min(((r[0] + c[0], r[1] + c[1]) for r, c in ways if c is not None), default=None)

    def result(self) -> tuple[int, str]:
        return self._through("".join(self.rows), ENDS)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with reproducible damage: of twenty rows one each is dropped, emptied,
    stripped of its sentence ends, repeated and given the user's role.  Nulls count as one space."""
    space = F.lit(" ")
    rows = df.select(named(conv_col).alias("conv_id"), named(turn_col).alias("turn"),
                     F.coalesce(named(role_col), space).alias("role"), F.coalesce(named(text_col), space).alias("text"),
                     (F.crc32(F.concat(F.coalesce(named(conv_col).cast("string"), space), F.lit(":"),
                                       F.coalesce(named(turn_col).cast("string"), space))) % 20).alias("kind"))
    kind = F.col("kind")
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return (rows.filter(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def marked(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` with their place in the conversation, their role's initial, the previous one, and
    their first fault."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # The second window's rows are where the first one's exchange has put them.
    same = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    rest = F.rtrim("text", F.lit("".join(WHITE_SPACE)))
    numbered = (rows.withColumn("initial", F.substring("role", 1, 1))
                .withColumn("pos", F.row_number().over(order).cast("long"))
                .withColumn("previous", F.lag("initial").over(order)))
    flag = (F.when(rest == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
            .when(~F.substring(rest, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND))
    return numbered.withColumn("flag", flag)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows in record batches; a batch is also cut at a few MB of text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= size or chars > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


_PLAN = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        conv, search = None, None
        for own, initial, flag in _records(batches):
            if search is None or own != conv:
                if search is not None:
                    yield conv, *search.result()
                conv, search = own, Search()
            search.add(initial, flag)
        if search is not None:
            yield conv, *search.result()
    return _batches(found(), _PLAN)


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of every conversation of ``marked`` rows."""
    light = rows.select(F.col("conv_id").cast("long"), "initial", "flag", "pos")
    return (light.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "initial", "flag")
            .mapInArrow(_plan, "conv_id long, cost long, audit string"))


def fault_counts(rows: DataFrame) -> DataFrame:
    """Gaps and faults of every conversation of ``marked`` rows."""
    legal = F.concat("previous", "initial").isin("su", "ua", "au")
    by_turn = rows.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("flag") == f).alias(c) for f, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"),
                                                               (CUT, "truncated"))],
        F.count_if(F.col("previous").isNotNull() & ~legal).alias("illegal"))
    turn = F.col("turn").cast("long")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0).cast("long"))
    return by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in (
        "blank", "duplicate", "truncated", "illegal")])


_TURNS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                    ("edit", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans (rows with an audit) come before the conversation's turns."""
    def turns() -> Iterator[tuple]:
        conv, audit, at, seq, state = None, "", 0, 0, START

        def inserted() -> Iterator[tuple]:
            nonlocal at, seq, state
            while at < len(audit) and audit[at] == "I":
                role = "a" if state == USER else "u"
                state, at, seq = STEPS[state][role], at + 1, seq + 1
                yield conv, seq - 1, ROLES[role], "", "I"

        for own, plan, role, text in _records(batches):
            if plan is not None:
                yield from inserted()
                conv, audit, at, seq, state = own, plan, 0, 0, START
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            if letter == "R":
                role = ROLES["a" if state == USER else "u"]
            state = STEPS[state][role[0]]
            yield conv, seq, role, text, letter
            seq += 1
        yield from inserted()
    return _batches(turns(), _TURNS)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text, edit) after the edits of ``plan``; a conversation's turns follow one another
    in order within a partition."""
    none = F.lit(None).cast("string")
    both = (plan.select(F.col("conv_id").cast("long"), F.lit(0).cast("long").alias("pos"), "audit", none.alias("role"),
                        none.alias("text"))
            .unionByName(rows.select(F.col("conv_id").cast("long"), "pos", none.alias("audit"), "role", "text")))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
            .select("conv_id", "audit", "role", "text")
            .mapInArrow(_apply, "conv_id long, seq long, role string, text string, edit string"))


_DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done() -> Iterator[tuple]:
        conv, digest = None, None
        for own, seq, role, text in _records(batches):
            if seq == 0:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield conv, digest.hexdigest()
    return _batches(done(), _DIGEST)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of the newline-joined ``role:text`` of the conversations of ``repaired``."""
    return turns.select("conv_id", "seq", "role", "text").mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def report(original: DataFrame, turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Faults, cost, audit and digest of every conversation of ``original``, whose rows are now ``turns``."""
    rows = stored(marked(turns), "turns")      # read three times, twice without its texts
    plan = shared(plans(rows))
    parts = [plan, fault_counts(rows), digests(repaired(rows, plan))]
    out = original.select(named(conv_col).cast("long").alias("id")).distinct()
    for part in parts:
        out = out.join(part, F.col("id").eqNullSafe(part["conv_id"]), "left").drop(part["conv_id"])
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("conv_id"),
                      *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal",
                                                               "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
