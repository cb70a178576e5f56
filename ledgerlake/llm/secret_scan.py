"""Secret scanning: fixed formats, and a token-efficiency test for random strings.

*Formats* (leftmost, non-overlapping for each kind; failing matches dropped):
``assign`` (a name such as ``token`` or ``api_key``, ``:`` or ``=``, and a value
of eight or more characters), ``access`` (``AKIA...``, sixteen or more) and
``hex`` (32 or more lower-case hex digits).

*Token efficiency*: ordinary words and names are cheap in a vocabulary that was
fitted to text, random strings are not.  Runs of at least ``RUN_CHARS``
characters from ``[A-Za-z0-9+/_=-]`` are encoded with a tiktoken vocabulary;
fewer than ``MIN_RATIO`` characters for each token make the run ``random``.  A run that is not random
as a whole may hold a random string beside plain words (a path, ``name=value``),
so its parts are judged too: what lies between ``/ = _ -``, and every stretch of
whole tokens of ``RUN_CHARS`` or just more characters with at most
``SEPARATORS`` of those four (short path steps and dates have more).  Parts and
stretches that overlap make one span, whose ends move to the nearest separators.
Known digests (hexadecimal of 32, 40, 56, 64, 96 or 128 digits), UUIDs, and
identifiers (without a digit or without a letter) are excluded, from the parts
too.  Of a run that touches a span of a format the uncovered rests of at least
``RUN_CHARS`` characters are judged like runs.  Runs of more than ``SLICE``
characters are encoded slice by slice, so cost stays linear.

Positions are code points, ends exclusive.  One pass over the texts, no
shuffle.  Defined results: null and empty texts have no spans; repeated rows
are scanned alike; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, named

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")       # the runs of 32 or more: each run matches whole
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN_CHARS = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN_CHARS)
MIN_RATIO = 2.0
SLICE = 512
SEPARATORS = 3
PART = re.compile(r"[A-Za-z0-9+]+")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
KNOWN = re.compile(rf"(?<![A-Za-z0-9+])(?:{UUID.pattern[:-2]}|{DIGEST.pattern[:-2]})(?![A-Za-z0-9+])", re.I)

Span = tuple[int, int, str]   # start, end, kind


def formats(text: str) -> list[Span]:
    """The spans of the fixed formats, by start, then kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _has_run(text, 32):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _has_run(text: str, size: int) -> bool:
    """Whether something unbroken by white space is that long."""
    return max(map(len, text.split()), default=0) >= size


def vocabulary(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("secret_scan", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def is_random(run: str, encoding: tiktoken.Encoding) -> bool:
    if DIGEST.match(run) or UUID.match(run):
        return False
    if not _mixed(run):
        return False
    return len(run) < MIN_RATIO * sum(len(t) for t in _tokens(run, encoding))


def _mixed(run: str) -> bool:
    return bool(re.search("[0-9]", run) and re.search("[A-Za-z]", run))


def _tokens(run: str, encoding: tiktoken.Encoding) -> Iterator[list[int]]:
    """The tokens of each slice of a run."""
    return (encoding.encode_ordinary(run[i:i + SLICE]) for i in range(0, len(run), SLICE))


def random_spans(run: str, encoding: tiktoken.Encoding) -> list[tuple[int, int]]:
    """Where a run is random: known digests and UUIDs cut out, each rest whole or its parts and stretches."""
    if not _mixed(run):
        return []
    spans, at = [], 0
    for known in [*KNOWN.finditer(run), None]:
        end = known.start() if known else len(run)
        if end - at >= RUN_CHARS:
            rest = run[at:end]
            found = [(0, len(rest))] if is_random(rest, encoding) else _stretches(rest, encoding)
            spans += [(at + a, at + b) for a, b in found]
        at = known.end() if known else end
    return spans


def _stretches(run: str, encoding: tiktoken.Encoding) -> list[tuple[int, int]]:
    """The random parts of a run and its random windows of whole tokens, merged."""
    parts = [m.span() for m in PART.finditer(run)]
    found = [(a, b) for a, b in parts if b - a >= RUN_CHARS and is_random(run[a:b], encoding)]
    starts = [0]           # of the tokens; a run is ASCII, so bytes are characters
    for tokens in _tokens(run, encoding):
        for t in tokens:
            starts.append(starts[-1] + len(encoding.decode_single_token_bytes(t)))
    j = 0
    for i, a in enumerate(starts):
        while j < len(starts) and starts[j] - a < RUN_CHARS:
            j += 1
        if j == len(starts):
            break
        b = starts[j]
        if b - a < MIN_RATIO * (j - i):
            window = run[a:b]
            if _mixed(window) and sum(map(window.count, "/=_-")) <= SEPARATORS:
                found.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in merged:
        lo, hi = _snapped(a, b, parts)
        if out and lo < out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _snapped(a: int, b: int, parts: list[tuple[int, int]]) -> tuple[int, int]:
    """The span from the first to the last part of which it holds half or more (itself when that is too short)."""
    at = bisect_right(parts, (a, a)) - 1
    held = []
    for lo, hi in parts[max(at, 0):]:
        if lo >= b:
            break
        if 2 * (min(b, hi) - max(a, lo)) >= hi - lo:
            held.append((lo, hi))
    if held and held[-1][1] - held[0][0] >= RUN_CHARS:
        return held[0][0], held[-1][1]
    return a, b


def scan(text: str, encoding: tiktoken.Encoding) -> tuple[list[Span], list[Span]]:
    """(spans of the formats, all spans)."""
    base = formats(text)
    if not _has_run(text, RUN_CHARS):
        return base, base
    more, at, seen = [], 0, 0
    for m in RUN.finditer(text):
        # the rests between the formats' spans; seen is the furthest end of those that begin before this run ends
        start = max(seen, m.start())
        rests = []
        while at < len(base) and base[at][0] < m.end():
            rests.append((start, base[at][0]))
            seen = max(seen, base[at][1])
            start = max(seen, m.start())
            at += 1
        for a, b in [*rests, (start, m.end())]:
            if b - a >= RUN_CHARS:
                more += [(a + lo, a + hi, "random") for lo, hi in random_spans(text[a:b], encoding)]
    return base, in_order(base + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_loaded: dict[bytes, tiktoken.Encoding] = {}


def found(text: Column, ranks: bytes, pattern: str) -> Column:
    """Struct of the counts by kind, and the formats' and all spans as ``kind:start:end`` joined by commas."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()

    @F.arrow_udf("n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")
    def scanned(texts: pa.Array) -> pa.Array:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = vocabulary(ranks, pattern)
        rows = [scan(t, _loaded[key]) for t in texts.to_pylist()]
        counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS[:3]]
        return pa.StructArray.from_arrays(
            [*counts, pa.array([written(b) for b, _ in rows], pa.string()),
             pa.array([written(a) for _, a in rows], pa.string())],
            names=["n_assign", "n_access", "n_hex", "base", "spans"])

    return scanned(F.coalesce(text, F.lit("")))


def scan_documents(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct column of its texts' spans, and that column's name."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    name, = fresh(df.columns, "secrets")
    return df.withColumn(name, found(named(text_col), ranks, pattern)), name
