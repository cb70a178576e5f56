"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of the
prefix's encoding.  A suffix automaton of the whole vocabulary, fed byte by
byte, yields the tokens that end at each position; of those, the last token is
the one that may stand after the (already known) last token of the shorter
prefix it leaves.  Whether two tokens may stand side by side is decided by
undoing their merges from the latest to the first: the pair is impossible as
soon as a merge across the boundary would have come first.  The ids of a word
are read off the back-pointers.  The cost is linear in the length, with no
worst case for long words.

Texts are split as the vocabulary file says (added tokens first, then the
byte-level pattern).  A blank between two visible characters always starts a
new word and nothing before or after it matters, so pieces between such
blanks are looked up whole in a bounded cache.

Defined results: null and empty text encode to no ids and decode to the empty
text; other columns and repeated rows pass through; texts of any length are
encoded whole.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, keep, named

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Bounds of a worker's caches: estimated bytes of all of them together, characters of a cached piece.
CACHE_BYTES = 192 << 20
CACHE_CHARS = 48
# Estimated bytes of an entry beside its own content (objects and place in the table).
ENTRY_BYTES, PAIR_BYTES = 130, 110
# Texts that are Python objects at a time.
TEXTS_AT_ONCE = 256

# A blank between two visible characters.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
DECODE_IDS = 1 << 16


class _LooseBlank(Exception):
    """A blank touches other white space or an end of the text."""


def byte_alphabet() -> dict[str, int]:
    """The visible characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """All substrings of a set of byte strings; reports which of them end at each position."""

    def __init__(self, words: list[tuple[bytes, int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for word, _ in words:
            last = 0
            for byte in word:
                last = self._extend(last, byte)
        self.own: dict[int, list[tuple[int, int]]] = {}
        for word, ident in words:
            state = 0
            for byte in word:
                state = self.next[state][byte]
            self.own.setdefault(state, []).append((len(word), ident))
        self.chains: dict[int, tuple[tuple[int, int], ...]] = {0: ()}

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, byte: int, q: int) -> int:
        """The state for the strings of ``q`` no longer than one step from ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(byte) == q:
            self.next[p][byte] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, byte: int) -> int:
        known = self.next[last].get(byte)
        if known is not None:
            return self._split(last, byte, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and byte not in self.next[p]:
            self.next[p][byte] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, byte, self.next[p][byte])
        return new

    def chain(self, state: int) -> tuple[tuple[int, int], ...]:
        """(length, word) of every word that is a suffix of the state's strings, longest first."""
        found = self.chains.get(state)
        if found is None:
            own = sorted(self.own.get(state, ()), reverse=True)
            found = self.chains[state] = (*own, *self.chain(self.link[state]))
        return found


class Encoder:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, spec: str) -> None:
        parts = json.loads(spec)
        model, pre = parts["model"], parts["pre_tokenizer"]
        if (parts.get("normalizer") or model["type"] != "BPE" or pre["type"] != "ByteLevel"
                or pre["add_prefix_space"] or not pre.get("use_regex", True) or model.get("dropout")
                or model.get("ignore_merges") or model.get("byte_fallback")):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in parts["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        texts: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()
                                        if all(c in alphabet for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = rank
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (vocab[a], vocab[b]), rank
        words = [(b, i) for i, b in texts.items() if len(b) == 1 or i in self.halves]
        self.automaton = SuffixAutomaton(words)
        self.tested: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.added = {a["content"]: a["id"] for a in parts["added_tokens"]}
        texts |= {i: t.encode() for t, i in self.added.items()}
        self.texts = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.split_added = re.compile("(" + "|".join(
            re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.plain = _Pieces(self, "")
        self.spaced = _Pieces(self, " ")
        self.held = 0
        self.old_words: dict[str, list[int]] = {}
        self.old_tested: dict[int, bool] = {}

    def hold(self, size: int) -> None:
        """Counts ``size`` more bytes of cache.  When half the bound is reached, what is held becomes the older
        half and the older half goes; entries that are met again move to the younger one."""
        self.held += size
        if self.held > CACHE_BYTES // 2:
            self.old_words, self.words = self.words, {}
            self.old_tested, self.tested = self.tested, {}
            for pieces in (self.plain, self.spaced):
                pieces.age()
            self.held = size

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the text of ``a`` followed by that of ``b`` gives just these two tokens."""
        rank, halves, pairs = self.rank, self.halves, self.pairs
        limit = len(pairs) + 1
        while True:
            across = pairs.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = rank.get(a, -1), rank.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:           # the left token was completed last
                limit, a = left, halves[a][1]
            else:                      # equal merges go from left to right
                limit, b = right + 1, halves[b][0]

    def word(self, text: str) -> list[int]:
        """The ids of one word, by the last token of each of its prefixes."""
        data = text.encode()
        auto = self.automaton
        step, link, length, chains = auto.next, auto.link, auto.length, auto.chains
        last = [-1] * (len(data) + 1)
        back = [0] * (len(data) + 1)
        state = matched = end = 0
        for byte in data:
            end += 1
            edges = step[state]
            while byte not in edges:
                state = link[state]
                matched = length[state]
                edges = step[state]
            state = edges[byte]
            matched += 1
            for size, token in chains.get(state) or auto.chain(state):
                if size > matched:
                    continue
                if size < end:
                    pair = last[end - size] << 32 | token
                    fits = self.tested.get(pair)
                    if fits is None:
                        fits = self._fits(pair, last[end - size], token)
                    if not fits:
                        continue
                last[end], back[end] = token, end - size
                break
        ids = []
        at = len(data)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def _fits(self, pair: int, a: int, b: int) -> bool:
        """``compatible``, remembered."""
        fits = self.old_tested.get(pair)
        if fits is None:
            fits = self.compatible(a, b)
        self.hold(PAIR_BYTES)
        self.tested[pair] = fits
        return fits

    def _part(self, text: str) -> list[int]:
        """``word``, remembered: parts of pieces, such as stops and words before them, come again."""
        ids = self.words.get(text)
        if ids is None:
            ids = self.old_words.get(text) or self.word(text)
            if len(text) <= CACHE_CHARS:
                self.hold(ENTRY_BYTES + len(text) + 24 * len(ids))
                self.words[text] = ids
        return ids

    def piece(self, text: str) -> bytes:
        """The ids (little-endian, 32 bits each) of a text that holds no added token."""
        found = self.pattern.findall(text)
        if len(found) == 1:       # held as a piece
            ids = self.word(text)
        else:
            ids = [i for w in found for i in self._part(w)]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, 32 bits each, little-endian."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._segment(text)
        return b"".join(self.added[part].to_bytes(4, "little") if part in self.added else self._segment(part)
                        for part in self.split_added.split(text))

    def _segment(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))
        except _LooseBlank:
            first, *rest = _BLANK.split(text)
            return self.piece(first) + b"".join([self.piece(" " + p) for p in rest])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids."""
        numbers = np.frombuffer(ids, dtype="<u4")
        out = []
        for start in range(0, len(numbers), DECODE_IDS):
            part = numbers[start:start + DECODE_IDS].tolist()
            out += itemgetter(*part)(self.texts) if len(part) > 1 else [self.texts[part[0]]]
        return b"".join(out).decode("utf-8", "replace")


class _Pieces(dict):
    """Encoded pieces by their text without the prefix; the encoder bounds them."""

    def __init__(self, encoder: Encoder, prefix: str) -> None:
        super().__init__()
        self.encoder, self.prefix = encoder, prefix
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, text: str) -> bytes:
        if not text or text[0].isspace() or text[-1].isspace():
            raise _LooseBlank
        ids = self.old.get(text) or self.encoder.piece(self.prefix + text)
        if len(text) <= CACHE_CHARS:
            self.encoder.hold(ENTRY_BYTES + len(text) + len(ids))
            self[text] = ids
        return ids


_loaded: dict[bytes, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The encoder of a vocabulary, built once in each worker process."""
    key = hashlib.sha256(spec.encode()).digest()
    keep("bpe", _loaded.clear)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(spec)
    return _loaded[key]


def tokens(text: Column, spec: str) -> Column:
    """Struct (ids: binary, 4 little-endian bytes an id; decoded: the text that the ids decode to)."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("ids binary, decoded string")
    def encoded(texts: pa.Array) -> pa.Array:
        model = encoder(spec)
        parts = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            ids = [model.encode(t) for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array([model.decode(i) for i in ids], pa.string())], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return encoded(F.coalesce(text, F.lit("")))


def encode(df: DataFrame, vocabulary: str, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct column (ids, decoded) for its text, and that column's name.

    ``vocabulary`` is the path of a vocabulary file; the driver reads it and
    its content (of fixed size) travels with the function.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    name, = fresh(df.columns, "bpe")
    return df.withColumn(name, tokens(named(text_col), spec)), name
