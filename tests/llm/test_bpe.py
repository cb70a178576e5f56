"""Encoding against the tokenizers library, decoding as an exact round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus_fixtures import docs  # noqa: F401
from ledgerlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_random_texts(encoder, library):
    rng = random.Random(2)
    parts = [*"ab'sretll  \n\t.,!1 éAB　\x1c\x85 ", "<|endoftext|>", " the", "\r\n", "\U0001f600", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder.encode(text)) == want, repr(text)
        assert encoder.decode(encoder.encode(text)) == library.decode(want, skip_special_tokens=False) == text


def test_every_character(encoder, library):
    texts = [f"a{chr(c)}a1{chr(c)}1 {chr(c)}" for c in range(0, 0x3000)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ids(encoder.encode(text)) == want.ids, repr(text)


def test_long_word_is_linear_and_exact(encoder, library):
    text = "ab" * 20000
    assert ids(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_suffix_automaton_reports_every_word():
    words = [b"a", b"b", b"ab", b"ba", b"aba", b"bb", b"abab"]
    auto = bpe.SuffixAutomaton([(w, i) for i, w in enumerate(words)])
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12)))
        state = matched = 0
        for end, byte in enumerate(data, 1):
            while byte not in auto.next[state]:
                state = auto.link[state]
                matched = auto.length[state]
            state = auto.next[state][byte]
            matched += 1
            found = {i for n, i in auto.chain(state) if n <= matched}
            assert found == {i for i, w in enumerate(words) if data[:end].endswith(w)}


def test_small_caches_change_nothing(encoder, monkeypatch):
    text = "The quick brown fox, the lazy dog; don't stop. " * 5
    want = encoder.encode(text)
    for bound in (0, 2_000, 20_000):
        monkeypatch.setattr(bpe, "CACHE_BYTES", bound)
        for cache in (encoder.words, encoder.plain, encoder.spaced, encoder.tested):
            cache.clear()
        for _ in range(3):
            assert encoder.encode(text) == want


def test_caches_stay_in_their_bound(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100_000)
    rng = random.Random(8)
    for _ in range(300):
        encoder.encode(" ".join("".join(rng.choices("abcdefgh", k=6)) + rng.choice(["", ",", "."]) for _ in range(40)))
        entries = sum(map(len, (encoder.words, encoder.old_words, encoder.plain, encoder.plain.old, encoder.spaced,
                                encoder.spaced.old)))
        assert entries * bpe.ENTRY_BYTES + (len(encoder.tested) + len(encoder.old_tested)) * bpe.PAIR_BYTES < 110_000


def test_frame(docs):
    df, col = bpe.encode(docs([(1, "hi there"), (1, "hi there"), (None, None), (3, "")]), PATH)
    got = sorted((r["doc_id"] or 0, len(r[col]["ids"]) // 4, r[col]["decoded"]) for r in df.collect())
    assert got == [(0, 0, ""), (1, 2, "hi there"), (1, 2, "hi there"), (3, 0, "")]
    assert bpe.encode(docs([]).limit(0), PATH)[0].count() == 0


def test_workers_keep_one_operator_s_tables():
    from ledgerlake.llm import common
    spec = open(PATH, encoding="utf-8").read()
    bpe.encoder(spec)
    assert bpe._loaded and "bpe" in common._kept
    common.keep("bpe", bpe._loaded.clear)
    assert bpe._loaded
    other = {"x": 1}
    common.keep("other", other.clear)
    assert not bpe._loaded and other and list(common._kept) == ["other"]
    common.make_room()
    assert not other and not common._kept
    assert ids(bpe.encoder(spec).encode("hello")) == [31373]
