"""The registered queries on a whole table: columns, digests and casts against plain Python."""

import collections
import hashlib
import html
import re
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus_fixtures import SMALL
from ledgerlake.llm import decontaminate, queries
from test_decontaminate import leaked_items
from test_dedup import reference_classes, reference_fingerprint
from test_spans import personal, secrets


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def result(spark, key, columns):
    df = queries.QUERIES[key](spark, SMALL)
    assert df.columns == columns
    return sorted(map(tuple, df.collect()), key=str)


def base_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, e, k in spans).encode()).hexdigest()


def test_op1_is_the_article_of_every_page(spark):
    """The pages have one article each; its blocks, read with two regular expressions."""
    got = result(spark, "op1_html_extract", ["page_id", "url", "text", "n_chars"])
    want = []
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        source = re.sub(r"<br\s*/?>", " ", re.search(r"<article>(.*?)</article>", r["html"] or "<article></article>", re.S)[1])
        blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|table|tr|td|pre|figure|figcaption)\b[^>]*>", source)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        text = "\n".join(b for b in blocks if b)
        want.append((r["page_id"], r["url"], text, len(text)))
    differ = [(g, w) for g, w in zip(got, sorted(want, key=str)) if g != w]
    assert len(got) == len(want) and not differ, differ[:1]


@pytest.mark.parametrize("key, kinds, columns, literal", [
    ("op2_secret_scan", ("assign", "access", "hex"), ["n_assign", "n_access", "n_hex"], secrets),
    ("op5_pii", ("email", "ip", "card", "phone"), ["n_email", "n_ip", "n_card", "n_phone"], personal)])
def test_base_spans_and_their_digests(spark, documents, key, kinds, columns, literal):
    got = {r[0]: r[1:] for r in result(spark, key, ["doc_id", *columns, "base_sha256", "spans"])}
    assert len(got) == len(documents)
    for doc, text in documents:
        spans = literal(text or "")
        *counts, digest, added = got[doc]
        assert counts == [sum(k == kind for _, _, k in spans) for kind in kinds]
        assert digest == base_digest(spans)
        listed = [tuple(x.split(":")) for x in added.split(",")] if added else []
        assert {(k, str(a), str(e)) for a, e, k in spans} <= set(listed)
        places = [(int(a), int(e)) for _, a, e in listed]
        assert places == sorted(places, key=lambda p: p[0]) and all(0 <= a < e <= len(text) for a, e in places)


def test_op6_fingerprints_and_components(spark, documents):
    prints = [(d, reference_fingerprint(t)) for d, t in documents]
    classes = reference_classes(prints)
    assert result(spark, "op6_simhash_dedup", ["doc_id", "fingerprint", "component_id"]) == sorted(
        ((d, f"{p:016x}", classes[d]) for d, p in prints), key=str)


def test_op7_ids_and_decoded_text(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert result(spark, "op7_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=str)


def test_op8_columns_agree_with_each_other(spark, documents):
    rows = result(spark, "op8_toxicity", ["doc_id", "expected_severity", "p_toxic", "grade", "rejected"])
    assert [r[0] for r in rows] == sorted((d for d, _ in documents), key=str)
    by_chance = sorted(rows, key=lambda r: r[2])
    assert [r[4] for r in by_chance] == sorted(r[4] for r in rows)            # one cut on the chance
    assert all(0 <= r[2] <= 1 and r[2] - 1e-12 <= r[1] <= 3 and r[3] in range(4) for r in rows)
    severities = [r[1] for r in by_chance]
    assert severities == sorted(severities)                                   # the same weights behind all thresholds


def test_op9_leaks_of_every_document(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    of = {i: words(t) for i, t in items}
    want = []
    for d, t in documents:
        own = words(t)
        # a similar window holds most of the item's words
        leaks = leaked_items(t, [(i, x) for i, x in items if len(of[i] & own) >= 0.5 * len(of[i])])
        best = min(leaks, key=lambda i: (-leaks[i], i), default=None)
        want.append((d, bool(leaks), len(leaks), best, leaks.get(best)))
    got = result(spark, "op9_decontaminate", ["doc_id", "contaminated", "n_items", "best_item_id", "best_similarity"])
    key = lambda r: (*r[:4], None if r[4] is None else round(r[4], 9))
    assert list(map(key, got)) == list(map(key, sorted(want, key=str)))
    assert collections.Counter(r[1] for r in got)[True] > 0 and decontaminate.RADIUS == 15
