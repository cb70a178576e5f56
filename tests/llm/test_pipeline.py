"""The pipeline and every registered query: brute force on sf0.001, odd rows, empty tables."""

import hashlib
import math
import os
import re
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_fixtures import SMALL
from ledgerlake.llm import queries, toxicity
from ledgerlake.llm.common import table
from ledgerlake.testing import compare, duck_connection

sys.path.insert(0, os.path.dirname(__file__))
from test_decontaminate import leaked_items  # noqa: E402
from test_dedup import reference_classes, reference_fingerprint  # noqa: E402


def plain_toxic(text, model):
    """The model's verdict by its definition, without caches or batches."""
    found = {f for w in set((text or "").lower().split()) for f in toxicity.features(w) if f in model.weights}
    score = sum(sorted(model.weights[f] for f in found))
    return bool(model.thresholds) and 1 / (1 + math.exp(model.thresholds[0] - score)) >= model.cut


def test_run_against_brute_force(spark):
    docs = [r.asDict() for r in table(spark, SMALL, "documents").collect()]
    model = toxicity.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    kept = [d for d in docs if not plain_toxic(d["text"], model)]
    best = {}
    for d in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", d["text"] or "")
        rank = (-len(d["text"] or ""), d["doc_id"])
        best[norm] = min(best.get(norm, rank), rank)
    kept = [d for d in kept if d["doc_id"] in {r[1] for r in best.values()}]
    classes = reference_classes([(d["doc_id"], reference_fingerprint(d["text"])) for d in kept])
    kept = [d for d in kept if classes[d["doc_id"]] == d["doc_id"]]
    kept = [d for d in kept if not leaked_items(d["text"], items)]
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    want = set()
    for d in kept:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want.add((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                  hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert len(got) == len(want) < len(docs)


def test_stages_take_odd_rows_and_empty_tables(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None, "a"), (None, "", None, None, None, "b"), (1, "word " * 30000, "en", "s", 1, "c"),
         (1, "word " * 30000, "en", "s", 1, "c"), (2, "x", None, "s", 1, "d"), (2, "y", None, "s", 1, "e")],
        "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SMALL)
        assert out.count() >= 1
        assert stage(spark, odd.limit(0), SMALL).count() == 0
        if name != "bpe":
            assert out.columns == odd.columns


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_queries_match_their_oracle(spark, key):
    rows, problems = compare(queries.QUERIES[key](spark, SMALL), duck_connection(SMALL), queries.ORACLES[key])
    assert rows and not problems, problems


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "bpe"]


@pytest.mark.parametrize("key", ["op9_decontaminate", "op10_exact_dedup", "op13_shards"])
def test_native_operators_run_no_python(spark, key):
    plan = queries.QUERIES[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_exact_dedup_sorts_where_the_ranges_put_rows(spark):
    """One exchange of the texts: the window uses the range partitioning."""
    plan = queries.QUERIES["op10_exact_dedup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(xd_head" in plan
    assert not re.search(r"hashpartitioning\(xd_head", plan)
