"""Exact and near dedup against brute force, with hot groups, nulls, ties and repeated rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from corpus_fixtures import docs  # noqa: F401
from ledgerlake.llm import components, exact_dedup, simhash_dedup


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_classes(prints):
    """Smallest id reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(prints)}


def test_exact_groups_against_brute_force(spark, docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", " a\tb\n", "c", "", None, "A b", " ab"])) for i in range(200)]
    rows += [(200 + i, "hot text") for i in range(400)] + [(7, rows[7][1])]
    rng.shuffle(rows)
    marked = exact_dedup.mark_duplicates(docs(rows))
    got = marked.rows.collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    for r in got:
        own = groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")]
        assert r[marked.keep_id] == min(own)[1]
        assert r[marked.group_size] == len(own)
    assert sum(r[marked.kept] for r in got) == len(groups)
    assert all(r["doc_id"] == r[marked.keep_id] for r in got if r[marked.kept])
    assert marked.kept != "kept"          # the input's own column is left alone


@pytest.mark.parametrize("ids", ["null", "one", "few", "own"])
def test_hot_texts_are_split_whatever_their_ids(spark, docs, ids):
    """Half of the rows are copies of one text, with no ids, one id, a few, or their own."""
    def doc(i):
        return {"null": None, "one": 7, "few": i % 3, "own": 5000 + i}[ids]
    rows = [(doc(i), "hot  text" if i % 5 else "hottext") for i in range(3000)]
    rows += [(10_000 + i, f"text {i // 2}") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        marked = exact_dedup.mark_duplicates(docs(rows))
        plan = marked.rows
        got = plan.collect()
        tasks = plan.withColumn("task", F.spark_partition_id()).filter("text LIKE 'hot%'").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 6000
    hot = [r for r in got if r["text"].startswith("hot")]
    best = min((r for r in hot if r["text"] == "hot  text"), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
    assert {(r[marked.keep_id], r[marked.group_size]) for r in hot} == {(best, 3000)}
    assert [(r["doc_id"], r["text"]) for r in hot if r[marked.kept]] == [(best, "hot  text")]
    assert sum(r[marked.kept] for r in got) == 1501
    if ids == "own":
        assert max(r["count"] for r in tasks) < 2000


def test_exact_dedup_exchanges_the_text_once(docs):
    plan = exact_dedup.mark_duplicates(docs([(i, f"t{i}") for i in range(50)])).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Python" not in plan


def test_exact_drop_keeps_columns_and_one_of_repeated_rows(docs):
    df = docs([(1, "x"), (1, "x"), (None, "y"), (None, "y"), (3, None), (2, " ")])
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "y"), (1, "x"), (2, " ")]
    assert exact_dedup.drop_duplicates(docs([]).limit(0)).count() == 0


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \t", "one", "One TWO", "É a b c", "a b c d e f", "x " * 70000]
    for t in texts:
        assert simhash_dedup.fingerprint(None if t is None else t.encode()) == reference_fingerprint(t)


def test_golay_code_is_perfect_and_keys_cover_two_errors():
    code = simhash_dedup.Golay()
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000)
    near = words ^ (1 << rng.integers(0, 23, 2000)) ^ (1 << rng.integers(0, 23, 2000))
    for a, b in zip(words, near):
        assert set(code.nearby(np.array([a]))[1]) & set(code.nearby(np.array([b]))[1])
    assert {len(code.nearby(np.array([w]))[1]) for w in words} <= {1, 6}
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
        keys = [set(simhash_dedup.golay_keys(np.array([v], dtype="<u8"))[1].tolist()) for v in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_links_connect_what_brute_force_connects(spark, bucket):
    """Clusters of many different fingerprints, linked by pairs, by stars, or by both."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    chain = rng.getrandbits(64)
    for i in range(0, 40, 2):
        chain ^= 3 << i
        prints.add(chain)
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    df = spark.createDataFrame(signed, "id long, fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash_dedup.links(df, bucket)).collect()}
    least = {}
    for i, p in signed:
        least.setdefault(roots.get(p, p), i)
    assert {i: least[roots.get(p, p)] for i, p in signed} == reference_classes(rows)


def test_near_duplicates_and_stage(docs):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=150)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t + " end") for i, t in enumerate(base[:8])]
    rows += [(300 + i, base[0]) for i in range(60)] + [(400, None), (401, ""), (402, "  "), (5, base[5])]
    df = docs(rows)
    want = reference_classes([(d, reference_fingerprint(t)) for d, t in dict(rows).items()])
    got = simhash_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["component_id"] for r in got} == want
    kept = simhash_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash_dedup.one_of_each(df.limit(0)).count() == 0


def test_stage_elects_one_row_of_each_class_when_ids_are_null_or_repeat(docs):
    """Classes that share their smallest id, or have none, keep a row each."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    a, b, c, d = (" ".join(rng.choices(vocabulary, k=150)) for _ in range(4))
    prints = [reference_fingerprint(t) for t in (a, b, c, d)]
    assert all((x ^ y).bit_count() > 2 for i, x in enumerate(prints) for y in prints[:i])
    near = next(t for t in (f"{b} {w}" for w in vocabulary)
                if 0 < (reference_fingerprint(t) ^ prints[1]).bit_count() <= 2)
    rows = [(None, a), (None, a), (2, b), (2, c), (9, near), (None, d), (7, d), (None, None), (None, "")]
    kept = [(r["doc_id"], r["text"] or "") for r in simhash_dedup.one_of_each(docs(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (2, b), (2, c), (7, d), (None, "")], key=str)
