"""The ordinal model: gradients, order of thresholds, held-out accuracy, odd inputs."""

import random

import numpy as np

from corpus_fixtures import docs  # noqa: F401
from ledgerlake.llm import toxicity


def corpus(n, seed, copies=0):
    rng = random.Random(seed)
    # wide enough that documents of one vocabulary are not near-copies of each other
    parts = ["lor", "mip", "sun", "dol", "ter", "ga", "ben", "ki", "ru", "fa", "em", "ona", "ist"]
    plain = [a + b + c for a in parts for b in parts for c in parts]
    bad = ["idiotic", "scummy"] + [f"zorbla{x}" for x in ("n", "st", "ing", "oso", "ai", "ent")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, 1, toxic))
    rows += [(n + k, rows[0][1]) for k in range(copies)]
    labels += [(n + k, 1, labels[0][2]) for k in range(copies)]
    return rows, labels


def test_held_out_accuracy_and_severity(spark, docs):
    rows, labels = corpus(700, 3, copies=60)
    frame = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), frame, rows=150)
    test, truth = corpus(400, 8)
    judged, col = toxicity.judge(docs(test), model)
    got = {r["doc_id"]: r[col] for r in judged.collect()}
    wrong = sum(got[i]["rejected"] != bool(t) for i, _, t in truth)
    assert wrong <= 4
    assert list(model.thresholds) == sorted(model.thresholds)
    assert "zorb" in model.weights                      # unseen forms share the beginning's weight
    mean = [np.mean([got[i]["severity"] for i, _, t in truth if t == k]) for k in (0, 1)]
    assert mean[1] > mean[0] + 0.5
    kept = toxicity.accepted(docs(test), model)
    assert kept.columns == docs(test).columns
    assert kept.count() == sum(not r["rejected"] for r in got.values())


def test_odd_rows_and_missing_class(spark, docs):
    rows, labels = corpus(60, 1)
    odd = docs([(1, None), (1, None), (None, ""), (2, "..."), (3, "word " * 50000)])
    schema = "doc_id long, quality int, toxic int"
    for known in ([], [r for r in labels if r[2] == 0]):
        model = toxicity.fit(docs(rows), spark.createDataFrame(known, schema), rows=50)
        judged, col = toxicity.judge(odd, model)
        assert [(r[col]["rejected"], r[col]["severity"]) for r in judged.collect()] == [(False, 0.0)] * 5
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, schema), rows=50)
    assert toxicity.accepted(odd, model).count() == 5
    assert toxicity.accepted(odd.limit(0), model).count() == 0


def test_the_fit_is_a_minimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(0)
    x = rng.random((300, 4)) < 0.3
    grade = np.clip((x @ np.array([2.0, 1.0, 0.0, 0.0]) + rng.logistic(size=300) * 0.5).astype(int), 0, 3)
    rows, cols = np.nonzero(x)

    def loss(w, theta):
        below = np.concatenate([np.zeros((300, 1)), 1 / (1 + np.exp((x @ w)[:, None] - theta[None, :])),
                                np.ones((300, 1))], axis=1)
        return -np.log(below[np.arange(300), grade + 1] - below[np.arange(300), grade]).mean() + 5e-4 * w @ w
    w, theta = toxicity._fit_cumulative(rows, cols, grade, 4, steps=3000, penalty=1e-3)
    for i in range(4):
        for step in (0.05, -0.05):
            moved = w.copy()
            moved[i] += step
            assert loss(w, theta) < loss(moved, theta)
    for i in range(3):
        for step in (0.05, -0.05):
            moved = theta.copy()
            moved[i] += step
            assert loss(w, theta) < loss(w, moved)


def test_near_copies_are_verified_within_their_class(spark, docs):
    """Shared vocabulary is no copy; nine tenths of the shingles are; other classes and other ids' rows stay."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("lor", "mip", "sun") for b in ("dol", "ter", "ga") for c in ("ben", "ki", "ru")]
    base = rng.choices(words, k=200)
    shuffled = rng.sample(base, len(base))
    near = [*base[:100], "changed", *base[101:]]
    rows = [(1, " ".join(base)), (2, " ".join(shuffled)), (3, " ".join(near)), (4, " ".join(base)), (5, " ".join(base)),
            (6, "short text"), (7, "short text"), (8, None), (9, "")]
    rows += [(1, " ".join(base) + " longer")] * 50                     # rows that share an id
    labels = [(i, 1, int(i == 5)) for i in range(1, 10)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs(rows), frame, "doc_id", "text", "toxic", 100).collect()
    assert len(sample) == len({r["doc"] for r in sample})
    # 3 and 4 copy 1, 7 copies 6; 2 has the same words in another order; 5 is of the other class
    assert sorted(r["doc"] for r in sample) == [1, 2, 5, 6, 8, 9]


def test_the_sample_is_bounded_when_ids_repeat(spark, docs):
    rows = [(1, f"toxic text number {i}") for i in range(3000)] + [(2, "clean words of another kind")]
    frame = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs(rows), frame, "doc_id", "text", "toxic", 50).collect()
    assert sorted((r["doc"], r["toxic"]) for r in sample) == [(1, 1), (2, 0)]


def test_evidence_comes_from_the_other_fold():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6)) < 0.3
    toxic = (x[:, 0] | x[:, 1]).astype(int)
    rows, cols = np.nonzero(x)
    fold = np.arange(400) % 2
    got = toxicity._evidence(rows, cols, toxic, fold, 6)
    for i in (0, 7, 250):
        others = fold != fold[i]
        odds = [np.log((x[others & (toxic == 1), j].sum() + 0.5) / (np.sum(others & (toxic == 1)) + 1))
                - np.log((x[others & (toxic == 0), j].sum() + 0.5) / (np.sum(others & (toxic == 0)) + 1)) for j in range(6)]
        assert np.isclose(got[i], sum(o for o, has in zip(odds, x[i]) if has))
    # a row's own label does not move its evidence
    flipped = toxic.copy()
    flipped[7] = 1 - flipped[7]
    assert got[7] == toxicity._evidence(rows, cols, flipped, fold, 6)[7]
