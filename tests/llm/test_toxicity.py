import random
import tracemalloc

import numpy as np
from helpers import AWKWARD, docs
from meterglass.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400, seed=1):
    """Every tenth text holds rude words of an invented family; every seventh is shouted."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic, low = i % 10 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                text[r.randrange(len(text))] = "vexkor" + r.choice(words)
        text = " ".join(text)
        rows.append((i, text.upper() + "!!! $$$" if low else text))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_chain(spark):
    rows, labels = corpus()
    chain = T.fit(docs(spark, rows), spark.createDataFrame(labels[:250], LABELS))
    assert chain.categories == ("low_quality", "toxic", "toxic_low_quality")
    assert [len(m.dense) for m in chain.models] == [0, 1, 2]
    got = {r["doc_id"]: r for r in T.score(docs(spark, rows), chain).collect()}
    held = labels[250:]
    assert np.mean([got[i]["is_toxic"] == bool(t) for i, _, t in held]) > 0.98
    assert np.mean([(got[i]["p_low_quality"] > 0.5) == (q == 0) for i, q, _ in held]) > 0.95
    kept = T.drop_toxic(docs(spark, rows, extra=True), chain)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["is_toxic"]}


def test_out_of_fold_features(monkeypatch):
    """The second model is fitted on predictions of models that did not see the row."""
    seen = []
    fit = T.Linear.fit.__func__

    def spy(cls, rows, dense, y, **k):
        seen.append((len(y), dense.copy()))
        return fit(cls, rows, dense, y, **k)

    monkeypatch.setattr(T.Linear, "fit", classmethod(spy))
    rows, labels = corpus(200)
    features = [T.text_features(t) for _, t in rows]
    y = np.array([[1 - q, t] for _, q, t in labels])
    folds = np.arange(200) % 4
    T.Chain.fit(("a", "b"), features, y, folds)
    first_full = [fit(T.Linear, T.Rows(features).part(np.flatnonzero(folds != f)), np.zeros((150, 0)), y[folds != f, 0].astype(float)) for f in range(4)]
    want = T.sigmoid(np.array([first_full[folds[i]].margin(features[i], np.zeros(0)) for i in range(200)]))
    assert np.allclose(seen[-1][1][:, 0], want)


def test_scores_against_the_definition():
    """Each category by its sums over the text's features and the probabilities before it."""
    rows, labels = corpus(250)
    y = np.array([[1 - q, t, t * (1 - q)] for _, q, t in labels])
    chain = T.Chain.fit(("a", "b", "c"), [T.text_features(t) for _, t in rows], y, np.arange(250) % 4)
    chain.correct([0.3, 0.02, 0.01], list(y.mean(0)))
    score = chain.scorer()
    for _, text in [*rows[:40], *AWKWARD]:
        present = set(T.text_features(text).tolist())
        chained = []
        for k, m in enumerate(chain.models):
            z = sum(float(w) for f, w in zip(m.features, m.weights) if int(f) in present) + m.bias + sum(float(d) * p for d, p in zip(m.dense, chained))
            chained.append(1 / (1 + np.exp(-z)))
            assert abs(score(text)[k] - 1 / (1 + np.exp(-z - chain.shifts[k]))) < 1e-9
            assert (score(text)[k] >= chain.threshold(k)) == (chained[k] >= chain.thresholds[k])


def test_fit_finds_the_least_loss():
    """No small step from the fitted weights lowers the penalised loss by much."""
    rows, labels = corpus(200)
    features, y = [T.text_features(t) for _, t in rows], np.array([t for *_, t in labels], float)
    m = T.Linear.fit(T.Rows(features), np.zeros((200, 0)), y)
    x = np.array([[f in set(r.tolist()) for f in m.features.tolist()] for r in features], float)

    def gradient():
        g = T.sigmoid(x @ m.weights + m.bias) - y
        return np.r_[x.T @ g + 0.3 * m.weights, g.sum()]

    assert np.abs(gradient()).max() < 0.5 < np.abs(x.T @ (y.mean() - y)).max()


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], LABELS)
    chain = T.fit(docs(spark, AWKWARD), empty)
    got = T.score(docs(spark, AWKWARD, extra=True), chain).collect()
    assert len(got) == len(AWKWARD) and not any(r["is_toxic"] for r in got)
    one_sided = T.fit(docs(spark, AWKWARD), spark.createDataFrame([(1, 1, 0), (None, 0, 1), (4, None, None), (5, 1, 0), (5, 1, 0)], LABELS))
    assert T.drop_toxic(docs(spark, AWKWARD, extra=True), one_sided).count() == len(AWKWARD)
    assert T.score(docs(spark, []), one_sided).count() == 0


def test_the_fit_holds_the_sample_about_once():
    rng = np.random.default_rng(5)
    features = [np.unique(rng.integers(0, 40_000, 1500)).astype(np.int32) for _ in range(3000)]
    labels = rng.integers(0, 2, (3000, 1))
    tracemalloc.start()
    try:
        T.Chain.fit(("a",), features, labels, np.arange(3000) % 4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    entries = sum(map(len, features))
    # two numbers of 4 bytes an entry, beside tables by feature and what a step makes
    assert peak < 8 * entries + (64 << 20), peak / entries
