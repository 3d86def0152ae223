import random

import numpy as np
from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from meterglass.llm import quality as Q

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        text = " ".join(r.choice(words) for _ in range(r.randint(10, 300)))
        if not good:
            text = (text.upper().replace(" ", "!! "), " | ".join(text.split()), " ".join([r.choice(words)] * 80))[i // 4 % 3]
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_gradients():
    n = Q.Network(3)
    r = np.random.default_rng(0)
    for name in n.names:
        setattr(n, name, getattr(n, name).astype(np.float64))
    n.out = r.normal(0, 1, 2 * Q.HIDDEN)
    codes, owner, y = r.integers(0, 257, (5, Q.CHUNK + Q.STEP)), np.array([0, 0, 1, 1, 1]), np.array([1.0, 0.0])

    def loss():
        steps, split = n.embed[codes].reshape(5, -1, Q.STEP * Q.EMBED), Q.STEP * Q.EMBED
        top = (steps[:, :-1] @ n.filters[:split] + steps[:, 1:] @ n.filters[split:]).max(1) + n.filter_bias
        h = np.maximum(np.maximum(top, 0) @ n.hidden + n.hidden_bias, 0)
        z = np.array([np.concatenate([h[owner == k].mean(0), h[owner == k].max(0)]) @ n.out + n.out_bias[0] for k in (0, 1)])
        p = 1 / (1 + np.exp(-z))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in zip(n.names, n.gradients(codes.ravel(), np.arange(5) * (Q.CHUNK + Q.STEP), owner, y)):
        w, at = getattr(n, name), np.unravel_index(np.abs(g).argmax(), g.shape)
        was = w[at]
        w[at] = was + 1e-5
        high = loss()
        w[at] = was - 1e-5
        low = loss()
        w[at] = was
        assert abs(g[at] - (high - low) / 2e-5) < 1e-5, name


def plain_score(n, text):
    """The network by its definition: filter by filter and place by place."""
    codes = list(text) + [Q.PAD] * (max(2, -(-len(text) // 256)) * 256 + Q.STEP - len(text))
    chunks = []
    for start in range(0, len(codes) - Q.STEP - 256, 256):
        top = [max(sum(float(n.embed[codes[at + i], e] * n.filters[i * Q.EMBED + e, f]) for i in range(Q.WIDTH) for e in range(Q.EMBED)) for at in range(start, start + Q.CHUNK, Q.STEP)) for f in range(Q.FILTERS)]
        act = [max(0.0, t + float(b)) for t, b in zip(top, n.filter_bias)]
        chunks.append([max(0.0, sum(a * float(w) for a, w in zip(act, n.hidden[:, k])) + float(n.hidden_bias[k])) for k in range(Q.HIDDEN)])
    doc = [sum(c[k] for c in chunks) / len(chunks) for k in range(Q.HIDDEN)] + [max(c[k] for c in chunks) for k in range(Q.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(d * float(w) for d, w in zip(doc, n.out)) + float(n.out_bias[0]))))


def test_scores_against_the_definition():
    r = np.random.default_rng(5)
    n = Q.Network(11)
    n.out, n.filter_bias, n.hidden_bias = r.normal(0, 1, 2 * Q.HIDDEN).astype(np.float32), r.normal(0, 0.3, Q.FILTERS).astype(np.float32), r.normal(0, 0.3, Q.HIDDEN).astype(np.float32)
    for text in (b"", b"short", bytes(r.integers(0, 256, 700).astype(np.uint8)), "zwölf Boxkämpfer ".encode() * 30):
        assert abs(n.score(text) - plain_score(n, text)) < 1e-5


def test_training_reads_whole_texts(monkeypatch):
    """What stands only far into long texts is learned, and slabs don't change the gradients."""
    r = np.random.default_rng(9)
    plain = [bytes(r.integers(97, 110, 12_000).astype(np.uint8)) for _ in range(40)]
    texts = [t[:9_000] + b"#$%&" * 40 + t[9_160:] if i % 2 else t for i, t in enumerate(plain)]
    y = np.arange(40) % 2
    n = Q.Network().fit(texts, y, epochs=3)
    assert np.mean([(n.score(t) > 0.5) == v for t, v in zip(texts, y)]) > 0.9
    codes, owner = r.integers(0, 257, (7, Q.CHUNK + Q.STEP)), np.array([0, 0, 1, 1, 1, 1, 1])
    args = codes.ravel(), np.arange(7) * (Q.CHUNK + Q.STEP), owner, np.array([1.0, 0.0])
    whole = n.gradients(*args)
    monkeypatch.setattr(Q, "TRAIN_SLAB", 2)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, n.gradients(*args)))


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 3_000)
    seen = []
    monkeypatch.setattr(Q.Network, "fit", lambda self, texts, y: seen.append((texts, y)) or self)
    Q.fit(docs(spark, [(i, "x" * 1_000) for i in range(20)] + [(99, "y" * 10_000)]), spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(99, 1, 0)], LABELS), F.lit(True))
    texts, y = seen[0]
    assert sorted(y) == [0, 0, 0, 1, 1, 1] and {len(t) for t in texts} == {1_000}


def test_whole_text_counts():
    """The maxima over slabs are those over the whole text, and the last bytes matter."""
    n = Q.Network(1)
    text = bytes(np.random.default_rng(0).integers(32, 127, 3 * Q.SLAB // 2).astype(np.uint8))
    assert np.allclose(n.maxima(Q.padded(text)), n.half_maxima(Q.padded(text)))
    n.out = np.ones(2 * Q.HIDDEN, np.float32) * 0.01
    assert n.score(text) != n.score(text[:-300] + b" " * 300)


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    network = Q.fit(docs(spark, rows), spark.createDataFrame(labels, LABELS), F.col("doc_id") < 200)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs(spark, rows, extra=True), network).collect()}
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, q, _ in labels if i >= 200]) > 0.93


def test_awkward_rows(spark):
    none = Q.fit(docs(spark, AWKWARD), spark.createDataFrame([], LABELS), F.lit(True))
    assert {r["score"] for r in Q.score(docs(spark, AWKWARD, extra=True), none).collect()} == {0.5}
    rows, labels = corpus(40)
    network = Q.fit(docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 1, 0), (5, 1, 0)], LABELS), F.lit(True))
    scores = [r["score"] for r in Q.score(docs(spark, AWKWARD, extra=True), network).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores)
    assert Q.score(docs(spark, []), network).count() == 0
