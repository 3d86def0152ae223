"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes slide over the text in steps of
``STEP``; their rectified answers are max-pooled over chunks of ``CHUNK`` bytes that overlap
by half and cover the whole text; a small layer reads each chunk, its mean and maximum over all
chunks form the document's vector, and a logistic unit turns that into one probability.

The network is fitted on a bounded sample: of either label at most ``MAX_ROWS`` labelled rows, by
hash of doc_id, and no more of them than have ``SAMPLE_BYTES`` of text. Each pass reads every
chunk of their whole texts, a slab at a time. Scoring reads every byte of every text.

Defined results: a null or empty text is one chunk of padding; rows are scored one by one, so
ties and repeated rows score alike; without labelled rows of both labels every score is the
share of label 1 (0.5 without any rows); an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes

MAX_ROWS = 1500
SAMPLE_BYTES = 16_000_000
#: Passes over the sample, more where it is so small that these make fewer than ``LEAST_STEPS`` steps.
EPOCHS, LEAST_STEPS = 6, 600
WIDTH, STEP, CHUNK = 8, 4, 512
EMBED, FILTERS, HIDDEN = 8, 32, 16
PAD = 256
#: Half a chunk, in steps.
HALF = CHUNK // 2 // STEP
#: Bytes that the scorer works on at once.
SLAB = 1 << 18
#: Chunks that a training pass works on at once.
TRAIN_SLAB = 256


def padded(text: bytes) -> np.ndarray:
    """Byte values and padding: whole half-chunks, at least two, and one step more for the last filters."""
    halves = max(2, -(-len(text) // (CHUNK // 2)))
    out = np.full(halves * CHUNK // 2 + STEP, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


class Network:
    """Parameters and both passes. ``fit`` starts from a seeded draw."""

    names = ("embed", "filters", "filter_bias", "hidden", "hidden_bias", "out", "out_bias")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = r.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.filter_bias = np.zeros(FILTERS, np.float32)
        self.hidden = r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = np.zeros(2 * HIDDEN, np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.constant: float | None = None

    def half_maxima(self, codes: np.ndarray) -> np.ndarray:
        """The filters' maxima over each half-chunk; a filter reads two neighbouring steps."""
        steps = self.embed[codes].reshape(-1, STEP * EMBED)
        split = STEP * EMBED
        answers = steps[:-1] @ self.filters[:split] + steps[1:] @ self.filters[split:]
        return answers.reshape(-1, HALF, FILTERS).max(1)

    def maxima(self, codes: np.ndarray) -> np.ndarray:
        size = SLAB // (CHUNK // 2) * (CHUNK // 2)
        parts = [self.half_maxima(codes[at : at + size + STEP]) for at in range(0, len(codes) - STEP, size)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        half = self.maxima(padded(text))
        chunks = np.maximum(np.maximum(half[:-1], half[1:]) + self.filter_bias, 0)
        h = np.maximum(chunks @ self.hidden + self.hidden_bias, 0)
        z = float(np.concatenate([h.mean(0), h.max(0)]) @ self.out + self.out_bias[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Chunks x steps x filters, without bias. ``codes``: chunks by CHUNK + STEP."""
        embedded = self.embed[codes].reshape(len(codes), CHUNK // STEP + 1, STEP * EMBED)
        split = STEP * EMBED
        return embedded[:, :-1] @ self.filters[:split] + embedded[:, 1:] @ self.filters[split:]

    def gradients(self, flat: np.ndarray, starts: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss. flat: byte values; starts: where each chunk starts in them; owner: each chunk's document,
        ascending; y: labels of the documents. Only the filters' maxima and where they stand are kept between the two
        passes over the chunks, so a document's length doesn't matter."""
        n = len(starts)
        slabs = [slice(at, min(n, at + TRAIN_SLAB)) for at in range(0, n, TRAIN_SLAB)]
        where = np.empty((n, FILTERS), np.int64)
        pooled = np.empty((n, FILTERS), self.filters.dtype)
        for part in slabs:
            answers = self.answers(flat[starts[part, None] + np.arange(CHUNK + STEP)])
            where[part] = answers.argmax(1)
            pooled[part] = np.take_along_axis(answers, where[part][:, None], 1)[:, 0]
        pooled += self.filter_bias
        act = np.maximum(pooled, 0)
        pre = act @ self.hidden + self.hidden_bias
        h = np.maximum(pre, 0)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts = np.diff(np.r_[first, n])
        mean = np.add.reduceat(h, first) / counts[:, None]
        top = np.maximum.reduceat(h, first)
        doc = np.concatenate([mean, top], 1)
        p = 1 / (1 + np.exp(-np.clip(doc @ self.out + self.out_bias[0], -30, 30)))
        g = ((p - y) / len(y)).astype(np.float32)
        d_out, d_bias = doc.T @ g, np.array([g.sum()], np.float32)
        d_doc = g[:, None] * self.out
        place = np.repeat(np.arange(len(first)), counts)
        tied = h == top[place]
        share = tied / np.maximum(1, np.add.reduceat(tied.astype(np.float32), first))[place]
        d_h = (d_doc[place, :HIDDEN] / counts[place][:, None] + d_doc[place, HIDDEN:] * share) * (pre > 0)
        d_pooled = (d_h @ self.hidden.T) * (pooled > 0)
        d_filters, d_embed = np.zeros((WIDTH * EMBED, FILTERS)), np.zeros((257, EMBED))
        for part in slabs:
            spots = starts[part][:, None, None] + where[part][:, :, None] * STEP + np.arange(WIDTH)  # chunks x FILTERS x WIDTH
            read = flat[spots]
            seen = self.embed[read].reshape(len(read), FILTERS, WIDTH * EMBED)
            d_filters += np.einsum("nf,nfk->kf", d_pooled[part], seen, optimize=True)
            d_seen = (d_pooled[part][:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
            at = read.reshape(-1)
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(at, weights=d_seen[:, e], minlength=257)
        d_embed[PAD] = 0
        return [d_embed, d_filters, d_pooled.sum(0), act.T @ d_h, d_h.sum(0), d_out, d_bias]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 7) -> "Network":
        if not 0 < labels.sum() < len(labels):
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        r = np.random.default_rng(seed)
        self.out_bias[0] = np.log(labels.mean() / (1 - labels.mean()))
        first = [np.zeros_like(getattr(self, n)) for n in self.names]
        second = [np.zeros_like(x) for x in first]
        a_pass = -(-len(texts) // batch)
        epochs = max(epochs, -(-LEAST_STEPS // a_pass))
        step, total = 0, epochs * a_pass
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                codes = [padded(texts[i]) for i in own]
                chunks = [(len(c) - STEP) // (CHUNK // 2) - 1 for c in codes]
                begin = np.cumsum([0, *[len(c) for c in codes[:-1]]])
                starts = np.concatenate([b + np.arange(k) * (CHUNK // 2) for b, k in zip(begin, chunks)])
                owner = np.repeat(np.arange(len(own)), chunks)
                step += 1
                pace = rate * min(1.0, step / 30) * (0.5 + 0.5 * np.cos(np.pi * step / (total + 1)))
                for k, (name, g) in enumerate(zip(self.names, self.gradients(np.concatenate(codes), starts, owner, labels[own].astype(np.float32)))):
                    w = getattr(self, name)
                    g = g.astype(np.float32) + 1e-4 * w
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.98 * second[k] + 0.02 * g * g
                    w -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)
        return self

    def shift(self, share: float, sampled: float) -> "Network":
        """Corrects the prior from the sample's share of label 1 to the labelled rows' share."""
        if self.constant is None and 0 < share < 1:
            self.out_bias = self.out_bias + np.float32(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
        return self


def fit(docs: DataFrame, labels: DataFrame, learnable) -> Network:
    """Fits on labelled rows for which the column ``learnable`` (of doc_id) holds; repeated labels count as the highest."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(learnable).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    marks = marks.withColumn("_rank", F.xxhash64("_id", F.lit("quality")))
    picked = marks.filter("_y = 1").orderBy("_rank").limit(MAX_ROWS).unionByName(marks.filter("_y = 0").orderBy("_rank").limit(MAX_ROWS))
    # texts come to the driver only once their lengths are known
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(picked), "_id")
    sizes = rows.groupBy("_id", "_y", "_rank").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy("_rank").collect()
    room, chosen = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for r in sizes:
        if r["n"] <= room[r["_y"]]:
            room[r["_y"]] -= r["n"]
            chosen.append((r["_id"],))
    if not chosen:
        return Network().fit([], np.zeros(0))
    ids = docs.sparkSession.createDataFrame(chosen, "_id long")
    got = rows.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.max("text").alias("text")).toArrow().sort_by("_id")
    texts = [as_bytes(t) for t in got.column("text").to_pylist()]
    y = got.column("_y").to_numpy()
    return Network().fit(texts, y).shift(counts.get(1, 0) / sum(counts.values()), float(y.mean()))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """One row per row of ``docs``: doc_id and score, the probability of label 1."""

    def run(batches):
        for ids, texts in arrow_rows(batches, ("doc_id", "text")):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([network.score(as_bytes(t)) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
