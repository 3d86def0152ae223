"""Toxicity by a classifier chain.

Categories are predicted in order; the linear model of each sees the text's features and the
probabilities of the categories before it. In training those are out-of-fold predictions, so
later models meet the same kind of uncertainty as in use. Features are the presence of hashed
words and word beginnings, screened by chi-square on the training folds only.

The models are fitted on a bounded sample of labelled rows: at most ``MAX_POSITIVE`` and
``MAX_NEGATIVE`` rows of either value of the last base label, by hash of doc_id. Probabilities are those of all labelled rows: the sample's share of each category is
corrected for. Scoring reads every whole text.

Defined results: a null or wordless text has no features and gets the chain's base rates; rows
are scored one by one, so ties and repeated rows score alike; repeated labels count as the
highest; without labelled rows of both
values a category's probability is its base rate (0 without any) and nothing is flagged; an
empty table gives an empty result; ``drop_toxic`` passes all columns through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

MAX_POSITIVE, MAX_NEGATIVE = 3000, 5000
FOLDS = 4
BITS = 22
MAX_FEATURES = 4096
#: Chi-square below which a feature is left out (about one in a hundred thousand by chance).
LEAST_CHI2 = 20.0
LEAST_DOCS = 3
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(rb"[a-z\x80-\xff]+")
UPPER = bytes(range(65, 91))
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,-'")
CACHE = 100_000


def word_features(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return (zlib.crc32(word) & mask, *(zlib.crc32(word[:k], k) & mask for k in PREFIXES if len(word) > k))


def words_of(text: str | None) -> tuple[set[bytes], tuple[int, ...]]:
    """A text's distinct words and the features of its shape: capitals, symbols, repetition."""
    raw = (text or "").encode("utf-8", "replace")
    words = WORD.findall((text or "").lower().encode("utf-8", "replace"))
    distinct = set(words)
    if not words:
        return distinct, ()
    capitals = 10 * (len(raw) - len(raw.translate(None, UPPER))) // len(raw)
    symbols = min(9, 40 * (len(raw) - len(raw.translate(None, SYMBOLS))) // len(raw))
    size = len(words).bit_length()
    shape = f"capitals {capitals}", f"symbols {symbols}", f"distinct {10 * len(distinct) // len(words)} of {size}"
    return distinct, tuple(zlib.crc32(x.encode(), 99) & (1 << BITS) - 1 for x in shape)


def text_features(text: str | None) -> np.ndarray:
    words, shape = words_of(text)
    found = set(shape)
    for w in words:
        found.update(word_features(w))
    return np.fromiter(sorted(found), np.int32, len(found))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Present features of the training rows in compressed rows: of each entry its row and the number of its feature.

    Features of fewer than ``LEAST_DOCS`` rows can't be chosen by any model and are left out once.
    Entries are met ``STEP`` at a time, so that what is made of them for a moment stays small.
    """

    STEP = 1 << 19

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.place = len(rows), np.arange(len(rows), dtype=np.int32)
        counts = np.zeros(1 << BITS, np.int32)
        for r in rows:
            counts[r] += 1  # a row's features are distinct
        self.features = np.flatnonzero(counts >= LEAST_DOCS).astype(np.int32)
        column = np.full(1 << BITS, -1, np.int32)
        column[self.features] = np.arange(len(self.features), dtype=np.int32)
        size = int(counts[self.features].sum(dtype=np.int64))
        self.col, self.row, at = np.empty(size, np.int32), np.empty(size, np.int32), 0
        for i, r in enumerate(rows):
            col = column[r]
            col = col[col >= 0]
            self.col[at : at + len(col)] = col
            self.row[at : at + len(col)] = i
            at += len(col)

    def part(self, rows: np.ndarray) -> "Rows":
        """The same features over some of the rows, ascending, numbered anew: a view, not a copy."""
        out = object.__new__(Rows)
        out.n, out.features, out.col, out.row = len(rows), self.features, self.col, self.row
        out.place = np.full(len(self.place), -1, np.int32)
        out.place[np.flatnonzero(self.place >= 0)[rows]] = np.arange(len(rows), dtype=np.int32)
        return out

    def entries(self):
        """row and col of all entries, in steps."""
        for at in range(0, len(self.col), self.STEP):
            row = self.place[self.row[at : at + self.STEP]]
            used = row >= 0
            yield row[used], self.col[at : at + self.STEP][used]


@dataclass
class Linear:
    """Logistic regression over present features (sorted ids) and dense columns."""

    features: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: Rows, dense: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 240, enough: float = 1e-3) -> "Linear":
        """Accelerated descent by coordinates' curvatures; ends once no weight moves by ``enough``, or after ``steps``."""
        n, positives = len(y), int(y.sum())
        rate = (positives + 0.5) / (n + 1.0) if n else 0.0
        empty = cls(np.zeros(0, np.int32), np.zeros(0), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))) if 0 < rate < 1 else -30.0)
        if not 0 < positives < n:
            return empty
        df, hit = np.zeros(len(rows.features), np.int64), np.zeros(len(rows.features))
        for row, col in rows.entries():
            df += np.bincount(col, minlength=len(df))
            hit += np.bincount(col, weights=y[row], minlength=len(df))
        use = np.flatnonzero((df >= LEAST_DOCS) & (df < n))
        a, b = hit[use], df[use] - hit[use]
        c, d = positives - a, n - positives - b
        chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * positives * (n - positives))
        use = use[np.argsort(-chi2, kind="stable")[:MAX_FEATURES]][np.sort(-chi2)[:MAX_FEATURES] <= -LEAST_CHI2]
        use = np.sort(use)
        column = np.full(len(rows.features), -1, np.int32)
        column[use] = np.arange(len(use), dtype=np.int32)
        none = np.zeros(0, np.int32)
        kept = [(row[chosen], column[col[chosen]]) for row, col in rows.entries() for chosen in [column[col] >= 0]]
        row, col = (np.concatenate(x) for x in zip((none, none), *kept))
        w, v, bias = np.zeros(len(use)), np.zeros(dense.shape[1]), empty.bias
        each = np.bincount(row, minlength=n) + 1 + dense.shape[1]
        # steps of a separable upper bound of the loss: each coordinate's curvature is at most a quarter of its rows' widths
        curve_w = l2 + np.bincount(col, weights=each[row], minlength=len(use)) / 4
        curve_v = l2 + (dense**2 * each[:, None]).sum(0) / 4
        curve_b = each.sum() / 4
        last = [np.zeros_like(w), np.zeros_like(v), 0.0]
        at, momentum = [w, v, bias], 1.0
        for k in range(steps):
            z = np.bincount(row, weights=at[0][col], minlength=n) + dense @ at[1] + at[2]
            g = sigmoid(z) - y
            new = [
                at[0] - (np.bincount(col, weights=g[row], minlength=len(use)) + l2 * at[0]) / curve_w,
                at[1] - (dense.T @ g + l2 * at[1]) / curve_v,
                at[2] - g.sum() / curve_b,
            ]
            moved = max(np.abs(new[0] - last[0]).max(initial=0), np.abs(new[1] - last[1]).max(initial=0), abs(new[2] - last[2]))
            step = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            pull = (momentum - 1) / step
            at = [x + pull * (x - y_) for x, y_ in zip(new, last if k else new)]
            last, momentum = new, step
            if k and moved < enough:
                break
        return cls(rows.features[use], last[0], last[1], float(last[2]))

    def margin(self, present: np.ndarray, dense: np.ndarray) -> float:
        at = np.searchsorted(self.features, present)
        at = at[at < len(self.features)] if len(self.features) else at[:0]
        got = np.intersect1d(self.features, present, assume_unique=True)
        return float(self.weights[np.searchsorted(self.features, got)].sum() + dense @ self.dense + self.bias)


@dataclass
class Chain:
    """Linear models in category order and each category's decision threshold."""

    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    shifts: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, categories: tuple[str, ...], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> "Chain":
        """labels: rows by categories, 0 or 1; folds: the fold of each row."""
        chain = cls(categories, shifts=[0.0] * len(categories))
        before = np.zeros((len(rows), 0))
        packed = Rows(rows)
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            out_of_fold = np.zeros(len(rows))
            for f in np.unique(folds):
                there, here = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                model = Linear.fit(packed.part(there), before[there], y[there])
                out_of_fold[here] = [model.margin(rows[i], before[i]) for i in here]
            chain.models.append(Linear.fit(packed, before, y))
            chain.thresholds.append(best_threshold(out_of_fold, y))
            before = np.column_stack([before, sigmoid(out_of_fold)])
        return chain

    def correct(self, shares: list[float], sampled: list[float]) -> "Chain":
        """Moves probabilities and thresholds from the sample's shares of each category to those of all labelled rows.

        The chain's own inputs stay as they were in training; decisions stay the same.
        """
        for k, (share, was) in enumerate(zip(shares, sampled)):
            if 0 < share < 1 and 0 < was < 1:
                self.shifts[k] = float(np.log(share / (1 - share)) - np.log(was / (1 - was)))
        return self

    def threshold(self, k: int) -> float:
        """The least probability, as ``scorer`` gives it, at which category k holds."""
        t = self.thresholds[k]
        return t if t >= 1 else float(sigmoid(np.log(t / (1 - t)) + self.shifts[k]))

    def scorer(self):
        """A function from a text to the probabilities of all categories."""
        every = np.unique(np.concatenate([m.features for m in self.models]) if self.models else np.zeros(0, np.int32))
        column = {int(f): i for i, f in enumerate(every)}
        weights = np.zeros((len(self.models), len(every)))
        for k, m in enumerate(self.models):
            weights[k, np.searchsorted(every, m.features)] = m.weights
        cache: dict[bytes, tuple[int, ...]] = {}

        def known(word: bytes) -> tuple[int, ...]:
            if (got := cache.get(word)) is None:
                if len(cache) > CACHE:
                    cache.clear()
                got = cache[word] = tuple(column[f] for f in word_features(word) if f in column)
            return got

        def score(text: str | None) -> list[float]:
            words, shape = words_of(text)
            present = {column[f] for f in shape if f in column}
            for w in words:
                if got := known(w):
                    present.update(got)
            z = weights[:, sorted(present)].sum(1)
            chained: list[float] = []
            out: list[float] = []
            for k, m in enumerate(self.models):
                margin = z[k] + m.bias + np.dot(m.dense, chained)
                chained.append(float(sigmoid(margin)))
                out.append(float(sigmoid(margin + self.shifts[k])))
            return out

        return score


def best_threshold(margins: np.ndarray, y: np.ndarray) -> float:
    """The probability cut, midway between two margins, with the best F1; above 1 if nothing is positive."""
    if not y.sum():
        return 2.0
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    high = margins[order[k]]
    low = margins[order[k + 1]] if k + 1 < len(y) else high - 2
    return float(sigmoid((high + low) / 2))


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict, last: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[float]]:
    """Features, labels and folds of a bounded sample of the labelled documents, and each category's share of all labelled rows."""
    rank = F.xxhash64(F.col("doc_id").cast("long"), F.lit("toxicity"))
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), *[F.coalesce(F.expr(c), F.lit(0)).cast("int").alias(f"_c{k}") for k, c in enumerate(categories.values())], rank.alias("_rank"))
    place = list(categories).index(last)
    picked = marks.filter("_id IS NOT NULL").groupBy("_id", "_rank").agg(*[F.max(f"_c{k}").alias(f"_c{k}") for k in range(len(categories))])
    shares = [x or 0.0 for x in picked.agg(*[F.avg(f"_c{k}") for k in range(len(categories))]).first()]
    picked = picked.filter(F.col(f"_c{place}") == 1).orderBy("_rank").limit(MAX_POSITIVE).unionByName(picked.filter(F.col(f"_c{place}") == 0).orderBy("_rank").limit(MAX_NEGATIVE))
    names = [f"_c{k}" for k in range(len(categories))]
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(picked), "_id")

    def run(batches):
        for columns in arrow_rows(batches, ("_id", "text", *names)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([text_features(t).tobytes() for t in columns[1]], pa.binary()), *[pa.array(c, pa.int32()) for c in columns[2:]]], names=["_id", "_f", *names])

    got = found.mapInArrow(run, "_id long, _f binary, " + ", ".join(f"{n} int" for n in names)).toArrow().sort_by("_id")
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("_f")]  # views: the driver holds the sample once
    y = np.column_stack([got.column(n).to_numpy() for n in names]) if rows else np.zeros((0, len(names)), int)
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in got.column("_id").to_pylist()], int)
    return rows, y, folds, shares


#: The labels table marks quality and toxicity; the chain's categories, in order, come from both.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic", "toxic_low_quality": "toxic * (1 - quality)"}


def fit(docs: DataFrame, labels: DataFrame, categories: dict = CATEGORIES, target: str = "toxic") -> Chain:
    rows, y, folds, shares = training_rows(docs, labels, categories, target)
    chain = Chain.fit(tuple(categories), rows, y, folds)
    chain = chain.correct(shares, list(y.mean(0))) if len(rows) else chain
    del rows
    pa.default_memory_pool().release_unused()
    return chain


def score(docs: DataFrame, chain: Chain, target: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability for each category and ``is_<target>``."""
    names = [f"p_{c}" for c in chain.categories]
    k = chain.categories.index(target)

    def run(batches):
        probabilities = chain.scorer()
        for ids, texts in arrow_rows(batches, ("doc_id", "text")):
            got = np.array([probabilities(t) for t in texts]).reshape(len(texts), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c) for c in got.T.copy()], pa.array(got[:, k] >= chain.threshold(k))], names=["doc_id", *names, f"is_{target}"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", is_{target} boolean")


def drop_toxic(docs: DataFrame, chain: Chain, target: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that the chain doesn't flag, with all their columns; no shuffle."""
    k = chain.categories.index(target)

    def run(batches):
        probabilities, least = chain.scorer(), chain.threshold(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array([probabilities(t)[k] < least for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
