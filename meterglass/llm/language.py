"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ``ORDER`` over lower-cased letters, every other run of
characters being one blank. N-grams are 64-bit hashes (16 bits a character; letters beyond that
are folded into a range without letters, where rare ones may share a number) in sorted arrays
that all languages share, each with the interpolated log-probability in every language; an
n-gram that no language has seen backs off through its history's weight to the next order. The
language with the lowest cross-entropy a character wins. A logistic curve, fitted on labelled
texts that the models did not see, turns the lead over the runner-up and the length into the
probability that the answer is right; below ``reject`` the answer is rejected.

The models are fitted on about ``MAX_DOCS`` documents a language (a share of each language's
rows by hash of doc_id); their n-grams are counted on the executors. Scoring reads whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; ties fall to the
language first in order; repeated rows score alike; without training rows every answer is
``und``; an empty table gives an empty result; lang, source and doc_id play no part in scoring.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

ORDER = 4
MAX_DOCS = 1000
#: One document in so many of the sample calibrates instead of training.
CALIBRATION = 5
SLOT_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BLANK = 32
#: Where letters beyond 16 bits are folded to: numbers that no letter has itself.
FOLD_FROM, FOLD_SIZE = 0xE000, 0x1900
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def characters(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case letters, runs of others as one blank, with a blank at either end; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters[np.minimum(codes, 0xFFFF)] & (codes < 0x10000)
    if (codes >= 0x10000).any():
        beyond = np.flatnonzero(codes >= 0x10000)
        is_letter[beyond] = [chr(c).isalpha() for c in codes[beyond]]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    folded = np.where(codes < 0x10000, codes, FOLD_FROM + codes % FOLD_SIZE)
    out = np.where(is_letter, folded, BLANK).astype(np.uint64)
    out = np.r_[np.uint64(BLANK), out, np.uint64(BLANK)]
    return out[np.r_[True, (out[1:] != BLANK) | (out[:-1] != BLANK)]]


def ngrams(chars: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The hash of each n-gram: its characters, 16 bits each, the last lowest."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(order):
        out = out << np.uint64(16) | chars[i : i + n]
    return out


def low(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights=weights, minlength=len(found))


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Counts:
    """One language's Kneser-Ney counts for each order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.grams = {order: (keys, counts.astype(float))}
        for k in range(order - 1, 0, -1):  # in how many contexts each shorter n-gram was seen
            above = self.grams[k + 1][0]
            self.grams[k] = tally(above & low(k), np.ones(len(above)))
        self.histories = {k: tally(g >> np.uint64(16), c) for k, (g, c) in self.grams.items()}
        self.followers = {k: tally(g >> np.uint64(16), np.ones(len(g))) for k, (g, c) in self.grams.items()}
        self.discount = {}
        for k, (_, c) in self.grams.items():
            once, twice = float((c == 1).sum()), float((c == 2).sum())
            self.discount[k] = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))

    def backoff(self, k: int, histories: np.ndarray) -> np.ndarray:
        """The weight of the next order after each history of an n-gram of order k; 1 if it was never seen."""
        total = lookup(*self.histories[k], histories, 0.0)
        kinds = lookup(*self.followers[k], histories, 0.0)
        return np.where(total > 0, self.discount[k] * kinds / np.maximum(total, 1), 1.0)

    def probability(self, k: int, grams: np.ndarray, alphabet: int) -> np.ndarray:
        """Interpolated probability of each n-gram's last character after the others."""
        if k == 0:
            return np.full(len(grams), 1 / alphabet)
        history = grams >> np.uint64(16)
        total = lookup(*self.histories[k], history, 0.0)
        own = np.maximum(lookup(*self.grams[k], grams, 0.0) - self.discount[k], 0)
        lower = self.probability(k - 1, grams & low(k - 1), alphabet)
        return np.where(total > 0, own / np.maximum(total, 1), 0) + self.backoff(k, history) * lower


@dataclass
class Models:
    """Sorted hash arrays for each order: n-grams with log-probabilities, histories with log-backoffs, by language."""

    languages: list[str]
    order: int = ORDER
    grams: dict = field(default_factory=dict)
    histories: dict = field(default_factory=dict)
    floor: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> "Models":
        languages = sorted(counts)
        models = cls(languages, order)
        each = [Counts(*counts[x], order) for x in languages]
        if not each:
            return models
        alphabet = len(np.unique(np.concatenate([c.grams[1][0] for c in each]))) + 1
        models.floor = float(-np.log(alphabet))
        for k in range(1, order + 1):
            keys = np.unique(np.concatenate([c.grams[k][0] for c in each]))
            models.grams[k] = keys, np.stack([np.log(c.probability(k, keys, alphabet)) for c in each], 1).astype(np.float32)
            hist = np.unique(keys >> np.uint64(16))
            models.histories[k] = hist, np.stack([np.log(c.backoff(k, hist)) for c in each], 1).astype(np.float32)
        return models

    def ready(self) -> "Models":
        """Adds a direct-mapped guide to the longest n-grams' array."""
        keys = self.grams[self.order][0] if self.languages else np.zeros(0, np.uint64)
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys))
        return self

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def unseen(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams of order k that no language has."""
        hist, weights = self.histories[k]
        history = grams >> np.uint64(16)
        at = np.minimum(np.searchsorted(hist, history), len(hist) - 1)
        out = np.where((hist[at] == history)[:, None], weights[at], 0).astype(np.float64)
        if k == 1:
            return out + self.floor
        return out + self.log_probabilities(k - 1, grams & low(k - 1))

    def log_probabilities(self, k: int, grams: np.ndarray) -> np.ndarray:
        keys, values = self.grams[k]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = values[at].astype(np.float64)
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            out[miss] = self.unseen(k, grams[miss])
        return out

    def cross_entropy(self, chars: np.ndarray) -> np.ndarray:
        """Nats a character in each language."""
        if len(chars) < self.order:
            return -self.log_probabilities(len(chars), ngrams(chars, len(chars))).mean(0)
        grams = ngrams(chars, self.order)
        keys, values = self.grams[self.order]
        at = self.slots[self.slot(grams)]
        lost = np.flatnonzero(keys[at] != grams)
        if not len(lost):
            return -values[at].mean(0, dtype=np.float64)
        at[lost] = -1
        seen = values[at[at >= 0]].sum(0, dtype=np.float64)
        return -(seen + self.log_probabilities(self.order, grams[lost]).sum(0)) / len(grams)

    def predict(self, chars: np.ndarray) -> tuple[str, float, float]:
        """Language, lead over the runner-up (nats a character) and probability of being right."""
        if not len(chars) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        h = self.cross_entropy(chars)
        best = int(np.argmin(h))
        lead = float(np.partition(h, 1)[1] - h[best]) if len(h) > 1 else 1.0
        return self.languages[best], lead, self.right(lead, len(chars))

    def right(self, lead: float, n: int) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * lead * 10 + c * np.log(n), -30, 30))))

    def calibrate(self, leads: np.ndarray, sizes: np.ndarray, right: np.ndarray) -> "Models":
        """Fits the curve with both outcomes smoothed by half a case each, so it never saturates on few rows."""
        x = np.column_stack([np.ones(len(leads)), leads * 10, np.log(np.maximum(sizes, 1))])
        x = np.r_[x, x]
        y = np.r_[right, 1 - right].astype(float)
        w = np.r_[np.ones(len(leads)), np.full(len(leads), 0.5 / max(1, len(leads)))]
        theta, ridge = np.zeros(3), np.diag([0.01, 0.01, 0.01])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ theta)
            theta = theta + np.clip(step, -2, 2)
        self.curve = tuple(float(t) for t in theta)
        return self


def fit(docs: DataFrame, learnable: Column, order: int = ORDER) -> Models:
    """Fits on rows for which ``learnable`` (of doc_id) holds and that have text and lang."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").filter(learnable).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(CALIBRATION)) == 0
    # one row a language: as small as the set of languages
    sample = rows.join(F.broadcast(totals), "lang").filter(part < F.lit(float(MAX_DOCS)) / F.col("_n")).withColumn("_c", calibrating)

    def count(batches):
        letters = letter_table()
        for langs, texts in arrow_rows(batches, ("lang", "text")):
            by: dict[str, list] = {}
            for g, t in zip(langs, texts):
                by.setdefault(g, []).append(ngrams(characters(t, letters), order))
            for g, grams in by.items():
                keys, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.filter("NOT _c").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, keys, n = np.array(counted.column("lang").to_pylist(), object), counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    counts = {}
    for g in sorted(set(langs)):
        own = langs == g
        grams = keys[own].view(np.uint64)
        by_key = np.argsort(grams)
        counts[g] = grams[by_key], n[own][by_key]
    models = Models.fit(counts, order)
    if not models.languages:
        return models

    def judge(batches):
        letters, ready = letter_table(), models.ready()
        for langs, texts in arrow_rows(batches, ("lang", "text")):
            got = [(g, len(chars), *ready.predict(chars)) for g, t in zip(langs, texts) if len(chars := characters(t, letters))]
            yield pa.RecordBatch.from_arrays([pa.array([x[3] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[0] == x[2] for x in got], pa.bool_())], names=["lead", "size", "ok"])

    held = sample.filter("_c").select("lang", "text").mapInArrow(judge, "lead double, size long, ok boolean").toArrow()
    return models.calibrate(*(held.column(c).to_numpy() for c in ("lead", "size", "ok")))


def identify(docs: DataFrame, models: Models, reject: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score and whether the answer is accepted."""

    def run(batches):
        letters, ready = letter_table(), models.ready()
        for ids, texts in arrow_rows(batches, ("doc_id", "text")):
            got = [ready.predict(characters(t or "", letters)) for t in texts]
            score = [x[2] for x in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array(score, pa.float64()), pa.array([s >= reject for s in score], pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
