import random
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, docs
from pyspark.sql import functions as F

from meterglass.llm import language as G

SYLLABLES = {"xa": "ba ko ri mu ten sal", "xb": "ße ö lich ung zer ach", "xc": "ción ñ rr osa de la"}


def corpus(n=240, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        parts = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))), lang, "s"))
    return out


def test_probabilities_sum_to_one():
    letters = G.letter_table()
    keys, n = np.unique(G.ngrams(G.characters("the cat sat on the mat, the hat", letters)), return_counts=True)
    c = G.Counts(keys, n)
    alphabet = np.unique(c.grams[1][0])
    size = len(alphabet) + 1
    for history in ("the", "hat", "zzz", " ca"):
        h = np.uint64(0)
        for ch in history:
            h = h << np.uint64(16) | np.uint64(ord(ch))
        p = c.probability(G.ORDER, np.array([h << np.uint64(16) | a for a in alphabet], np.uint64), size)
        unseen = c.probability(G.ORDER, np.array([h << np.uint64(16) | np.uint64(ord("q"))]), size)[0]
        assert p.sum() + unseen == pytest.approx(1)


def test_arrays_agree_with_the_counts():
    letters = G.letter_table()
    texts = {"a": "banana bandana cabana", "b": "la casa de la rosa"}
    counts = {k: np.unique(G.ngrams(G.characters(t, letters)), return_counts=True) for k, t in texts.items()}
    m = G.Models.fit(counts).ready()
    size = int(round(np.exp(-m.floor)))
    chars = G.characters("casa banana xyz", letters)
    want = [-np.log(G.Counts(*counts[k]).probability(G.ORDER, G.ngrams(chars), size)).mean() for k in m.languages]
    assert np.allclose(m.cross_entropy(chars), want, atol=1e-5)


def plain_cross_entropy(train, text, order=4):
    """Interpolated Kneser-Ney from its definition, with strings and dictionaries; None without a letter."""

    def shaped(t):
        return " " + "".join(c if c.isalpha() else " " for c in t.lower()).strip() + " "

    def squeezed(t):
        return " " + " ".join(shaped(t).split()) + " "

    counts = {order: Counter(s[i : i + order] for s in map(squeezed, train) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))

    def p(gram, k, alphabet):
        if k == 0:
            return 1 / alphabet
        history = gram[:-1]
        after = [v for g, v in counts[k].items() if g[:-1] == history]
        lower = p(gram[1:], k - 1, alphabet)
        if not after:
            return lower
        return max(counts[k][gram] - discount[k], 0) / sum(after) + discount[k] * len(after) / sum(after) * lower

    s = squeezed(text)
    return lambda alphabet: -np.mean([np.log(p(s[i : i + order], order, alphabet)) for i in range(len(s) - order + 1)]), set(counts[1])


def test_scores_against_the_definition():
    letters = G.letter_table()
    texts = {"a": ["banana bandana, cabana!", "an ananas"], "b": ["la casa de la rosa", "Ñandú y ñoño 12 la"], "c": ["\U00010400\U00010401 \U00010428 banal"]}
    m = G.Models.fit({k: np.unique(np.concatenate([G.ngrams(G.characters(t, letters)) for t in ts]), return_counts=True) for k, ts in texts.items()}).ready()
    for text in ("casa banana xyz", "ñandú", "qqqq", "a la", "\U00010428\U00010428 banal \U00010400"):
        plain = [plain_cross_entropy(texts[k], text) for k in m.languages]
        alphabet = len(set().union(*(seen for _, seen in plain))) + 1
        want = [entropy(alphabet) for entropy, _ in plain]
        assert np.allclose(m.cross_entropy(G.characters(text, letters)), want, atol=1e-5), text
        assert m.predict(G.characters(text, letters))[0] == m.languages[int(np.argmin(want))]


def test_letters_beyond_16_bits():
    letters = G.letter_table()
    one, other = G.characters("\U00010020\U00010021", letters), G.characters("\U00010021\U00010020", letters)
    assert len(one) == 4 and (one != other).any() and not set(one[1:-1]) & {G.BLANK}


def test_held_out_accuracy(spark):
    rows = corpus()
    df = docs(spark, rows, extra=True)
    models = G.fit(df, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in G.identify(df, models).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    noise = G.identify(docs(spark, [(1, "qqq www zzz")]), models).first()
    assert noise["score"] < min(got[i]["score"] for i, *_ in held if len(dict((a, b) for a, b, *_ in rows)[i]) > 100)


def test_awkward_rows(spark):
    models = G.fit(docs(spark, [*corpus(30), (900, None, "xa", "s"), (901, "abc", None, "s")]), F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in G.identify(docs(spark, AWKWARD, extra=True), models).collect()}
    assert got[1] == got[2] == got[3] == got[8] == "und" and got[4] in SYLLABLES and got[7] in SYLLABLES
    untrained = G.fit(docs(spark, []), F.lit(True))
    assert {r["lang_pred"] for r in G.identify(docs(spark, AWKWARD), untrained).collect()} == {"und"}
    assert G.identify(docs(spark, []), models).count() == 0
    assert G.identify(docs(spark, [(1, "a"), (2, "𝒳𝒴")]), models).filter("lang_pred <> 'und'").count() == 2
