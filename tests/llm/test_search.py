"""Ranked lexical search against scores by definition."""

import math
import random
import re
from collections import Counter

import pytest
from helpers import AWKWARD, docs

from meterglass.llm import search

WORDS = [f"w{i}" for i in range(40)] + ["É", "naïve", "X1"]


def split(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, items, k=10):
    texts = [(i, split(t)) for i, t in rows]
    texts = [(i, w) for i, w in texts if w]
    n_docs, n_terms = len(texts), sum(len(w) for _, w in texts)
    tfs = [Counter(w) for _, w in texts]
    df = Counter(t for c in tfs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(split(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc_id, words), tf in zip(texts, tfs):
            m = 25 + 75 * len(words) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS[: rng.randint(2, 43)]) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(25)]
    return rows, items


def table_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [0, search.MOST_BROADCAST])
def test_against_definition(spark, monkeypatch, most):
    monkeypatch.setattr(search, "SEGMENT_DOCS", 50)
    monkeypatch.setattr(search, "WINDOW", 16)
    monkeypatch.setattr(search, "BLOCK", 7)
    rows, items = corpus(most)
    index = search.postings(docs(spark, rows, extra=True).repartition(3), "b").cache()
    assert index.select("segment").distinct().count() > 5
    assert found(search.ranked(index, table_of(spark, items), most_broadcast=most)) == brute(rows, items)


def test_ties_repeats_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 8)
    rows = [*AWKWARD, *[(100 + i % 9, "tie word") for i in range(20)], (None, "tie word"), (None, "Same"), (50, "rare " + "word " * 300)]
    items = [(1, "tie"), (1, "tie tie same"), (None, "SAME Word"), (None, "word"), (2, ""), (3, None), (4, "nowhere"), (5, "é 漢字"), (6, "rare")]
    assert found(search.best_documents(docs(spark, rows, extra=True), table_of(spark, items).selectExpr("*", "'own' AS term", "1 AS block"))) == brute(rows, items)


def test_batches_are_one_index(spark, tmp_path):
    rows, items = corpus(7, 120)
    index = search.Index(spark, f"{tmp_path}/index").append(docs(spark, rows[:50]), "a").append(docs(spark, rows[50:]), "b")
    assert found(index.search(table_of(spark, items), 3)) == brute(rows, items, 3)


def test_empty_tables(spark):
    rows, items = corpus(1, 5)
    assert search.best_documents(docs(spark, []), table_of(spark, items)).collect() == []
    assert search.best_documents(docs(spark, rows), table_of(spark, [])).collect() == []
    assert search.best_documents(docs(spark, [(1, None), (2, "- -")]), table_of(spark, items)).collect() == []
