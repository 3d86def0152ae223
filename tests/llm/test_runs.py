"""Runs against every period of every place, and the query's rows against the contract word by word."""

import random
import re
import zlib
from hashlib import sha256

import pytest
from helpers import AWKWARD, LONG, docs

from meterglass.llm import queries, runs


def brute(w, least=12):
    """(start, length, period) of all runs, period by period; the least period of an interval counts."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((a, z, p) for (a, z), p in out.items()), key=lambda r: (r[0], r[2]))


def by_contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    dropped = {i for s, z, p in found for i in range(s + p, s + z)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{z},{p}\n" for s, z, p in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha256(lines.encode()).hexdigest(), sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest())


def shapes(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.randint(1, 4)
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            x = [rng.randrange(letters + 2) for _ in range(rng.randint(1, 12))]
            w = (w + x * rng.randint(1, 6) + [rng.randrange(letters) for _ in range(rng.randint(0, 9))] + x) * rng.randint(1, 2)
        yield w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_many_shapes(least):
    for w in shapes(least, 400):
        assert sorted(((a, z - a, p) for a, z, p in runs.runs_of(w, least)), key=lambda r: (r[0], r[2])) == brute(w, least), w


def test_stretches_lose_nothing():
    texts = [[b"%d" % c for c in w] for w in shapes(99, 300)]
    assert runs.runs_of_texts(texts) == [brute(t) for t in texts]


def test_factors_are_the_longest_earlier_ones():
    for w in shapes(5, 60):
        at = 0
        for start, length, source in runs.lz_factors(w):
            assert start == at
            earlier = lambda m: any(w[k : k + m] == w[start : start + m] for k in range(start))
            assert source == -1 and length == 1 and not earlier(1) or 0 <= source < start and w[source : source + length] == w[start : start + length]
            assert start + length == len(w) or source == -1 or not earlier(length + 1)
            at += length
        assert at == len(w)


def test_query_by_contract(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{c}" for c in w)) for i, w in enumerate(shapes(17, 150))]
    rows += [(i, " \t".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 200)))) for i in range(200, 400)]
    rows += [(1000 + i, t) for i, t in AWKWARD if i is not None and t != LONG] + [(None, "a b " * 20), (5, "x y z " * 9), (5, "x y z " * 9)]
    docs(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((by_contract(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_long_and_empty(spark):
    found = runs.find_runs(docs(spark, [(1, LONG), (2, None), (3, "one line of words\n" * 2000 + "end")])).collect()
    by_id = {r.doc_id: r for r in found}
    assert [tuple(r) for r in by_id[1].runs] == [(0, 60_000, 1)] and by_id[1].collapsed == "word"
    assert by_id[2].runs == [] and by_id[2].collapsed == ""
    assert [tuple(r) for r in by_id[3].runs] == [(0, 8000, 4)] and by_id[3].collapsed == "one line of words end"
    assert runs.find_runs(docs(spark, [])).collect() == []
