import hashlib

import pytest
from helpers import AWKWARD, docs
from meterglass.llm import mixing as M


def brute(rows, weights=(3, 1, 2), budget=1.5):
    """Word counts, targets by repeated resharing, and words taken in md5 order."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, _, x in rows if x == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), budget * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > 2 * total[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    out = []
    order = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
    for s in sources:
        at, own = 0, {}
        for r in rows:
            if r[3] == s:
                own.setdefault((order(r), r[0], r[1] or ""), []).append(r)
        for (_, i, t), same in sorted(own.items(), key=lambda x: x[0][0]):
            n, whole, k = size(t), int(target[s]), len(same)
            share = sum(max(0, min(a + n * k, whole) - a) for a in (at, at + total[s])) // k
            out += [(i, n, total[s], pytest.approx(target[s]), share)] * k
            at += n * k
    return out, total, target


def test_against_brute_force(spark):
    rows = [(i, t, "en", ("a", None, "b")[k % 3]) for k, (i, t) in enumerate(AWKWARD)] + [(100 + i, "w " * (i % 17), "en", "hot" if i % 3 else "a") for i in range(900)]
    rows += [(None, f"no id {i}", "en", "hot") for i in range(300)] + [(7, "same id and text", "en", "b")] * 40 + [(7, f"same id {i}", "en", "b") for i in range(40)]
    want, total, target = brute(rows)
    df = docs(spark, rows, extra=True)
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in M.mix(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[4])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(x[4] <= 2 * x[1] for x in got)
    order = [r["position"] for r in M.curriculum(df).collect()]
    taken = [p for p in order if p is not None]
    assert taken == sorted(taken) and order[len(taken) :] == [None] * (len(order) - len(taken))
    placed = M.mixed_documents(df).collect()
    order = [r["position"] for r in placed]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in placed), key=key) == sorted((x for x in want if x[4]), key=key)
    assert all(len(r["positions"]) <= 2 and r["taken"] <= 2 * r["size"] for r in placed)
    for s in total:
        assert int(target[s]) - 40 < sum(r["taken"] for r in placed if r["source"] == s) <= target[s]


def test_repeated_rows_are_met_by_text(spark):
    """Rows without an id, and rows of one id, keep what is taken of their own text."""
    rows = [(None, "a b c d e f g h i " + str(i), "en", "s") for i in range(6)] + [(5, "a b c d e f g h i j", "en", "s")] * 4
    got = M.mixed_documents(docs(spark, rows)).collect()
    assert sum(r["taken"] for r in got) == 150 and len(got) == 10


def test_many_sources(spark):
    """More sources than a round can fill at once, ranked over several partitions."""
    rows = [(i, "w " * (1 + (i * 37) % 101), "en", f"s{i % 97:02}" if i % 5 else None) for i in range(1500)]
    want, *_ = brute(rows)
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in M.mix(docs(spark, rows)).collect()}
    assert got == {x[0]: (x[3], x[4]) for x in want}


@pytest.mark.parametrize("k", range(3))
def test_demand_inverse(spark, k):
    from pyspark.sql import functions as F

    knots = M.SCHEDULES[k]
    area = lambda t: sum((min(t, b) - a) * (w + (w + (v - w) * (min(t, b) - a) / (b - a))) / 2 for (a, w), (b, v) in zip(knots, knots[1:]) if t > a)
    times = [0.0, 0.1, 0.49, 0.5, 0.77, 1.0]
    df = spark.createDataFrame([(t, 1000 * area(t) / area(1)) for t in times], "t double, c double")
    got = df.select("t", M.demand_inverse(F.col("c"), F.lit(1000.0), F.lit(k)).alias("x")).collect()
    assert all(r["x"] == pytest.approx(r["t"], abs=1e-9) for r in got)


def test_empty_and_wordless(spark):
    assert M.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in M.mix(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]
    assert M.mixed_documents(docs(spark, [(1, None)])).count() == 0
