"""The forest's links against all pairs, with leaves so small that trees, balls and blocks are all in use."""

import numpy as np
import pytest

from meterglass.llm import embeddings as E
from meterglass.llm.simhash import components


def table_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int")


def by_all_pairs(rows, threshold=0.93, kind=np.float32):
    """(vec_id, n_links, component_id, kept) of each row."""
    n = len(rows)
    good = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, label in rows]
    x = [np.array(v, kind).astype(np.float64) if g else None for (_, v, _), g in zip(rows, good)]
    x = [v / np.linalg.norm(v / abs(v).max()) / abs(v).max() if v is not None else None for v in x]
    linked, root = np.zeros(n, int), list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if good[a] and good[b]:
                link = rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold
                linked[a] += link
                linked[b] += link
                if link or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return [(rows[a][0], int(linked[a]), c := least.get(find(a)), rows[a][0] == c) for a in range(n)]


def found(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


def near(r, v, noise):
    w = v / np.linalg.norm(v) + r.normal(0, noise / len(v) ** 0.5, len(v))
    return w / np.linalg.norm(w)


def corpus(seed, dims=24, n=700):
    """A background, pairs and chains of near copies, a tight group and a loose one."""
    r = np.random.default_rng(seed)
    vectors = list(r.normal(size=(n, dims)))
    for k in range(60):
        v = vectors[k]
        for _ in range(k % 4):
            v = near(r, v, 0.3)
            vectors.append(v)
    centre, other = r.normal(size=dims), r.normal(size=dims)
    vectors += [near(r, centre, 0.1) for _ in range(300)] + [near(r, centre, 0.5) for _ in range(40)] + [near(r, other, 0.4) for _ in range(120)]
    ids = r.permutation(len(vectors)).tolist()
    return [(i, v.tolist(), int(k % 50 == 0)) for k, (i, v) in enumerate(zip(ids, vectors))]


@pytest.mark.parametrize("most", [E.MOST_BROADCAST, 0])
def test_recall_and_counts(spark, most):
    rows = corpus(1 + most % 7)
    got, want = found(E.near_duplicates(table_of(spark, rows), leaf=60, sample=300, levels=5, most_broadcast=most)), by_all_pairs(rows)
    assert len(got) == len(rows)
    mine, all_links = {g[0]: g for g in got}, {w[0]: w for w in want}
    assert all(mine[i][1] <= all_links[i][1] for i in mine)  # no link below the threshold, none counted twice
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert sum(mine[i][2] != all_links[i][2] for i in mine) <= 0.02 * len(rows)


def test_trees_split_balls_and_blocks_are_in_use(spark):
    base, wide = E.comparable(table_of(spark, corpus(3)))
    base = base.cache()
    stands = E.Forest(0.93, wide, leaf=60, sample=300, levels=5).places(base)
    kinds = {r["kind"]: r["count"] for r in stands.groupBy("kind").count().collect()}
    assert kinds[E.INSIDE] >= 300 and kinds[E.OPEN] > 700
    assert stands.filter("kind = 0").groupBy("kin", "place").count().agg({"count": "max"}).first()[0] <= 60


def test_loose_groups_are_compared_whole(spark):
    """No cut and no ball helps: blocks of rows meet pair by pair, and nothing is lost."""
    r = np.random.default_rng(5)
    centre = r.normal(size=16)
    rows = [(i, near(r, centre, 0.33).tolist(), 1) for i in range(260)]
    got = found(E.near_duplicates(table_of(spark, rows), leaf=30, sample=200, width=40.0))
    assert got == sorted(by_all_pairs(rows), key=str)


def test_exact_where_a_label_is_one_leaf(spark):
    r = np.random.default_rng(7)
    rows = [(i, near(r, np.ones(8) * (1 + i % 3) + (i % 5) * np.eye(8)[i % 8], 0.3).tolist(), i % 4) for i in range(150)]
    assert found(E.near_duplicates(table_of(spark, rows, "double"))) == sorted(by_all_pairs(rows, kind=np.float64), key=str)


AWKWARD = [
    (1, [1, 0, 0], 1), (2, [2, 0, 0], 1), (3, [1, 0, 0], 2), (4, [1, 0, 0], None), (5, None, 1), (6, [], 1), (7, [0, 0, 0], 1), (8, [1, None, 0], 1),
    (9, [float("nan"), 1, 0], 1), (10, [float("inf"), 0, 0], 1), (11, [1, 0], 1), (11, [3, 0], 1), (None, [0, 1, 0], 1), (12, [0, 1, 0.01], 1), (13, [0, 1, -0.01], 1),
    (None, [0, 0, 1], 1), (None, [0, 0.01, 1], 1), (20, [1, 1, 0], 3), (21, [1, 0.9, 0], 3), (21, [-1, 1, 0], 3), (22, [-1, 1.1, 0], 3), (30, [1e300, 0, 0], 4), (31, [1e-300, 0, 0], 4),
]


@pytest.mark.parametrize("leaf", [4, 512])
def test_awkward_rows(spark, leaf):
    df = table_of(spark, AWKWARD, "double").selectExpr("*", "'own' AS kin", "1 AS node", "2 AS core", "3 AS place", "4 AS n")
    assert found(E.near_duplicates(df, leaf=leaf)) == sorted(by_all_pairs(AWKWARD, kind=np.float64), key=str)


def test_empty(spark):
    assert E.near_duplicates(table_of(spark, [])).collect() == []
    assert found(E.near_duplicates(table_of(spark, [(1, None, None)]))) == [(1, 0, 1, True)]


def test_components_through_copies(spark):
    """A label of one vector only: a ball that is spanned and counted without a comparison."""
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(200)]
    assert found(E.near_duplicates(table_of(spark, rows), leaf=20, sample=100)) == sorted([(i, 199, 0, i == 0) for i in range(200)], key=str)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
