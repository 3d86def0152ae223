import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, docs
from meterglass.llm import simhash as S


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def closed(ids, fps, radius=3):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in ("", "one", "Two words", "THREE Words here", "a b c d e f g " * 30, "É é ü", None):
        assert S.fingerprint((t or "").encode()) == plain(t)


def test_perfect_code_covers():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 31, 200, dtype=np.uint64)
    home, _ = S.homes(x)
    assert (S.homes(home)[1] == 0).all() and (np.bitwise_count(home ^ x) <= 1).all()


def test_anchors_bring_all_close_pairs_together():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = r.integers(0, 1 << 63, dtype=np.uint64)
        b = a
        for k in r.choice(64, r.integers(0, 4), replace=False):
            b ^= np.uint64(1) << np.uint64(k)
        anchor, row, home = S.anchors(np.array([a, b], np.uint64))
        assert set(anchor[(row == 0) & home]) & set(anchor[row == 1])


def test_components_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = [" ".join(f"w{r.integers(0, 50)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in AWKWARD if t != AWKWARD[7][1]]
    for k in range(160):
        words = base[k % 12].split()
        for _ in range(k // 12 % 3):
            words[r.integers(0, 60)] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(None, base[0]), (150, base[7]), (None, base[3] + " changed"), (None, "alone")]
    want = with_ids(rows)
    assert found(S.near_duplicates(docs(spark, rows, extra=True))) == want
    kept = S.drop_near_duplicates(docs(spark, rows, extra=True))
    assert {x["doc_id"] for x in kept.collect() if x["doc_id"] is not None} == {c for *_, c in want if c is not None}


def chain(n, r):
    """Fingerprints that share a block of 31 bits; only neighbours are within 3 bits of each other."""
    out = [int(r.integers(0, 1 << 33)) << 31 | 12345]
    while len(out) < n:
        free = [int(b) for b in r.permutation(range(31, 64))]
        for k in range(0, 33, 3):
            x = out[-1] ^ sum(1 << b for b in free[k : k + 3])
            if all(bin(x ^ y).count("1") > 3 for y in out[:-1]):
                out.append(x)
                break
        else:
            return chain(n, r)
    return out


def cloud(n, r):
    """Fingerprints at random in few bits, so that they link in clumps and bridges."""
    bits = r.choice(range(31, 64), 16, replace=False)
    masks = r.choice(1 << 16, n, replace=False)
    return [sum(1 << int(b) for k, b in enumerate(bits) if m >> k & 1) | 999 for m in masks]


@pytest.mark.parametrize("make", [chain, cloud])
@pytest.mark.parametrize("n", [6, 50, 120, 200])
def test_links_at_one_anchor_span_the_linked_set(make, n):
    r = np.random.default_rng(n)
    for _ in range(5):
        fps = [int(x) for x in r.permutation(np.array(make(n, r), np.uint64))]
        homes = int(r.integers(1, n + 1)) if make is cloud else n
        a, ids = np.array(fps, np.uint64), np.arange(n)
        u, v = S.spanning_links(a[:homes], ids[:homes], a, ids)
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def join(pairs):
            root[:] = range(n)
            for x, y in pairs:
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            return [find(x) for x in range(n)]

        want = join([(x, y) for x in range(homes) for y in range(n) if bin(fps[x] ^ fps[y]).count("1") <= 3])
        assert join(zip(u.tolist(), v.tolist())) == want
        assert len(u) < n + homes


def test_chains_and_clouds_against_all_pairs(spark):
    r = np.random.default_rng(7)
    for fps in (chain(150, r), cloud(200, r)):
        fps = [int(x) for x in r.permutation(np.array(fps, np.uint64))]
        nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
        got = {i: i for i in range(len(fps))} | {x["node"]: x["component"] for x in S.components(S.links(nodes)).collect()}
        assert got == closed(list(range(len(fps))), fps)


@pytest.mark.parametrize("most", [7, 40])
def test_crowded_anchors_are_split(spark, most):
    """Homes and visitors of crowded anchors are dealt over salts, and no link is lost."""
    r = np.random.default_rng(most)
    near = [x ^ (1 << int(r.integers(0, 31))) for x in cloud(120, r)]  # one bit of the shared block differs
    fps = list(dict.fromkeys([*cloud(200, r), *near, *chain(40, r)]))
    fps = [int(x) for x in r.permutation(np.array(fps, np.uint64))]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, id long")
    crowds = S.crowded(nodes, most).collect()
    assert any(x["home_salts"] > 1 for x in crowds) and any(x["visitor_salts"] > 1 for x in crowds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # so that groups go on from batch to batch
    try:
        got = {i: i for i in range(len(fps))} | {x["node"]: x["component"] for x in S.components(S.links(nodes, most=most)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == closed(list(range(len(fps))), fps)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "u long, v long")
    got = {r["node"]: r["component"] for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def with_ids(rows):
    """Components of rows by all pairs: rows link by fingerprint or share a doc_id; a component's least doc_id, if it has one."""
    fps, root = [plain(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3 or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted([(i, f"{fps[a]:016x}", least.get(find(a))) for a, (i, _) in enumerate(rows)], key=str)


def found(df):
    return sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()], key=str)


def bridge():
    """Three texts of which only the second is near the first and the third."""
    r = np.random.default_rng(11)
    while True:
        words = [f"w{k}" for k in r.integers(0, 400, 120)]
        texts = [" ".join(words)]
        for _ in range(2):
            words = list(words)
            words[int(r.integers(0, 120))] = f"x{r.integers(0, 1000)}"
            texts.append(" ".join(words))
        a, n, b = (plain(t) for t in texts)
        apart = [bin(x ^ y).count("1") for x, y in ((a, n), (n, b), (a, b))]
        if apart[0] <= 3 and apart[1] <= 3 and apart[2] > 3:
            return texts


def test_null_ids_bridge(spark):
    a, n, b = bridge()
    for ids in ((1, 3, 2), (1, None, 2), (None, None, 2), (None, 7, None), (None, None, None)):
        rows = list(zip(ids, (a, n, b)))
        want = with_ids(rows)
        assert found(S.near_duplicates(docs(spark, rows))) == want and len({c for *_, c in want}) == 1


def test_repeated_ids_join_their_groups(spark):
    one, two, three = "a b c d e f g h", "some other words stand here now", "and a third text that is far away"
    rows = [(1, one), (5, one), (2, two), (5, two), (9, three), (9, three), (None, three), (None, "x y z")]
    want = with_ids(rows)
    assert found(S.near_duplicates(docs(spark, rows, extra=True))) == want
    assert {(i, c) for i, _, c in want} == {(1, 1), (5, 1), (2, 1), (9, 9), (None, 9), (None, None)}
    assert sorted({r["doc_id"] for r in S.drop_near_duplicates(docs(spark, rows)).collect() if r["doc_id"]}) == [1, 9]


def test_null_ids_and_empty(spark):
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs(spark, [(None, "x y z"), (4, "a b c"), (None, "a b c")])).collect() if r["doc_id"] is not None or r["component_id"] is not None}
    assert got == {4: 4, None: 4}
    assert S.near_duplicates(docs(spark, [])).count() == 0
    assert S.drop_near_duplicates(docs(spark, [(None, "x"), (None, "x")])).count() == 2
