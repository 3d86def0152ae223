import hashlib

from helpers import AWKWARD, docs
from meterglass.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out.add((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_groups(spark):
    rows = [*AWKWARD, *[(i, "hot") for i in range(100, 900)]]
    got = {tuple(r) for r in X.exact_duplicates(docs(spark, rows, extra=True)).collect()}
    assert got == brute(rows)
    assert X.exact_duplicates(docs(spark, [])).count() == 0


def test_drop_keeps_one_row_and_all_columns(spark):
    df = docs(spark, AWKWARD, extra=True)
    kept = X.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in {(2, ""), (3, AWKWARD[2][1]), (4, AWKWARD[3][1]), (6, "same"), (7, AWKWARD[7][1]), (None, "no id"), (8, AWKWARD[9][1])})
    assert X.drop_exact_duplicates(docs(spark, [])).count() == 0


def test_index_persists_across_batches(spark, tmp_path):
    def rows(df):
        return {r["doc_id"]: (r["keep_id"], r["kept"]) for r in df.collect()}

    index = X.DigestIndex(spark, str(tmp_path / "index"), buckets=4, name="batches")
    assert rows(index.ingest(docs(spark, [(1, "a"), (2, "b"), (3, "a")]))) == {1: (3, False), 2: (2, True), 3: (3, True)}
    again = X.DigestIndex(spark, str(tmp_path / "index"), buckets=4, name="batches")
    batch = docs(spark, [(9, "a"), (10, "c"), (11, "c")])
    want = {9: (3, False), 10: (11, False), 11: (11, True)}
    assert rows(again.ingest(batch, "second")) == want
    assert again.read().count() == 3
    # run again, as after a failure beyond the append, and after one in the midst of it
    assert rows(again.ingest(batch, "second")) == want and again.read().count() == 3
    more = docs(spark, [(9, "a"), (10, "c"), (11, "c"), (12, "d")])
    assert rows(again.ingest(more, "second")) == want | {12: (12, True)} and again.read().count() == 4
    assert rows(again.ingest(batch, "third")) == {9: (3, False), 10: (11, False), 11: (11, False)}


def test_anti_join_is_sort_merge_on_buckets(spark, tmp_path):
    index = X.DigestIndex(spark, str(tmp_path / "index"), buckets=4, name="plans")
    index.ingest(docs(spark, [(1, "a")]))
    new = index.new(X.groups(X.digests(docs(spark, [(2, "b")]))))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_drop_shuffles_whole_rows_once(spark):
    plan = X.drop_exact_duplicates(docs(spark, [(i, "x" * i) for i in range(50)]))._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) <= 2  # whole rows and, unless they are few, the keys that stay
