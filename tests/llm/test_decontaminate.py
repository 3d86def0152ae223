import numpy as np
import pytest
from helpers import AWKWARD, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from meterglass.llm import decontaminate as D

ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly boil pots of vivid jade soup near the harbour"
ITEMS = "item_id long, text string"


def distance(item, text):
    """Least edits of the whole item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_finds_whatever_is_within_the_budget(data):
    index = D.Index([(1, ITEM)])
    item = D.normalise(ITEM).tobytes()
    chars = list(item.decode())
    for _ in range(data.draw(st.integers(0, 13))):
        at = data.draw(st.integers(0, len(chars) - 1))
        kind = data.draw(st.sampled_from("rid"))
        if kind == "r":
            chars[at] = data.draw(st.sampled_from("xqz "))
        elif kind == "i":
            chars.insert(at, "x")
        else:
            del chars[at]
    text = "some words before " + "".join(chars) + " and some after it"
    near = distance(item, D.normalise(text).tobytes())
    found = index.find(text)
    if near <= index.budget[0]:
        assert found and found[0][3] == near
    else:
        assert not found


def test_rows(spark):
    rows = [*AWKWARD, (50, "before " * 500 + ITEM.upper().replace(" ", ", ") + " after" * 500), (51, ITEM.replace("wizards", "lizards")), (52, ITEM[:60]), (53, ITEM + " " + ITEM), (54, "has short text inside"), (55, "has short texts inside")]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "Short text!"), (11, ITEM)], ITEMS)
    got = {r["doc_id"]: r for r in D.by_document(docs(spark, rows, extra=True), bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {50, 51, 53, 54}
    assert got[50]["item_ids"] == [7, 11] and got[54]["item_ids"] == [10] and got[51]["least_edits"] == 1
    df = docs(spark, rows, extra=True)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4
    assert D.drop_contaminated(docs(spark, []), bench).count() == 0
    assert D.drop_contaminated(df, bench.limit(0)).count() == len(rows)


def test_repeated_rows_and_blocks(spark, monkeypatch):
    """Each row is a result of its own, and items in several blocks and passes are found as in one."""
    rows = [(1, f"a {ITEM} b"), (1, "clean"), (None, ITEM), (None, "clean"), (2, f"{ITEM} {ITEM} 3 {ITEM} 17")]
    bench = spark.createDataFrame([(i, f"{ITEM} {i}") for i in range(20)] + [(None, "no id but a text of its own"), (3, f"{ITEM} 3")], ITEMS)
    got = []
    for size in (D.BLOCK_BYTES, 300):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        monkeypatch.setattr(D.blocks, "__defaults__", (size,))
        found = D.by_document(docs(spark, rows), bench).collect()
        got.append(sorted(((r["doc_id"] or 0, r["contaminated"], r["n_items"], r["item_ids"], r["least_edits"]) for r in found), key=str))
        assert D.drop_contaminated(docs(spark, rows), bench).count() == 2
    assert got[0] == got[1] and len(got[0]) == 5 and sum(x[1] for x in got[0]) == 3
    assert D.by_document(docs(spark, [(1, "no id but a text of its own")]), bench).first()["contaminated"]


def test_repetition_needs_little_memory():
    """A long text and an item of one repeated word: tens of millions of equal q-grams, counted in parts."""
    import tracemalloc

    index = D.Index([(1, "word " * 200 + "end of it"), (2, ITEM)], words=D.PASSAGE)
    tracemalloc.start()
    found = index.find("word " * 30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[0] for f in found] == [1] and peak < 200e6


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_parts_of_the_count_agree(pairs, monkeypatch):
    r = np.random.default_rng(3)
    items = [" ".join(prose(40, r)) for _ in range(5)]
    index = D.Index(list(enumerate(items)), words=D.PASSAGE)
    text = " ".join(prose(50, r)) + items[1] + " ".join(items[3].split()[5:30]) + " " + items[1]
    monkeypatch.setattr(D, "PAIRS", pairs)
    found = index.find(text)
    assert [f[0] for f in found] == [1, 3] and found[0][3] <= 1 and found[1][3] <= 1


@pytest.mark.parametrize("most", [300, 5000])
def test_blocks_of_the_benchmark(spark, most):
    bench = spark.createDataFrame([(i, f"{ITEM} {i}") for i in range(20)], ITEMS)
    found = [x for b in D.blocks(bench, most) for x in b]
    assert sorted(i for i, _ in found) == list(range(20))


def test_hash_of_qgrams():
    a = np.frombuffer(b"abcdefghijklmnabcdefghij", np.uint8)
    h = D.qgrams(a)
    assert len(h) == len(a) - D.Q + 1 and h[0] == h[14] and len(set(h[:14])) == 14


def prose(n, r):
    return ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(n)]


def test_passages_of_items(spark):
    r = np.random.default_rng(5)
    items = [prose(81, r) for _ in range(6)]
    tenth = [w if i % 10 != 4 else prose(1, r)[0][:5] for i, w in enumerate(items[3])]
    unspaced = "\u3042\u3044\u3046\u3048\u304a\u304b\u304d\u304f\u3051\u3053\u3055\u3057\u3059\u305b\u305d\u305f\u3061\u3064\u3066\u3068" * 2 + "".join(chr(0x4E00 + int(c)) for c in r.integers(0, 9000, 120))
    before, after = prose(300, r), prose(300, r)
    rows = {
        0: items[0][:60], 1: items[1][40:], 2: items[2][:30] + prose(60, r) + items[2][30:], 3: tenth,
        4: items[4][20:33], 5: [unspaced[60:110]], 6: items[5][:9] + prose(20, r) + items[5][40:49], 7: prose(81, r),
    }
    texts = [(i, " ".join(before + w + after)) for i, w in rows.items()]
    bench = spark.createDataFrame([(100 + i, " ".join(w)) for i, w in enumerate(items)] + [(106, unspaced)], ITEMS)
    got = {x["doc_id"]: x for x in D.by_document(docs(spark, texts), bench).collect()}
    assert {i: x["item_ids"] for i, x in got.items() if x["contaminated"]} == {0: [100], 1: [101], 2: [102], 3: [103], 4: [104], 5: [106]}
    assert {x["doc_id"] for x in D.drop_contaminated(docs(spark, texts), bench).collect()} == {6, 7}


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_passages_within_the_budget_are_found(data):
    index = D.Index([(1, ITEM)], words=D.PASSAGE)
    words = ITEM.lower().split()
    at = data.draw(st.integers(0, len(words) - D.PASSAGE))
    chars = list(" ".join(words[at : at + D.PASSAGE]))
    for _ in range(data.draw(st.integers(0, 9))):
        chars[data.draw(st.integers(0, len(chars) - 1))] = data.draw(st.sampled_from("xqz "))
    text = "some words before " + "".join(chars) + " and some after it"
    a = D.normalise(text).tobytes()
    item, (lo, hi) = D.normalise(ITEM), D.windows(D.normalise(ITEM), D.PASSAGE)
    near = any(distance(item[x:y].tobytes(), a) <= D.allowed(y - x) for x, y in zip(lo, hi))
    assert bool(index.find(text)) == near
