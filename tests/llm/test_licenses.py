import random
import re
from collections import Counter
from math import ceil

from helpers import AWKWARD, docs
from meterglass.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    """Base places and, by trying every window, the template labels and the best containment."""
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    base = [(label, i) for label, p in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {x for x, _ in base}, 1.0 if base else 0.0
    for label, notice in L.TEMPLATES:
        t = WORD.findall(notice)
        need, width = ceil(L.THRESHOLD * len(set(t)) - 1e-9), ceil(len(t) * 1.25)
        best = max((len(set(t) & set(w[i : i + width])) for i in range(max(1, len(w) - width + 1))), default=0)
        if best >= need:
            labels.add(label)
            score = max(score, best / len(set(t)))
    starts = [i for _, i in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(labels)), score


def test_against_every_window(spark):
    cc = "Licensed under CC BY-NC 4.0."
    rows = [r for r in AWKWARD if r[0] != 7] + [
        (20, cc), (21, f"{cc} {cc}"), (22, "released UNDER the-MIT license, apache License version 2"), (23, "licensed under the long gnu general public license version 3"),
        (24, "mit und the license under apache"), (25, "der Text mit licensed under the apache license x y z q mit"), (26, "permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files"),
        (27, "word " * 300 + "under the mit license " + "word " * 300 + "Under The MIT License"), (28, "é under the mit licensé"), (29, "licensed cc under by 4 nc 0"), (30, "cc by sa 4 0 licensed under"),
    ]
    got = {r["doc_id"]: r for r in L.digest(L.scan(docs(spark, rows, extra=True))).collect()}
    for i, t in rows:
        r = got[i]
        want = brute(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == want[:6], i
        assert abs(r["score"] - want[6]) < 1e-12
    assert got[26]["labels"] == "mit" and got[30]["labels"] == "cc-by-sa"


def test_prefixes_follow_frequency(spark):
    df = docs(spark, [(i, "under the license") for i in range(9)] + [(99, "mit")])
    counts = L.word_frequencies(df, frozenset([b"under", b"the", b"mit", b"license"]))
    assert counts == {b"under": 9, b"the": 9, b"mit": 1, b"license": 9}
    join = L.Join(counts, (("mit", "under the mit license"),), 0.75)
    assert join.rank[b"mit"] == 0 and len(join.templates[0].prefix) == 2 and join.first == {b"mit", b"license"}


def test_each_filter_discards_and_none_loses():
    """On texts of template words every filter acts, and each run of windows is what brute force finds."""
    r = random.Random(3)
    vocabulary = sorted({w for _, n in L.TEMPLATES for w in n.split()})
    count = {w.encode(): 1000 // (k + 1) for k, w in enumerate(r.sample(vocabulary, len(vocabulary)))}
    join, seen = L.Join(count), Counter()
    for _ in range(400):
        text = r.choices(vocabulary, k=r.randint(0, 60)) + r.choices(["filler"], k=r.randint(0, 90))
        for _ in range(r.randint(0, 3)):
            notice = r.choice(L.TEMPLATES)[1].split()
            for _ in range(r.randint(0, 2)):
                notice[r.randrange(len(notice))] = "other"
            at = r.randint(0, len(text))
            text[at:at] = notice if r.random() < 0.5 else r.sample(notice, len(notice))
        if r.random() < 0.3:
            text = [w for x in text for w in (x, "filler", "filler")]
        got = {(k, round(c * 1000)) for k, _, _, _, c in join.hits([w.encode() for w in text], seen)}
        want = {}
        for k, (_, notice) in enumerate(L.TEMPLATES):
            t = notice.split()
            width = ceil(len(t) * 1.25)
            for i in range(len(text)):
                n = len(set(t) & set(text[i : i + width]))
                if n >= ceil(L.THRESHOLD * len(set(t)) - 1e-9):
                    want[k] = max(want.get(k, 0), n / len(set(t)))
        assert {k: max(c for j, c in got if j == k) for k, _ in got} == {k: round(c * 1000) for k, c in want.items()}
    assert all(seen[x] > 100 for x in ("prefix", "length", "position", "candidate")), seen


def test_template_table(spark):
    table = spark.createDataFrame([("own", "these five words are mine"), ("none", None), ("empty", "")], "label string, notice string")
    got = L.digest(L.scan(docs(spark, [(1, "say: these five words are mine!"), (2, "these words")]), table)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["own", ""]


def planted(r, n):
    """Texts of template words, filler and notices with words changed, moved or stretched."""
    vocabulary = sorted({w for _, x in L.TEMPLATES for w in x.split()})
    for k in range(n):
        text = r.choices(vocabulary, k=r.randint(0, 60)) + ["filler"] * r.randint(0, 90)
        for _ in range(r.randint(0, 4)):
            notice = r.choice(L.TEMPLATES)[1].split()
            notice[r.randrange(len(notice))] = r.choice(("other", notice[0]))
            at = r.randint(0, len(text))
            text[at:at] = notice if r.random() < 0.5 else r.sample(notice, len(notice))
        yield 100 + k, " ".join(text if r.random() < 0.7 else [w for x in text for w in (x, "Filler")])


def test_shuffled_templates_give_the_same_rows(spark, monkeypatch):
    """Beyond the size that may travel, every hit with its places and containment is the same, for copies and awkward rows, too."""
    rows = AWKWARD + list(planted(random.Random(5), 150)) + [(90, L.TEMPLATES[2][1])] * 3 + [(None, L.TEMPLATES[2][1])]
    table = spark.createDataFrame([*L.TEMPLATES, ("twice", L.TEMPLATES[0][1]), ("none", None), ("empty", "")], "label string, notice string")
    df = docs(spark, rows, extra=True)
    plain = lambda found: sorted((repr(r) for r in found.collect()))
    want = plain(L.scan(df, table))
    monkeypatch.setattr(L, "MAX_TEMPLATE_BYTES", 10)
    monkeypatch.setattr(L, "AT_A_TIME", 4)
    got = L.scan(df, table)
    assert plain(got) == want and sum("template=" in r for r in want) > 50
    assert L.scan(docs(spark, []), table).count() == 0
    wordless = spark.createDataFrame([("marks", "--- *** ---")], "label string, notice string")
    assert [r["labels"] for r in L.digest(L.scan(docs(spark, [(1, "under the mit license"), (1, None)]), wordless)).orderBy("labels").collect()] == ["", "mit"]


def test_whole_license_texts(spark, tmp_path, monkeypatch):
    """Texts of thousands of words as templates, found inside longer texts with one word in thirty changed, either way."""
    r = random.Random(9)
    texts = {name: [f"{name}{r.randint(0, 400)}" if r.random() < 0.5 else f"w{r.randint(0, 900)}" for _ in range(n)] for name, n in (("long", 3000), ("short", 200), ("other", 900))}
    for name, w in texts.items():
        (tmp_path / name).write_text("\n".join(w), encoding="utf-8")
    changed = [w if k % 30 else "changed" for k, w in enumerate(texts["long"])]
    df = docs(spark, [(1, " ".join(["x"] * 5000 + changed + ["y"] * 700 + texts["short"])), (2, " ".join(texts["other"][:400])), (3, " ".join(texts["other"]))])
    table = L.template_files(spark, str(tmp_path))
    want = {r["doc_id"]: r["hits"] for r in L.scan(df, table).collect()}
    assert [sorted(h["label"] for h in want[i]) for i in (1, 2, 3)] == [["long", "short"], [], ["other"]]
    assert any(h["label"] == "long" and h["first"] >= 5000 and h["containment"] < 1 for h in want[1])
    monkeypatch.setattr(L, "MAX_TEMPLATE_BYTES", 10)
    assert {r["doc_id"]: r["hits"] for r in L.scan(df, table).collect()} == want


def test_long_and_empty(spark):
    got = L.digest(L.scan(docs(spark, [AWKWARD[7]]))).first()
    assert got["n_words"] == 60_000 and got["labels"] == "" and got["first_word"] is None
    assert L.scan(docs(spark, [])).count() == 0
