"""The walk and the reader of byte ranges, against os.walk and plain splitting."""

import os
import random

import pytest

from meterglass.sources import files, listing


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(1)
    root = tmp_path / "r"
    for folder in ("p", "_q", ".h/d", "p/_deep/.x/y"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for name in ("a.jsonl", "_b.jsonl", ".c.jsonl", ".jsonl", "d.json", "e.txt"):
            (root / folder / name).write_bytes(b"".join(b"%d" % rng.randint(0, 9) * rng.randint(0, 30) + rng.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(rng.randint(0, 40))))
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/z.jsonl").write_text("far\n")
    (root / "linked").symlink_to(tmp_path / "outside")
    (root / "p/link.jsonl").symlink_to(tmp_path / "outside/z.jsonl")
    return root


def by_os(root, ends=(".jsonl",)):
    return sorted(f"{d}/{n}" for d, _, names in os.walk(root, followlinks=False) for n in names if n.endswith(ends) and n not in ends and not os.path.islink(f"{d}/{n}"))


@pytest.mark.parametrize("walk", [3, listing.WALK])
def test_walk(spark, tree, walk):
    found = listing.files(spark, [str(tree)], "*.jsonl", walk=walk).collect()
    assert sorted(f.file for f in found) == by_os(tree) and len(found) == 12
    for f in found:
        stat = os.stat(f.file)
        assert (f.size, f.mtime_ns) == (stat.st_size, stat.st_mtime_ns)
    assert sorted(f.file for f in listing.files(spark, [f"file://{tree}"], "*.{jsonl,json}", walk=walk).collect()) == by_os(tree, (".jsonl", ".json"))


def test_roots_links_and_missing_folders(spark, tree, tmp_path):
    (tmp_path / "root").symlink_to(tree)
    found = listing.files(spark, [f"{tmp_path}/gone", f"{tmp_path}/root/", str(tree / "p")], "a.jsonl").collect()
    assert {f.root_ord for f in found} == {1, 2} and sum(f.root_ord == 1 for f in found) == 4
    assert [f.file for f in listing.files(spark, [str(tree / "p")], "*.jsonl", recursive=False).collect() if "/_deep" in f.file] == []
    assert listing.files(spark, [], "*").collect() == []


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads everything")
def test_unreadable_folder(spark, tree):
    (tree / "_q").chmod(0)
    assert all("/_q/" not in f.file for f in listing.files(spark, [str(tree)], "*.jsonl").collect())
    (tree / "_q").chmod(0o755)


def plain_lines(data: bytes, stop: bool = False):
    out, at = [], 0
    for line in data.split(b"\n"):
        if at < len(data):
            text = line[:-1] if line.endswith(b"\r") else line
            if files.valid(text):
                out.append((at, text.decode()))
            elif stop:
                break
        at += len(line) + 1
    return out


@pytest.mark.parametrize("step", [3, 64, 1 << 20])
def test_ranges_give_each_line_once(monkeypatch, step):
    monkeypatch.setattr(files, "STEP", step)
    rng = random.Random(step)
    for _ in range(200):
        data = b"".join(rng.choice([b"", b"x", "é".encode(), b"\r", b"\xff", b"abc" * rng.randint(0, 9)]) + rng.choice([b"\n", b"\r\n", b""]) for _ in range(rng.randint(0, 30)))
        size = rng.randint(1, 25)
        got = []
        for start in range(0, max(1, len(data)), size):
            for at, texts in files.line_batches(lambda a, b: data[a:b], start, min(len(data), start + size), len(data), False):
                got += zip(at.tolist(), texts.to_pylist())
        assert got == plain_lines(data), (data, size)
        whole = [x for at, texts in files.line_batches(lambda a, b: data[a:b], 0, len(data), len(data), True) for x in zip(at.tolist(), texts.to_pylist())]
        assert whole == plain_lines(data, True), data


def test_lines_of_a_folder(spark, tree):
    want = sorted((f, n, text) for f in by_os(tree) for n, (_, text) in enumerate(plain_lines(open(f, "rb").read())))
    found = files._read(files.listed(spark, [str(tree)], "*.jsonl"), whole=False, size=50)
    assert found.select("block").distinct().count() > 2
    got = files.numbered(found).select("file", "line_no", "value", "path_key")
    rows = sorted((r.file, r.line_no, r.value) for r in got.collect())
    assert rows == want
    only = spark.createDataFrame([(f,) for f in by_os(tree)[:2]], "file string")
    assert {r.file for r in files.lines(spark, [str(tree)], "*.jsonl", only=only).collect()} <= set(by_os(tree)[:2])


def test_stream_and_batch_see_the_same_files(spark, tree):
    from meterglass.streaming.tail import TailReader

    assert sorted(TailReader({"path": str(tree), "suffix": ".jsonl"}).files()) == sorted(f.file for f in listing.files(spark, [str(tree)], "*.jsonl").collect())


def test_path_keys_order_components(spark):
    """Batch readers and the column function give one key, which sorts by component: a/z before a-b/c."""
    paths = ["/r/a-b/c", "/r/a/z", "/r/a!", "/r/a"]
    got = [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").withColumn("k", files.path_key(files.F.col("p"))).orderBy("k").collect()]
    assert got == sorted(paths, key=lambda p: p.encode().replace(b"/", b"\0")) == ["/r/a", "/r/a/z", "/r/a!", "/r/a-b/c"]
