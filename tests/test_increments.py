"""Increments against a full recomputation, and what they touch."""

import json
import os

from meterglass.operators import increments, messages, rollup
from meterglass.sources import logs
from meterglass.sources.files import Config


def put(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"type": "assistant", "timestamp": f"2024-01-{day:02d}T10:00:00Z", "requestId": "r", "message": {"id": i, "model": "claude-sonnet-4", "usage": {"input_tokens": n}}}) + "\n" for i, day, n in rows))
    os.utime(path, (1700000500, 1700000500))


def same(spark, config, kept):
    want = rollup.daily_client(messages.enriched(logs.collect(spark, config, ["claude"])))
    got = kept.daily().select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    first = messages.dedup(logs.collect(spark, config, ["claude"]))
    assert sorted(map(str, kept.winners().select(*first.columns).collect())) == sorted(map(str, first.collect()))
    return {r.date: r.input for r in got.collect()}


def test_days_follow_files(spark, tmp_path, monkeypatch):
    config, root = Config(home=str(tmp_path)), tmp_path / ".claude/projects/p"
    kept = increments.Increments(spark, f"{tmp_path}/kept")
    put(root / "m.jsonl", ("a", 1, 10), ("b", 2, 20), ("c", 3, 30))
    put(root / "z.jsonl", ("d", 4, 40), ("e", 5, 50))
    assert kept.update(config, ["claude"]) == increments.Touched(5, 5, 5)
    assert same(spark, config, kept) == {"2024-01-01": 10, "2024-01-02": 20, "2024-01-03": 30, "2024-01-04": 40, "2024-01-05": 50}
    assert kept.update(config, ["claude"]) == increments.Touched(0, 0, 5)
    # a file that sorts earlier takes b, on another day; one that sorts later takes nothing
    put(root / "c.jsonl", ("b", 7, 21))
    put(root / "zz.jsonl", ("d", 4, 41))
    assert kept.update(config, ["claude"]) == increments.Touched(2, 3, 5)
    assert same(spark, config, kept) == {"2024-01-01": 10, "2024-01-07": 21, "2024-01-03": 30, "2024-01-04": 40, "2024-01-05": 50}
    # gone: b and d go back to the files that have them still
    (root / "c.jsonl").unlink()
    (root / "z.jsonl").unlink()
    assert kept.update(config, ["claude"]) == increments.Touched(3, 4, 4)
    assert same(spark, config, kept) == {"2024-01-01": 10, "2024-01-02": 20, "2024-01-03": 30, "2024-01-04": 41}
    # lost between two days: the next update makes it whole
    put(root / "a.jsonl", ("a", 9, 11))
    with monkeypatch.context() as m:
        m.setattr(increments.Increments, "put", lambda self, name, rows, days: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            kept.update(config, ["claude"])
        except RuntimeError:
            pass
    kept.update(config, ["claude"])
    assert same(spark, config, kept)["2024-01-09"] == 11
    # versions that were missed: all is made anew
    put(root / "b.jsonl", ("x", 10, 5))
    kept.facts.update(config, ["claude"])
    put(root / "b.jsonl", ("x", 11, 6), ("y", 11, 6))
    kept.facts.update(config, ["claude"])
    assert kept.update(config, ["claude"]).days == len(same(spark, config, kept))
