"""Updates against full reads: what is unchanged isn't parsed, what changed or vanished is replaced."""

import json
import os
import sqlite3
from contextlib import closing

import pytest

from meterglass.__main__ import config_of
from meterglass.sources import ingest, logs
from meterglass.sources.files import Config

T0 = 1700000000000


def put(path, *rows, mtime=1700000500):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (mtime, mtime))


def said(id_, n):
    return {"type": "assistant", "timestamp": "2023-11-14T22:13:20Z", "requestId": "r", "message": {"id": id_, "model": "m", "usage": {"input_tokens": n}}}


def total(n, user=False):
    return {"params": {"update": {"sessionUpdate": "user_message_chunk" if user else "agent"}, "_meta": {"agentTimestampMs": T0, **({"totalTokens": n} if n else {})}}}


def same(spark, facts, config, clients):
    want = logs.collect(spark, config, clients)
    got = facts.read(clients).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    return got.count()


@pytest.fixture
def facts(spark, tmp_path):
    return ingest.Facts(spark, f"{tmp_path}/facts")


def test_files_one_by_one(spark, tmp_path, facts):
    config, root = Config(home=str(tmp_path), now_ms=T0), tmp_path / ".claude/projects"
    for k in range(4):
        put(root / f"p/{k}.jsonl", said(f"a{k}", k + 1), said(f"b{k}", k + 1))
    assert facts.updated("claude", config).parsed == 4 and same(spark, facts, config, ["claude"]) == 8
    report = facts.updated("claude", config)
    assert (report.units, report.parsed, report.removed, report.parsed_bytes) == (4, 0, 0, 0) and len(facts.versions("claude")) == 1
    put(root / "p/1.jsonl", said("a1", 2), said("c1", 50))  # rewritten
    put(root / "p/2.jsonl", said("a2", 3), said("b2", 3), said("c2", 9))  # grown
    put(root / "_n/.5.jsonl", said("a5", 5))  # new
    (root / "p/3.jsonl").unlink()  # gone
    report = facts.updated("claude", config)
    assert (report.units, report.parsed, report.removed) == (4, 3, 1)
    assert report.parsed_bytes == sum((root / f).stat().st_size for f in ("p/1.jsonl", "p/2.jsonl", "_n/.5.jsonl"))
    assert same(spark, facts, config, ["claude"]) == 8
    batches = {(r.dedup_key, r.batch) for r in facts.read(["claude"], keep=("batch",)).collect()}
    assert {b for k, b in batches if k in ("claude:a0:r", "claude:b0:r")} == {"b00000001"} and ("claude:c2:r", "b00000002") in batches
    put(root / "p/0.jsonl", said("a0", 7), mtime=1700000501)  # the same size at another time
    put(root / "p/0.jsonl", said("a0", 8), said("b0", 1), mtime=1700000501)
    assert facts.updated("claude", config).parsed == 1 and same(spark, facts, config, ["claude"]) == 8
    facts.compact("claude")
    assert same(spark, facts, config, ["claude"]) == 8 and facts.updated("claude", config).parsed == 0
    assert {r.batch for r in facts.read(["claude"], keep=("batch",)).collect()} == {"b00000004"}
    for f in root.rglob("*.jsonl"):
        f.unlink()
    assert facts.updated("claude", config).removed == 4 and facts.read(["claude"]).count() == 0


def test_a_lost_update_changes_nothing(spark, tmp_path, facts, monkeypatch):
    config, log = Config(home=str(tmp_path), now_ms=T0), tmp_path / ".claude/projects/p/x.jsonl"
    put(log, said("a", 1))
    facts.updated("claude", config)
    put(log, said("a", 1), said("b", 2))
    with monkeypatch.context() as m:
        m.setattr(ingest.Facts, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            facts.updated("claude", config)
    assert [r.dedup_key for r in facts.read(["claude"]).collect()] == ["claude:a:r"]
    (tmp_path / "facts/manifests/client=claude/v00000002").mkdir()  # begun, not whole
    assert facts.read(["claude"]).count() == 1
    facts.updated("claude", config)
    assert same(spark, facts, config, ["claude"]) == 2


def test_units_of_several_files(spark, tmp_path, facts):
    """A session's folder is read again when a sibling changes, a cache as a whole, a database when only its log grows."""
    home = tmp_path
    config = Config(home=str(home), now_ms=T0)
    for s in ("s1", "s2"):
        put(home / f".grok/sessions/ws/{s}/updates.jsonl", total(None, True), total(100), total(None, True), total(250))
    put(home / ".config/cursor-cache/events.json", {"events": [{"timestamp_ms": T0, "model": "m", "input_tokens": 1, "output_tokens": 1, "cache_read_tokens": 0, "cost": 0}]})
    (home / ".hermes").mkdir()
    with closing(sqlite3.connect(home / ".hermes/state.db")) as db:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("CREATE TABLE sessions (id TEXT, model TEXT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT)")
        db.execute("INSERT INTO sessions VALUES ('a', 'grok-4', 1, 1, 1, 1)")
        db.commit()
        clients = ["cursor", "hermes", "grok"]
        assert [r.parsed for r in facts.update(config, clients)] == [1, 1, 2]
        same(spark, facts, config, clients)
        put(home / ".grok/sessions/ws/s1/summary.json", {"current_model_id": "grok-9"})
        db.execute("INSERT INTO sessions VALUES ('b', 'grok-4', 1, 1, 1, 1)")
        db.commit()
        assert [r.parsed for r in facts.update(config, clients)] == [0, 1, 1]
        same(spark, facts, config, clients)
        assert {r.model_id for r in facts.read(["grok"]).collect()} == {"grok-9", "grok-unknown"}
        (home / ".config/cursor-cache/events.json").unlink()
        (home / ".config/cursor-cache/usage.csv").write_text("Date,Model,Input With Cache,Input Without Cache,Cache Read,Output,Total,Cost\n2023-11-15T00:00:00Z,o3,3,2,1,4,10,Included\n")
        assert [r.parsed for r in facts.update(config, clients)] == [1, 0, 0]
        same(spark, facts, config, clients)


def test_roots_of_variables_and_options(monkeypatch, tmp_path):
    for name, path in (("HERMES_HOME", "/h"), ("GROK_HOME", "/g"), ("COPILOT_OTEL_FILE_EXPORTER_PATH", "/c.jsonl"), ("PI_CODING_AGENT_DIR", "/pi"), ("CODEX_HOME", "/x"), ("XDG_DATA_HOME", "/d")):
        monkeypatch.setenv(name, path)
    config = config_of("/home", 1, ["grok=/other", "codex=/one", "codex=/two", "codex_exports=/three"])
    assert config.roots == {"grok": ["/other"], "codex": ["/one", "/two"], "codex_exports": ["/three"], "hermes": ["/h"], "copilot_exporter": ["/c.jsonl"], "omp": ["/pi"]}
    assert (config.codex_home, config.data_home) == ("/x", "/d")
    with pytest.raises(ValueError):
        config_of("/home", 1, ["nobody=/x"])


def test_exporter_file(spark, tmp_path):
    attrs = {"gen_ai.usage.input_tokens": 5, "gen_ai.request.model": "gpt-5"}
    put(tmp_path / "out/spans.jsonl", {"traceId": "t", "spanId": "s", "endTime": [1700000000, 0], "attributes": attrs})
    config = Config(home=str(tmp_path), now_ms=T0, roots={"copilot_exporter": [f"{tmp_path}/out/spans.jsonl"]})
    assert [r.dedup_key for r in logs.copilot(spark, config).collect()] == ["copilot:t:s"]


def test_every_client_keeps_its_units(spark, tmp_path, facts):
    """Units of messages are those of the manifest, for sources that fold and that read several kinds of file, too."""
    config = Config(home=str(tmp_path), now_ms=T0)
    count = {"timestamp": "2023-11-14T22:13:20Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100}}}}
    put(tmp_path / ".codex/sessions/2024/s.jsonl", count)
    put(tmp_path / ".gemini/tmp/a/b.jsonl", {"type": "gemini", "id": "x", "model": "g", "tokens": {"input": 1}})
    put(tmp_path / ".omp/agent/sessions/d/e.jsonl", {"type": "message", "id": "i", "message": {"role": "assistant", "usage": {"input": 3}}})
    clients = ["codex", "gemini", "omp"]
    assert [r.parsed for r in facts.update(config, clients)] == [1, 1, 1]
    assert same(spark, facts, config, clients) == 3
