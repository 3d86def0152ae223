import json
import os
import sqlite3

import pytest

from meterglass.operators import messages, rollup
from meterglass.sources import logs
from meterglass.sources.files import Config

T0 = 1700000000000


def write(path, *rows, text=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if text is not None else "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    os.utime(path, (1700000500, 1700000500))
    return path


def got(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("ord").collect()]


@pytest.fixture
def config(tmp_path):
    return Config(home=str(tmp_path), now_ms=T0)


def claude_line(id_, req, n, model="Claude-Sonnet-4", **more):
    return {"type": "assistant", "timestamp": "2023-11-14T22:13:20Z", "requestId": req, "message": {"id": id_, "model": model, "usage": {"input_tokens": n, "output_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}}, **more}


def test_claude(spark, config, tmp_path):
    write(tmp_path / ".claude/projects/a/x.jsonl", claude_line("m1", "r1", 10), "not json", claude_line("m1", "r1", 25, model="other"), claude_line("m2", None, 1), {"type": "user"}, claude_line("m3", "r3", "7"))
    df = logs.claude(spark, config)
    assert got(df, "model_id", "input", "output", "dedup_key", "date") == [
        ("claude-sonnet-4", 25, 5, "claude:m1:r1", "2023-11-14"), ("claude-sonnet-4", 1, 5, None, "2023-11-14"), ("claude-sonnet-4", 7, 5, "claude:m3:r3", "2023-11-14"),
    ]


def usage(i, o=0, c=0, r=0, t=None):
    return {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c, "reasoning_output_tokens": r, **({"total_tokens": t} if t is not None else {})}


def counter(total=None, last=None, **more):
    return {"timestamp": "2023-11-14T22:13:20Z", "type": "event_msg", "payload": {"type": "token_count", "info": {**({"total_token_usage": total} if total else {}), **({"last_token_usage": last} if last else {}), **more}}}


META = {"type": "session_meta", "payload": {"model_provider": "openai"}}
TURN = {"type": "turn_context", "payload": {"model_info": {"slug": "gpt-5.5"}}}


def test_codex_repeat(spark, config, tmp_path):
    write(tmp_path / ".codex/sessions/s.jsonl", META, TURN, counter(usage(100, 10, 20), usage(100, 10, 20)), counter(usage(100, 10, 20), usage(100, 10, 20)))
    assert got(logs.codex(spark, config), "model_id", "input", "cache_read", "output") == [("gpt-5.5", 80, 20, 10)]


def test_codex_homes(spark, tmp_path):
    for n, folder in enumerate(("h/sessions", ".local/share/orca/codex-runtime-home/r1/sessions", "exports/codex", ".codex/sessions"), 1):
        write(tmp_path / folder / "s.jsonl", TURN, counter(usage(n * 100)))
    config = Config(home=str(tmp_path), now_ms=T0, codex_home=f"{tmp_path}/h", roots={"codex_exports": [f"{tmp_path}/exports/codex"]})
    assert sorted(got(logs.codex(spark, config), "input")) == [(100,), (200,), (300,)]
    assert got(logs.codex(spark, Config(home=str(tmp_path), roots={"codex": [f"{tmp_path}/.codex", f"{tmp_path}/.codex/"]})), "input") == [(400,)]


def test_bad_line(spark, tmp_path):
    path = write(tmp_path / ".claude/projects/a/x.jsonl", claude_line("m1", "r", 1), claude_line("m2", "r", 2), claude_line("m3", "r", 3))
    path.write_bytes(path.read_bytes().replace(b'"m2"', b'"\xff\xfe"'))
    write(tmp_path / ".claude/projects/a/y.jsonl", claude_line("m4", "r", 4))
    assert got(logs.claude(spark, Config(home=str(tmp_path))), "input") == [(1,), (3,), (4,)]
    assert got(logs.claude(spark, Config(home=str(tmp_path), stop_at_bad_line=True)), "input") == [(1,), (4,)]


def test_codex_stale(spark, config, tmp_path):
    write(tmp_path / ".codex/sessions/s.jsonl", TURN, *[counter(usage(t), usage(n)) for t, n in ((1000, 100), (990, 50), (1060, 60))])
    assert sum(r[0] for r in got(logs.codex(spark, config), "input")) == 160


def test_codex_fork(spark, config, tmp_path):
    fork = {"type": "session_meta", "payload": {"forked_from_id": "p"}}
    write(tmp_path / ".codex/sessions/s.jsonl", fork, counter(usage(1000, t=1000), usage(1000)), TURN, counter(usage(1000, t=1000), usage(5)), counter(usage(1100, t=1100), usage(100)))
    assert got(logs.codex(spark, config), "input") == [(100,)]


def test_codex_split_and_delta(spark, config, tmp_path):
    write(tmp_path / ".codex/sessions/s.jsonl", TURN, counter(usage(100, 20, 30, 5)), counter(usage(150, 20, 30, 5)), counter(usage(10)), counter(usage(40)))
    assert got(logs.codex(spark, config), "input", "cache_read", "output", "reasoning") == [(70, 30, 20, 5), (50, 0, 0, 0), (30, 0, 0, 0)]


def test_codex_copies_collapse(spark, config, tmp_path):
    for d in ("sessions", "archived_sessions"):
        write(tmp_path / f".codex/{d}/s.jsonl", TURN, counter(usage(100, 10)))
    assert messages.dedup(logs.codex(spark, config)).count() == 1


EVENT = {"timestamp_ms": T0, "model": "gpt-5", "input_tokens": 5, "output_tokens": 6, "cache_read_tokens": 7, "cost": 1}


def test_cursor(spark, config, tmp_path):
    root = tmp_path / ".config/cursor-cache"
    wide = "Date,User,Kind,Max Mode,Model,Provider,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output,Total Tokens,Cost\n"
    write(root / "usage.csv", text=wide + '2023-11-14,u,K,No,"gpt-5",p,"30","10",5,6,51,"$1,234.50"\n2023-11-14,u,K,No,,p,1,1,1,1,1,1\n')
    write(root / "usage.old.csv", text="Date,Model,Input With Cache,Input Without Cache,Cache Read,Output,Total,Cost\n2023-11-15T00:00:00Z,o3,3,2,1,4,10,Included\n")
    assert got(logs.cursor(spark, config), "model_id", "input", "cache_write", "cache_read", "output", "cost", "dedup_key") == [
        ("gpt-5", 10, 20, 5, 6, 1234.5, "cursor:usage:2023-11-14"), ("o3", 2, 1, 1, 4, 0.0, "cursor:usage.old:2023-11-15T00:00:00Z"),
    ]
    write(root / "events.json", text=json.dumps({"events": [EVENT, {**EVENT, "timestamp_ms": 0}]}))
    assert got(logs.cursor(spark, config), "model_id", "input", "dedup_key") == [("gpt-5", 5, f"cursor:{T0}:5:6")]
    write(root / "events.json", text=json.dumps({"events": [EVENT, {**EVENT, "cost": "x"}]}))
    assert logs.cursor(spark, config).count() == 2  # one bad event: back to CSV


def test_opencode(spark, config, tmp_path):
    root = tmp_path / ".local/share/opencode"
    root.mkdir(parents=True)
    db = sqlite3.connect(root / "opencode.db")
    db.execute("CREATE TABLE message (id, session_id TEXT, data TEXT)")
    said = {"role": "assistant", "modelID": "claude-sonnet-4", "time": {"created": T0}, "cost": 0.5, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}}
    db.executemany("INSERT INTO message VALUES (?, ?, ?)", [("m1", "s", json.dumps(said)), ("m2", "s", json.dumps({**said, "role": "user"})), ("m3", None, json.dumps({**said, "id": "x"})), (4, "s", json.dumps(said))])
    db.commit()
    db.close()
    write(root / "storage/message/s/m1.json", text=json.dumps(said))
    df = logs.opencode(spark, config)
    assert got(df, "dedup_key", "provider_id", "input", "reasoning", "cache_write") == [("m1", "anthropic", 1, 3, 5), ("opencode:x", "anthropic", 1, 3, 5), ("m1", "anthropic", 1, 3, 5)]
    assert messages.dedup(df).count() == 2


def gem(id_, n, **tokens):
    return {"type": "gemini", "id": id_, "timestamp": "2023-11-14T22:13:20Z", "tokens": {"input": n, "output": 5, **tokens}}


def test_gemini_lines(spark, config, tmp_path):
    write(tmp_path / ".gemini/tmp/a.jsonl", {"sessionId": "s1", "model": "gemini-2.5-pro"}, gem("m1", 1), gem("m2", 2), gem("m1", 9), gem(None, 4), {"stats": {"models": {"b": {"tokens": {"prompt": 10, "cached": 4}}, "a": {"tokens": {"candidates": 3}}}}})
    assert got(logs.gemini(spark, config), "model_id", "input", "dedup_key") == [
        ("gemini-2.5-pro", 9, "gemini:m1"), ("gemini-2.5-pro", 2, "gemini:m2"), ("gemini-2.5-pro", 4, "gemini:s1:2"), ("a", 0, None), ("b", 6, None),
    ]


def test_gemini_cache_and_documents(spark, config, tmp_path):
    write(tmp_path / ".gemini/tmp/b.json", text=json.dumps({"messages": [{**gem("x", 100, cached=40, thoughts=5, tool=3, total=113), "model": "g"}, {**gem("y", 100, cached=40, tool=3, total=158), "model": "g"}, {"type": "user"}]}))
    write(tmp_path / ".gemini/tmp/c.json", text=json.dumps({"model": "g2", "result": {"stats": {"input_tokens": 8}}}))
    assert got(logs.gemini(spark, config), "model_id", "input") == [("g", 63), ("g", 103), ("g2", 8)]


def test_copilot(spark, config, tmp_path):
    attrs = {"gen_ai.usage.input_tokens": 100, "gen_ai.usage.output_tokens": 7, "gen_ai.usage.cache_read.input_tokens": 30, "gen_ai.response.model": "gpt-5", "session.id": "s"}
    write(tmp_path / ".copilot/otel/o.jsonl", {"traceId": "t", "spanId": "p", "endTime": [1700000000, 5000000], "attributes": attrs}, "junk", {"timestamp": T0, "attributes": attrs}, {"attributes": {}})
    assert got(logs.copilot(spark, config), "input", "cache_read", "timestamp_ms", "dedup_key") == [(70, 30, T0 + 5, "copilot:t:p"), (70, 30, T0, f"copilot:s:{T0}:2")]


def test_amp_and_droid(spark, config, tmp_path):
    threads = tmp_path / ".local/share/amp/threads"
    write(threads / "T-1.json", text=json.dumps({"id": "t1", "created": T0, "usageLedger": {"events": [{"x": 1}, {"model": "claude-sonnet-4", "credits": 0.2, "tokens": {"input": 5}}]}, "messages": [{"role": "assistant", "usage": {"model": "m"}}]}))
    write(threads / "T-2.json", text=json.dumps({"id": "t2", "created": T0, "messages": [{"role": "assistant", "messageId": 3, "usage": {"model": "gpt-5", "inputTokens": 9}}, {"role": "user"}]}))
    assert got(logs.amp(spark, config), "dedup_key", "input", "timestamp_ms") == [("amp:t1:ledger:1", 5, T0), ("amp:t2:message:3", 9, T0 + 3000)]
    write(tmp_path / ".factory/sessions/a.settings.json", text=json.dumps({"model": "custom:GPT_5.5 Codex", "tokenUsage": {"inputTokens": 1, "thinkingTokens": 2}}))
    write(tmp_path / ".factory/sessions/b.settings.json", text=json.dumps({"providerLock": "google", "providerLockTimestamp": T0, "tokenUsage": {"inputTokens": 1}}))
    assert got(logs.droid(spark, config), "model_id", "provider_id", "timestamp_ms", "dedup_key") == [("gpt-5-5-codex", "unknown", 1700000500000, "droid:a.settings"), ("gemini-unknown", "google", T0, "droid:b.settings")]


def test_hermes(spark, config, tmp_path):
    (tmp_path / ".hermes").mkdir()
    db = sqlite3.connect(tmp_path / ".hermes/state.db")
    db.execute("CREATE TABLE sessions (id TEXT, model TEXT, started_at REAL, ended_at REAL, message_count INT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT, reasoning_tokens INT, billing_provider TEXT, estimated_cost_usd REAL, actual_cost_usd REAL)")
    db.executemany("INSERT INTO sessions VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?)", [("s1", "gpt-5", 1700000000.125, None, 4, 1, 2, 3, 4, 5, "OpenAI", 9, 1.25), ("s2", "claude", None, 1700000001.0, None, 1, 1, 1, 1, 1, None, 0.75, 0), ("s3", " ", 1, 1, 1, 1, 1, 1, 1, 1, "", 0, 0), ("s4", "m", 1.0, 1.0, 1, "x", 1, 1, 1, 1, "", 0, 0)])
    db.commit()
    db.close()
    rows = {r["dedup_key"]: r for r in logs.hermes(spark, config).collect()}
    assert set(rows) == {"hermes:s1", "hermes:s2"}
    s1, s2 = rows["hermes:s1"], rows["hermes:s2"]
    assert (s1["provider_id"], s1["timestamp_ms"], s1["reasoning"], s1["messages"], s1["cost"]) == ("openai", 1700000000125, 5, 4, 1.25)
    assert (s2["provider_id"], s2["timestamp_ms"], s2["messages"], s2["cost"]) == ("anthropic", 1700000001000, 1, 0.75)


def test_hermes_minimal(spark, config, tmp_path):
    (tmp_path / ".hermes").mkdir()
    db = sqlite3.connect(tmp_path / ".hermes/state.db")
    db.execute("CREATE TABLE sessions (id TEXT, model TEXT, started_at REAL, message_count INT, input_tokens INT, output_tokens INT, cache_read_tokens INT, cache_write_tokens INT)")
    db.execute("INSERT INTO sessions VALUES ('a', 'grok-4', 1700000000, 2, 1, 1, 1, 1)")
    db.commit()
    db.close()
    assert got(logs.hermes(spark, config), "provider_id", "messages", "reasoning", "cost") == [("xai", 2, 0, 0.0)]


def grok_line(total=None, user=False, ms=0, model=None):
    update = {"sessionUpdate": "user_message_chunk" if user else "agent", **({"content": {"_meta": {"modelId": model}}} if model else {})}
    return {"method": "session/update", "params": {"update": update, "_meta": {"agentTimestampMs": T0 + ms, **({"totalTokens": total} if total is not None else {})}}}


def grok(spark, config, tmp_path, *rows, **siblings):
    d = tmp_path / ".grok/sessions/ws/s1"
    write(d / "updates.jsonl", *rows)
    for name, doc in siblings.items():
        write(d / f"{name}.json", text=json.dumps(doc))
    return got(logs.grok(spark, config), "input", "timestamp_ms", "model_id", "dedup_key")


def test_grok_turns(spark, config, tmp_path):
    rows = [grok_line(100), grok_line(None, True, 1), grok_line(250, ms=2), grok_line(300, ms=3), grok_line(None, True, 4), grok_line(450, ms=5)]
    assert grok(spark, config, tmp_path, *rows, summary={"current_model_id": "grok-4"}) == [(200, T0 + 3, "grok-4", "grok:ws:s1:0"), (150, T0 + 5, "grok-4", "grok:ws:s1:1")]


def test_grok_dip_and_implicit_turn(spark, config, tmp_path):
    rows = [grok_line(t, ms=i) for i, t in enumerate((100, 150, 150, 120, 200))]
    assert grok(spark, config, tmp_path, *rows) == [(100, T0 + 4, "grok-unknown", "grok:ws:s1:0")]


def test_grok_backfill(spark, config, tmp_path):
    rows = [grok_line(None, True), grok_line(10, ms=1), grok_line(20, ms=2, model="grok-5"), grok_line(None, True, ms=3), grok_line(50, ms=4)]
    assert grok(spark, config, tmp_path, *rows) == [(20, T0 + 2, "grok-5", "grok:ws:s1:0"), (30, T0 + 4, "grok-5", "grok:ws:s1:1")]


def test_grok_fallback_and_signals(spark, config, tmp_path):
    signals = {"primaryModelId": "grok-4", "totalTokens": 171056, "totalTokensBeforeCompaction": 3224659, "contextTokensUsed": 172309}
    assert grok(spark, config, tmp_path, grok_line(171056), signals=signals) == [(171056, T0, "grok-4", "grok:ws:s1:0"), (3225912, T0, "grok-4", "grok:ws:s1:signals")]


def test_omp(spark, config, tmp_path):
    said = {"type": "message", "id": "e1", "timestamp": "2023-11-14T22:13:20Z", "message": {"role": "assistant", "provider": "openrouter", "model": "claude-sonnet-4", "usage": {"input": 1, "output": 2, "cost": {"total": 0.3}}}}
    base = tmp_path / ".omp/agent/sessions/-home"
    write(base / "2026_a.jsonl", said, {**said, "message": {**said["message"], "responseId": "r9", "timestamp": T0 + 1}})
    write(base / "2026_a/Task.jsonl", said)
    assert sorted(got(logs.omp(spark, config), "dedup_key", "provider_id", "timestamp_ms", "cost")) == sorted([("omp:2026_a:e1", "", T0, 0.3), ("omp:r9", "", T0 + 1, 0.3), ("omp:2026_a/Task:e1", "", T0, 0.3)])


def test_collect_to_payload(spark, config, tmp_path):
    write(tmp_path / ".claude/projects/a/x.jsonl", claude_line("m1", "r1", 10), claude_line("m1", "r1", 25))
    write(tmp_path / ".codex/sessions/s.jsonl", TURN, counter(usage(100, 10)))
    df = messages.enriched(logs.ingest(spark, config, str(tmp_path / "facts")))
    doc = json.loads(rollup.payload(df, "2023-11-15T00:00:00.000Z").first()["payload"])
    assert doc["summary"]["clients"] == ["claude", "codex"] and doc["summary"]["totalTokens"] == 145
    assert [c["client"] for c in doc["contributions"][0]["clients"]] == ["claude", "codex"]
    assert doc["contributions"][0]["intensity"] == 4 and doc["meta"]["dateRange"] == {"start": "2023-11-14", "end": "2023-11-14"}
    assert messages.enriched(logs.collect(spark, config, ["codex"])).count() == 1
    with pytest.raises(ValueError, match="invalid year filter"):
        messages.enriched(df, "20x4")


def test_sqlite_rows_in_the_write_ahead_log(spark, tmp_path):
    from meterglass.sources import sqlite

    root = tmp_path / "live"
    root.mkdir()
    db = sqlite3.connect(root / "opencode.db")
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
    db.execute("INSERT INTO message VALUES ('a', 's', '{}')")
    db.commit()
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.executemany("INSERT INTO message VALUES (?, 's', ?)", [(f"b{i:04}", "x" * 500) for i in range(300)])
    db.commit()
    assert (root / "opencode.db-wal").stat().st_size > 100_000
    other = sqlite3.connect(root / "opencode-2.db")  # all of it is in the log
    other.execute("PRAGMA journal_mode=WAL")
    other.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
    other.execute("INSERT INTO message VALUES ('c', 's', '{}')")
    other.commit()
    (root / "opencode-3.db").write_bytes(b"no database at all" * 100)
    got = sorted(r["id"] for r in sqlite.opencode_messages(spark, [str(root)]).collect())
    db.close()
    other.close()
    assert got == ["a", *(f"b{i:04}" for i in range(300)), "c"]
