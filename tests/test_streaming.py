import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from meterglass.operators import trace
from meterglass.streaming import live, tail

NOW = 1_700_000_000_000


def read_from(data):
    return lambda a, b: data[a:b]


@given(st.lists(st.sampled_from(['{"a": 1}', '{"b": "x"}', "junk", "[1,", "{}"]), max_size=8), st.lists(st.integers(0, 80), max_size=5), st.booleans())
def test_every_line_once_however_it_is_cut(lines, cuts, ended):
    data = ("\n".join(lines) + ("\n" if ended and lines else "")).encode()
    points = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
    got = [x for a, b in zip(points, points[1:]) for x in tail.grown_lines(read_from(data), a, b)]
    want, at = [], 0
    for i, line in enumerate(lines):
        last = i == len(lines) - 1 and not ended
        if not last or tail.complete(line.encode()):
            want.append((at, line.encode()))
        at += len(line) + 1
    whole = [w for w in want if w[1]]
    assert [g for g in got if tail.complete(g[1])] == [w for w in whole if tail.complete(w[1])]


class Stream:
    """A client's stream into the state of the last hour, batch by batch."""

    def __init__(self, spark, client, root, tmp, **options):
        self.spark, self.checkpoint = spark, str(tmp / f"ck-{client}")
        self.query = live.follow(live.live_events(spark, client, str(root), NOW, **options), self.checkpoint, NOW)

    def tick(self):
        self.query.processAllAvailable()
        return [tuple(r) for r in trace.retained(live.hour(self.spark, self.checkpoint), NOW).select("agent", "model", trace.event_tokens(), "ts_ms").orderBy("ord").collect()]


@pytest.fixture
def stream(spark, tmp_path):
    opened = []

    def start(client, **options):
        s = Stream(spark, client, tmp_path / "logs", tmp_path, **options)
        opened.append(s)
        return s

    (tmp_path / "logs").mkdir()
    yield start
    for s in opened:
        s.query.stop()


def add(path, *rows, newline=True, age_s=0, mode="a"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r)) + ("\n" if newline else ""))
    os.utime(path, (NOW // 1000 - age_s,) * 2)


def said(id_, n, **more):
    return {"type": "assistant", "timestamp": "2023-11-14T22:13:10Z", "requestId": "r", "message": {"id": id_, "model": "Claude-Sonnet-4-20250514", "usage": {"input_tokens": n, "output_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}}, **more}


def test_claude_growth_partial_lines_merge_and_shrink(stream, tmp_path):
    log = tmp_path / "logs/a/x.jsonl"
    add(log, said("m1", 10))
    s = stream("claude")
    assert s.tick() == [("main", "claude-sonnet-4", 20, NOW - 10_000)]
    whole = json.dumps(said("m2", 1, isSidechain=True, agentId="7"))
    add(log, whole[:30], newline=False)
    assert len(s.tick()) == 1
    add(log, whole[30:], newline=False)
    assert s.tick()[1] == ("subagent:7", "claude-sonnet-4", 11, NOW - 10_000)
    add(log, "", said("m1", 50))
    assert [r[2] for r in s.tick()] == [60, 11]  # a repeat raises the first event's fields
    add(log, said("m9", 1), mode="w")
    assert sorted(r[2] for r in s.tick()) == [11, 11, 60]


def test_cold_files_wait_for_growth(stream, tmp_path):
    log = tmp_path / "logs/old.jsonl"
    add(log, said("m1", 10), age_s=7 * 3600)
    s = stream("claude")
    assert s.tick() == []
    add(log, said("m2", 10))
    assert len(s.tick()) == 1


def test_codex_threads_the_model(stream, tmp_path):
    log = tmp_path / "logs/c.jsonl"
    use = lambda i, c: {"timestamp": "2023-11-14T22:13:10Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": 1}}}}
    add(log, use(9, 0), {"type": "turn_context", "payload": {"model": "GPT-5.5"}})
    s = stream("codex")
    assert s.tick() == [("main", "unknown", 10, NOW - 10_000)]
    add(log, use(100, 40))
    assert s.tick()[1] == ("main", "gpt-5.5", 101, NOW - 10_000)


def total(n, ms=0):
    return {"params": {"_meta": {"totalTokens": n, "agentTimestampMs": NOW - 1000 + ms}}}


def test_grok_deltas(stream, tmp_path):
    add(tmp_path / "logs/s/updates.jsonl", *[total(n, i) for i, n in enumerate((100, 250, 250, 300))])
    add(tmp_path / "logs/t/updates.jsonl", total(500), age_s=8 * 3600)
    s = stream("grok")
    assert [r[2] for r in s.tick()] == [100, 150, 50]
    add(tmp_path / "logs/t/updates.jsonl", *[total(n) for n in (500, 120, 200, 520)])
    assert sorted(r[2] for r in s.tick()) == [20, 50, 100, 150]


def test_omp_and_expiry(stream, tmp_path):
    call = lambda ts, n: {"type": "message", "message": {"role": "assistant", "model": "m", "timestamp": ts, "responseId": f"r{ts}", "usage": {"input": n}}}
    add(tmp_path / "logs/2026_a/Task.jsonl", call(NOW - 5000, 7), call(NOW - 3_700_000, 9))
    assert stream("omp").tick() == [("subagent:Task", "m", 7, NOW - 5000)]


def event(ts, n, key=None, ord_="a"):
    return (ts, "c", "main", "m", n, 0, 0, 0, key, ord_)


def test_the_hour_is_merged_and_ends_across_batches_and_restarts(spark, tmp_path):
    src, checkpoint = tmp_path / "in", str(tmp_path / "ck")

    def tick(*rows):
        spark.createDataFrame(rows, live.EVENT).coalesce(1).write.mode("append").parquet(str(src))
        live.follow(spark.readStream.schema(live.EVENT).parquet(str(src)), checkpoint, NOW, availableNow=True).awaitTermination()  # each tick a restart
        return sorted((r.key, r.ord, r.ts_ms - NOW, r.input) for r in live.hour(spark, checkpoint).collect() if r.key is not None) + sorted((r.ord, r.ts_ms - NOW, r.input) for r in live.hour(spark, checkpoint).collect() if r.key is None)

    assert live.hour(spark, checkpoint).count() == 0
    assert tick(event(NOW - 7_000_000, 1, "k1", "a"), event(NOW - 6_000_000, 5, "k2", "b"), event(NOW - 6_000_000, 7, None, "c"), event(NOW - 5_000_000, 2, "k2", "d")) == [("k1", "a", -7_000_000, 1), ("k2", "b", -6_000_000, 5), ("c", -6_000_000, 7)]
    # a repeat raises its first event's tokens; the watermark, an hour behind, ends k1
    assert tick(event(NOW - 5_000_000, 9, "k2", "e"), event(NOW - 3_000_000, 4, None, "f")) == [("k2", "b", -6_000_000, 9), ("c", -6_000_000, 7), ("f", -3_000_000, 4)]
    # an event that claims to be of tomorrow moves the watermark to now only
    assert tick(event(NOW + 86_400_000, 3, "k3", "g"), event(NOW, 1, None, "h")) == [("k3", "g", 86_400_000, 3), ("f", -3_000_000, 4), ("h", 0, 1)]
    assert tick(event(NOW - 6_000_000, 1, "late", "i")) == [("k3", "g", 86_400_000, 3), ("f", -3_000_000, 4), ("h", 0, 1)]


def test_a_run_of_lines_ends_what_its_lines_put_past_the_hour(spark, tmp_path):
    def tick(name, *calls):
        add(tmp_path / f"logs/s/{name}.jsonl", *[{"type": "message", "message": {"role": "assistant", "model": "m", "timestamp": NOW - ms, "responseId": f"r{ms}", "usage": {"input": 1}}} for ms in calls])
        live.follow(live.live_events(spark, "omp", str(tmp_path / "logs"), NOW), str(tmp_path / "ck"), NOW, availableNow=True).awaitTermination()  # each tick a restart
        return sorted(NOW - r.ts_ms for r in live.hour(spark, str(tmp_path / "ck")).collect())

    assert tick("a", 3_700_000, 3_602_500, 3_601_000, 3_000) == [3_000, 3_601_000, 3_602_500]
    # the latest event is the last to come: what it puts past the hour is gone at the end of the same run
    assert tick("b", 2_000, 3_601_500) == [2_000, 3_000, 3_601_000, 3_601_500]
    assert tick("c", 0) == [0, 2_000, 3_000]
    assert tick("c") == [0, 2_000, 3_000]


def test_publish_on_change(spark):
    rows, sent = [[1], [1], [2]], []
    view = iter(rows)
    p = live.PublishOnChange(lambda: spark.createDataFrame([tuple(next(view))], "x int"), sent.append)
    assert [p(), p(), p()] == [True, False, True] and sent == [[(1,)], [(2,)]]


def sessions_file(path, *rows, model="M-20250514", wal=False):
    import sqlite3

    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    if wal:
        db.execute("PRAGMA journal_mode = WAL")
    db.execute("CREATE TABLE IF NOT EXISTS sessions (id TEXT PRIMARY KEY, model TEXT, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens)")
    for id_, n, m in rows:
        db.execute("INSERT OR REPLACE INTO sessions VALUES (?, ?, ?, ?, NULL, 0)", (id_, model, n, m))
    db.commit()
    return db if wal else db.close()


def test_session_counters(spark, tmp_path):
    """Snapshots between restarts: the first is the base, new sessions count in full, what fell counts nothing."""
    file = tmp_path / "logs/state.db"

    def tick(*rows, **more):
        held = sessions_file(file, *rows, **more)
        events = live.live_events(spark, "hermes", str(file.parent), NOW)
        out = str(tmp_path / "out")
        events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out).awaitTermination()
        if held:
            held.close()
        return sorted((r.ord.split(":")[1], r.model, r.input, r.output) for r in spark.read.schema(live.EVENT).parquet(out).collect())

    assert tick(("a", 10, 1), ("x", 5, 0)) == []
    one = [("a", "m", 5, 0), ("b", "m", 4, 2)]
    assert tick(("a", 15, 1), ("b", 4, 2)) == one
    assert tick() == one
    assert tick(("a", 2, 3), ("c", "many", 1)) == sorted([*one, ("a", "m", 0, 2)])  # fields stand alone; a wrong class isn't read
    assert tick(("a", 5, 3), ("x", 5, 0)) == sorted([*one, ("a", "m", 0, 2), ("a", "m", 3, 0)])
    assert tick(("x", 6, 0), wal=True)[-1] == ("x", "m", 1, 0)  # committed in the write-ahead log only


def test_session_counters_without_databases(spark, tmp_path):
    from meterglass.streaming.sessions import CountersReader

    (tmp_path / "state.db").mkdir()
    reader = CountersReader({"path": str(tmp_path)})
    cold = reader.latestOffset()
    assert cold == {"looks": {}} and reader.partitions(reader.initialOffset(), cold) == []
    (tmp_path / "state.db").rmdir()
    (tmp_path / "state.db").write_text("no database")
    part, = reader.partitions(cold, reader.latestOffset())  # it came after the first batch: no base
    assert not part.base and list(reader.read(part)) == []


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_growth_is_read_in_steps(step, monkeypatch):
    monkeypatch.setattr(tail, "STEP", step)
    asked, data = [], b'{"a": 1}\n' + b'{"b": "' + b"x" * 300 + b'"}\nhalf'

    def read(a, b):
        asked.append(b - a)
        return data[a:b]

    assert [x for _, x in tail.grown_lines(read, 0, len(data))] == [b'{"a": 1}', b'{"b": "' + b"x" * 300 + b'"}']
    assert max(asked) <= max(step, 1)


def test_counters_and_models_go_on_after_a_file_shrank(stream, tmp_path):
    """A file that shrank begins anew once: what grows after that keeps its model and mark."""
    log = tmp_path / "logs/s/updates.jsonl"
    total = lambda n, **more: {"params": {"_meta": {"totalTokens": n, "agentTimestampMs": NOW - 5000}}, **more}
    add(log, total(100, modelId="grok-4"), total(130))
    s = stream("grok")
    assert sorted(r[1:3] for r in s.tick()) == [("grok-4", 30), ("grok-4", 100)]
    add(log, total(10, modelId="grok-3"), mode="w", age_s=-1)
    assert sorted(r[1:3] for r in s.tick()) == [("grok-3", 10), ("grok-4", 30), ("grok-4", 100)]
    add(log, total(25), age_s=-2)
    assert sorted(r[1:3] for r in s.tick()) == [("grok-3", 10), ("grok-3", 15), ("grok-4", 30), ("grok-4", 100)]
    assert [r[2] for r in s.tick()] == [100, 30, 10, 15]  # in the order of their lives


def test_panes_and_windows(spark, tmp_path):
    """Every window against the events in it; the stream's panes are the batch's."""
    import random

    rng = random.Random(4)
    rows = [(NOW + rng.randint(0, 2_000_000), rng.choice("cd"), "main", rng.choice("mn"), rng.randint(1, 9), 0, 0, 0, None, str(i)) for i in range(300)]
    events = spark.createDataFrame(rows, live.EVENT)
    sums = trace.panes(events)
    events.write.parquet(str(tmp_path / "in"))
    query = live.pane_sums(spark.readStream.schema(live.EVENT).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("panes").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["pane", "client", "agent", "model", "tokens", "messages"]
    assert sorted(map(tuple, spark.table("panes").select(*columns).collect())) == sorted(map(tuple, sums.select(*columns).collect()))
    for seconds in (60, 600):
        for r in trace.sliding(sums, seconds).collect():
            end = (r.pane + 1) * 5000
            own = [x[4] for x in rows if (x[1], x[3]) == (r.client, r.model) and end - seconds * 1000 <= x[0] < end]
            assert (r.tokens, r.messages) == (sum(own), len(own)) and abs(r.tokens_per_min - sum(own) * 60 / seconds) < 1e-3


def ranges(reader, start, end):
    return [(os.path.basename(p.file), p.start, p.end, p.from_zero) for p in reader.partitions(start, end)]


def engine(reader, start=None):
    """As a query asks: the latest offset first, the initial one for a new query, then the ranges between."""
    end = reader.latestOffset()
    start = reader.initialOffset() if start is None else start
    return end, ranges(reader, start, end)


def options(tmp_path, **more):
    return {"path": str(tmp_path / "logs"), "suffix": ".jsonl", "now_ms": str(NOW), **{k: str(v) for k, v in more.items()}}


def test_batches_are_bounded_shared_and_go_on_after_restarts(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SHARE", 1)
    for name, n in (("a", 1000), ("b", 10), ("c", 300)):
        add(tmp_path / f"logs/{name}.jsonl", "x" * (n - 1))
    add(tmp_path / "logs/old.jsonl", "x" * 99, age_s=9 * 3600)
    o = options(tmp_path, batch_bytes=300, progress=tmp_path / "note")
    reader, at, got = tail.TailReader(o), None, []
    for k in range(20):
        if k % 2:  # a restart: nothing is held but the note and the query's own offset
            reader = tail.TailReader(o)
        at, some = engine(reader, at)
        if not some:
            break
        assert sum(e - s for _, s, e, _ in some) <= 300 and all(zero for *_, zero in some)
        got += some
    for name, n in (("a", 1000), ("b", 10), ("c", 300)):  # every byte once, in order
        own = [(s, e) for f, s, e, _ in got if f == f"{name}.jsonl"]
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    assert not any(f == "old.jsonl" for f, *_ in got)
    add(tmp_path / "logs/old.jsonl", "x" * 9)
    at, some = engine(reader, at)
    assert some == [("old.jsonl", 100, 110, False)]
    add(tmp_path / "logs/a.jsonl", "y" * 4, mode="w")  # shrank: a new life
    new, some = engine(reader, at)
    assert some == [("a.jsonl", 0, 5, True)] and reader.partitions(at, new)[0].epoch > NOW
    assert engine(reader, new)[1] == []


def test_restart_without_a_note_keeps_lives(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SHARE", 1)
    log = tmp_path / "logs/a.jsonl"
    add(log, "x" * 9)
    o = options(tmp_path, batch_bytes=4)
    first = tail.TailReader(o)
    at, some = engine(first)
    assert some == [("a.jsonl", 0, 10, True)]  # nothing is known before a first batch: no bound
    life = first.partitions({}, at)[0].epoch
    add(log, "y" * 9)
    again = tail.TailReader(o)
    at2, some = engine(again, at)
    assert some == [("a.jsonl", 10, 20, False)]
    assert again.partitions(at, at2)[0].epoch == 0 < life  # the fold takes 0 as the life that it knows
    add(log, "z" * 9)
    assert [r[1:3] for r in engine(again, at2)[1]] == [(20, 24)]


def test_growth_is_cut_into_pieces(spark, tmp_path, monkeypatch):
    """A line counts to the piece in which it ends: the same rows however small pieces are."""
    log = tmp_path / "logs/a.jsonl"
    add(log, *[said(f"m{i}", i + 1) for i in range(200)])
    reader = tail.TailReader(options(tmp_path))
    whole = [r for p in reader.partitions({}, engine(reader)[0]) for r in reader.read(p)]
    monkeypatch.setattr(tail, "PIECE", 777)
    reader = tail.TailReader(options(tmp_path))
    parts = reader.partitions({}, engine(reader)[0])
    assert len(parts) == -(-log.stat().st_size // 777) and [r for p in parts for r in reader.read(p)] == whole and len(whole) == 200
    log.unlink()
    assert list(reader.read(parts[0])) == []


@pytest.mark.parametrize("client", ["grok", "codex"])
def test_bounded_batches_give_the_same_events(stream, tmp_path, client):
    """State goes from batch to batch: the fold of a file cut into many equals one batch's."""
    use = lambda i: {"timestamp": "2023-11-14T22:13:10Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i}}}}
    model = lambda i: {"type": "turn_context", "payload": {"model": f"m{i}"}}
    rows = [total(10 * i) for i in range(1, 40)] if client == "grok" else [r for i in range(1, 20) for r in (model(i), use(i))]
    add(tmp_path / "logs/s/updates.jsonl", *rows)
    found = stream(client, batch_bytes=700, progress=tmp_path / "note").tick()
    assert [r[2] for r in found] == ([10] * 39 if client == "grok" else list(range(1, 20)))
    assert [r[1] for r in found] == (["unknown"] * 39 if client == "grok" else [f"m{i}" for i in range(1, 20)])


def test_tiered_scan(tmp_path, monkeypatch):
    from meterglass.streaming import scan

    monkeypatch.setattr(scan, "RACY_NS", 0)
    root, now = tmp_path / "logs", NOW
    for d in range(30):
        add(root / f"d{d}/s/x.jsonl", "{}", age_s=3600)
    add(root / "hot/s/x.jsonl", "{}")
    s = scan.TieredScan(str(root), ["*.jsonl"])
    assert len(s.files(now)) == 31
    everything = s.looked
    sizes = lambda at: {os.path.relpath(f, root): size for f, (size, _) in s.files(at).items()}
    sizes(now)
    assert s.looked < everything  # the root's entries, the folder of the active file and the file
    add(root / "hot/s/x.jsonl", "{}")
    assert sizes(now + 5000)["hot/s/x.jsonl"] == 6
    add(root / "hot/s/y.jsonl", "{}", age_s=3600)  # beside an active file
    add(root / "new/deep/er/z.jsonl", "{}")  # a new folder, with all below it
    add(root / "d3/top.jsonl", "{}")  # a folder of the root has a new time
    found = sizes(now + 10_000)
    assert {"hot/s/y.jsonl", "new/deep/er/z.jsonl", "d3/top.jsonl"} <= set(found)
    add(root / "d7/s/x.jsonl", "{}")  # it slept: seen late, not lost
    assert sizes(now + 15_000)["d7/s/x.jsonl"] == 3
    assert sizes(now + 60_000)["d7/s/x.jsonl"] == 6
    (root / "hot/s/x.jsonl").unlink()
    (root / "new").rename(tmp_path / "away")
    found = sizes(now + 65_000)
    assert "hot/s/x.jsonl" not in found and "new/deep/er/z.jsonl" not in found and len(found) == 32
    assert found == {os.path.relpath(e, root): os.stat(e).st_size for e in map(str, root.rglob("*.jsonl"))}


def test_cadence_under_a_clock():
    """At once, then at most each 180 s, only changes, down to 0, then silence."""
    from meterglass.streaming import publish

    start = NOW - NOW % 5000
    panes, last, sent, timer = {start // 5000: 10}, publish.NEVER, [], 0
    arrivals = {5_000: 7, 300_000: 1, 1_500_000: 4}
    for at in range(0, 2_400_000, 5_000):  # a tick is 5 s
        if at in arrivals:
            pane = (start + at) // 5000
            panes[pane] = panes.get(pane, 0) + arrivals[at]
        elif at and (not timer or start + at < timer):
            continue  # neither rows nor a timer
        panes, last, send = publish.decided(panes, last, start + at, 180_000, 600)
        timer = last[2]
        if send is not None:
            sent.append((at, send))
    # 10 at once; 7 more wait for 180 s, 1 for 360; the first two have left by 720; that of 300 s is in the window until 900 s and missed at 1,080; a start after 0 is told at once
    assert sent == [(0, 10), (180_000, 17), (360_000, 18), (720_000, 1), (1_080_000, 0), (1_500_000, 4), (2_220_000, 0)]
    assert panes == {} and timer == 0


def test_rates_go_on_after_a_restart(spark, tmp_path):
    import time

    src, checkpoint, sent = tmp_path / "in", str(tmp_path / "ck"), []
    now = int(time.time() * 1000)

    def run(until, *rows):
        spark.createDataFrame(rows, live.EVENT).coalesce(1).write.mode("append").parquet(str(src))
        query = live.follow(spark.readStream.schema(live.EVENT).parquet(str(src)), checkpoint, None, lambda found: sent.extend(r.tokens for r in found), 1000, 3600, processingTime="1 second")
        for _ in range(120):
            if query.exception() or (until(query) and len(query.recentProgress) > 2):
                break
            time.sleep(0.5)
        query.stop()
        assert not query.exception()

    run(lambda q: len(sent) == 1, event(now, 5, "k"))
    run(lambda q: len(sent) == 2, event(now, 9, "k", "b"), event(now, 1, None, "c"))  # a repeat adds what it raises
    run(lambda q: len(q.recentProgress) > 5, event(now, 3, "k", "d"))  # no change, no rate
    assert sent == [5, 10]
    assert sorted(r.input for r in live.hour(spark, checkpoint).collect()) == [1, 9]


def test_small_files_share_tasks(tmp_path):
    """Many files are read by a bounded number of tasks, every line once."""
    for k in range(500):
        add(tmp_path / f"logs/{k}.jsonl", f'{{"k": {k}}}', "{}")
    reader = tail.TailReader(options(tmp_path))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) <= 2 * tail.TASKS
    assert sorted(os.path.basename(r[0]) for p in parts for r in reader.read(p)) == sorted(f"{k}.jsonl" for k in range(500) for _ in range(2))
    (tmp_path / "logs/7.jsonl").unlink()  # the others of its task are still read
    assert sum(1 for p in parts for _ in reader.read(p)) == 998
