import json
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterglass.__main__ import main
from meterglass.operators import derived, messages, rollup, stateful, trace

MESSAGE = "client string, model_id string, provider_id string, timestamp_ms long, date string, input long, output long, cache_read long, cache_write long, reasoning long, cost double, messages int, dedup_key string, ord long"


def facts(spark, rows):
    """rows: (client, model, date, input, cost, key)."""
    return spark.createDataFrame([(c, m, "", 1_700_000_000_000, d, n, 0, 0, 0, 0, float(usd), 1, k, i) for i, (c, m, d, n, usd, k) in enumerate(rows)], MESSAGE)


def test_dedup_before_validity(spark):
    df = facts(spark, [("claude", "m", "2024-01-01", 0, 0, "k"), ("claude", "m", "2024-01-02", 5, 0, "k"), ("codex", "m", "2024-01-01", 7, 0, None), ("codex", "m", "2024-01-03", 7, 1, None)])
    assert [r["ord"] for r in messages.dedup(df).orderBy("ord").collect()] == [0, 2]
    assert [r["ord"] for r in messages.valid(messages.dedup(df)).collect()] == [2]


def test_year_filter(spark):
    df = facts(spark, [("claude", "m", "2024-01-01", 1, 1, "a"), ("claude", "m", "2025-01-01", 1, 1, "b")])
    assert messages.by_year(df, " 2025 ").count() == 1 and messages.by_year(df, "").count() == 2
    for bad in ("25", "20255", "２０２５"):
        with pytest.raises(ValueError, match="invalid year filter"):
            messages.by_year(df, bad)


def test_saturation(spark):
    df = facts(spark, [("c", "m", "2024-01-01", 2**63 - 1, 1, "a"), ("c", "m", "2024-01-01", 2**63 - 1, 1, "b"), ("c", "m", "2024-01-01", -5, 1, "d")])
    row = rollup.daily_totals(df).first()
    assert row["tokens"] == row["input"] == 2**63 - 1


DAYS = [("claude", "2025-12-30", 100, 0.5), ("codex", "2025-12-31", 41, 0.75), ("claude", "2025-12-31", 1200, 9.0), ("claude", "2026-01-01", 100, 1.0), ("gemini", "2026-01-03", 50, 0.7), ("claude", "2026-01-05", 50, 1.0), ("droid", "2026-01-06", 0, 0.0)]


def client_days(spark, rows=DAYS):
    return spark.createDataFrame(rows, "client string, date string, tokens long, cost double")


def test_stats(spark):
    s = derived.stats(client_days(spark)).first()
    assert (s["total_tokens"], s["active_days"], s["best_day"], s["best_cost"], s["max_tokens"]) == (1541, 5, "2025-12-31", 9.75, 1241)
    assert (s["longest_streak"], s["current_streak"], s["present_clients"]) == (3, 0, ["claude", "codex", "gemini"])
    one = derived.stats(client_days(spark), ["claude"]).first()
    assert (one["total_tokens"], one["active_days"], one["average_per_day"]) == (1450, 4, pytest.approx(11.5 / 4)) and one["present_clients"] == ["claude", "codex", "gemini"]
    none = derived.stats(client_days(spark), []).first()
    assert (none["total_tokens"], none["best_day"], none["average_per_day"], none["longest_streak"], none["current_streak"]) == (0, None, 0.0, 0, 0)


def test_best_day_is_the_earliest_of_equals(spark):
    assert derived.stats(client_days(spark, [("a", "2026-01-02", 1, 3.0), ("a", "2026-01-01", 9, 3.0)])).first()["best_day"] == "2026-01-01"


def plain_streaks(active, start, end):
    longest = current = run = 0
    d = start
    while d <= end:
        run = run + 1 if d in active else 0
        longest, current = max(longest, run), run
        d += timedelta(days=1)
    return longest, current


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 20), max_size=15), st.integers(0, 20), st.integers(0, 20))
def test_streaks(spark, days, a, b):
    base = date(2024, 2, 20)
    rows = [((base + timedelta(days=d)).isoformat(), 1) for d in days] + [(base.isoformat(), 0)]
    df = spark.createDataFrame(rows, "date string, tokens long")
    start, end = base + timedelta(days=a), base + timedelta(days=b)
    got = derived.streaks(df, F.lit(start.isoformat()).cast("date"), F.lit(end.isoformat()).cast("date")).first()
    assert tuple(got) == plain_streaks({base + timedelta(days=d) for d in days}, start, end)


def test_grid(spark):
    assert derived.grid_columns(2024)[1] == 53 and derived.grid_columns(2000)[1] == 54 and derived.grid_columns(2026)[0] == "2025-12-28"
    df = spark.createDataFrame([("2026-04-07", 99, 1.0), ("2025-12-31", 7, 1.0)], "date string, tokens long, cost double")
    cells = derived.calendar_grid(df, 2026).orderBy("col", "row").collect()
    assert len(cells) == 371 and cells[0]["date"] == "2025-12-28" and cells[-1]["date"] == "2027-01-02"
    assert tuple(cells[100][:3]) == (14, 2, "2026-04-07") and cells[100]["active"] and cells[100]["tokens"] == 99
    assert cells[3]["tokens"] == 7 and not cells[3]["active"] and not cells[3]["in_year"]


def test_bars(spark):
    bars = derived.day_bars(client_days(spark))
    last = derived.trailing_bars(bars, "2026-01-02", 4).orderBy("date").collect()
    assert [(r["date"], r["total_tokens"], [s["client"] for s in r["segments"]]) for r in last] == [("2025-12-30", 100, ["claude"]), ("2025-12-31", 1241, ["claude", "codex"]), ("2026-01-01", 100, ["claude"]), ("2026-01-02", 0, [])]
    assert derived.trailing_bars(bars, "2026-01-02", 0).count() == 0


def test_intensity_and_narrow(spark):
    days = rollup.contributions(facts(spark, [("c", "m", f"2024-01-0{i}", 1, usd, f"k{i}") for i, usd in enumerate((4, 3, 2, 1, 0.5), 1)] + [("c", "m", "2025-01-01", 1, 0, "z")]))
    assert [r["intensity"] for r in days.orderBy("date").collect()] == [4, 4, 3, 2, 1, 0]
    assert rollup.narrow(days, "2025").first()["intensity"] == 0 and rollup.narrow(days, None).count() == 6


def test_summary_of_nothing(spark):
    s = rollup.summary(facts(spark, [])).first()
    assert (s["total_tokens"], s["total_days"], s["average_per_day"], s["start"], s["clients"]) == (0, 0, 0.0, "", [])
    assert json.loads(rollup.payload(facts(spark, []), "now").first()["payload"])["contributions"] == []


EVENT = "ts_ms long, client string, agent string, model string, input long, output long, cache_read long, cache_write long, key string, ord long"


def test_trace(spark):
    e = spark.createDataFrame([(1000, "codex-cli", "main", "unknown", 100, 0, 0, 0, None, 0), (2000, "codex-cli", "main", "gpt", 200, 50, 50, 0, None, 1), (2000, "claude-code", "subagent:a1", "m", 75, 0, 0, 0, None, 2), (9999, "claude-code", "main", "m", 75, 0, 0, 0, None, 3), (0, "x", "main", "m", 1, 0, 0, 0, None, 4)], EVENT)
    rows = trace.trace(e, 601_000, 600)
    got = trace.collapse(rows).orderBy(F.desc("tokens")).collect()
    assert [(r["client"], r["tokens"], r["messages"], r["agents"], r["models"]) for r in got] == [("codex", 400, 2, "main", "gpt"), ("claude", 150, 2, "main, subagent:a1", "m")]
    assert trace.rate(e, 61_000, 60).first()[0] == 550.0 and trace.rate(e, 0, 0).first()[0] == 0.0
    assert [(r["client"], r["bar_percent"], r["all_tokens"]) for r in trace.top(trace.collapse(rows), 1).collect()] == [("codex", 100.0, 550)]
    assert [tuple(r)[:3] for r in trace.sorted_trace(rows).collect()][0] == ("codex-cli", "main", "gpt")


def test_registry(spark):
    rows = spark.createDataFrame([("claude-code", 1), ("claude", 2), ("gemini-cli", 3), ("new-client", 4), ("omp", 5), (None, 6), ("kimi", 7)], "client string, place_before long")
    got = {r["place_before"]: (r["client"], r["registry_id"], r["place"], r["name"], r["color"]) for r in trace.styled(rows).collect()}
    assert got == {
        1: ("claude-code", "claude", 0, "Claude", "#d97706"), 2: ("claude", "claude", 0, "Claude", "#d97706"), 3: ("gemini-cli", "gemini", 4, "Gemini", "#60a5fa"), 4: ("new-client", "new-client", None, "New Client", "#6b7280"),
        5: ("omp", "omp", 10, "Omp", "#6b7280"), 6: (None, None, None, None, "#6b7280"), 7: ("kimi", "kimi", 13, "Kimi", "#fbbf24"),
    }
    clash = rows.withColumns({c: F.lit("own") for c in ("name", "color", "place", "registry_id")})
    assert {r["place_before"]: r["name"] for r in trace.styled(clash).collect()} == {k: v[3] for k, v in got.items()}
    idle = {r["client"]: r["place"] for r in trace.idle_clients(rows).collect()}
    assert not {"claude", "gemini", "omp", "kimi"} & set(idle) and idle["codex"] == 1 and len(idle) == trace.registry(spark).count() - 4
    assert trace.styled(rows.limit(0)).count() == 0


def test_merge_and_retention(spark):
    e = spark.createDataFrame([(5, "c", "a1", "m1", 1, 9, 0, 0, "k", 0), (7, "c", "a2", "m2", 4, 2, 0, 0, "k", 1), (9, "c", "a", "m", 1, 1, 0, 0, None, 2)], EVENT)
    got = trace.merged(e).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(5, "c", "a1", "m1", 4, 9, 0, 0, "k", 0), (9, "c", "a", "m", 1, 1, 0, 0, None, 2)]
    assert trace.retained(e, 3_600_007).count() == 2


class PlainTurns:
    """The rule told turn by turn."""

    def __init__(self):
        self.last, self.turn, self.done = None, None, []

    def line(self, opens, total, at):
        if opens:
            self.close()
            self.turn = [self.last or 0, self.last or 0, at]
        if total is None or self.last is not None and total < self.last:
            return
        if self.last is not None and total > self.last and self.turn is None:
            self.turn = [self.last, self.last, at]
        if self.turn and total > self.turn[1]:
            self.turn[1:] = [total, at]
        self.last, self.last_at = total, at

    def close(self):
        if self.turn and self.turn[1] > self.turn[0]:
            self.done.append((self.turn[1] - self.turn[0], self.turn[2]))
        self.turn = None

    def result(self):
        self.close()
        if not self.done and self.last:
            return [(self.last, self.last_at)]
        return self.done


LINE = st.tuples(st.booleans(), st.one_of(st.none(), st.integers(0, 40)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINE, max_size=12), min_size=20, max_size=60))
def test_turns_against_the_rule(spark, files):
    rows = [(f"f{i}", j, o and k % 3 == 0, t, 1000 + j) for i, lines in enumerate(files) for j, (k, (o, t)) in enumerate(enumerate(lines))]
    df = spark.createDataFrame(rows, "file string, ord long, opens boolean, total long, timestamp_ms long").withColumns({"model": F.lit(None).cast("string"), "fallback_model": F.lit("grok-unknown")})
    got = {}
    for r in stateful.turn_segments(df, ["file"]).orderBy("file", "turn").collect():
        got.setdefault(r["file"], []).append((r["delta"], r["timestamp_ms"]))
    for i in range(len(files)):
        plain = PlainTurns()
        for f, _, o, t, at in rows:
            if f == f"f{i}":
                plain.line(o, t, at)
        assert got.get(f"f{i}", []) == plain.result(), [r for r in rows if r[0] == f"f{i}"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 9)), max_size=40))
def test_merge_and_replace_against_dicts(spark, rows):
    df = spark.createDataFrame([(f"f{f}", None if k is None else f"k{k}", i, v, v, 0, 0) for i, (f, k, v) in enumerate(rows)], "file string, dedup_key string, ord long, input long, output long, cache_read long, cache_write long")
    first, most, last = {}, {}, {}
    for i, (f, k, v) in enumerate(rows):
        key = (f, k if k is not None else ("own", i))
        first.setdefault(key, i)
        most[key] = max(v, most.get(key, 0))
        last[key] = v
    assert {r["ord"]: r["input"] for r in stateful.max_merge(df).collect()} == {first[k]: most[k] for k in first}
    assert {r["ord"]: r["input"] for r in stateful.replace_in_place(df).collect()} == {first[k]: last[k] for k in first}


def test_command_line(tmp_path, capsys, spark):
    log = tmp_path / ".claude/projects/p/x.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text(json.dumps({"type": "assistant", "timestamp": "2024-05-01T00:00:00Z", "message": {"model": "claude-sonnet-4", "usage": {"input_tokens": 1_000_000}}}) + "\n")
    assert main(["graph", "--home", str(tmp_path), "--clients", "claude", "--facts", str(tmp_path / "facts")]) == 0
    doc = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert doc["summary"]["totalCost"] == pytest.approx(0.2 * 3 + 0.8 * 6) and doc["years"][0]["year"] == "2024"
    assert main(["graph", "--home", str(tmp_path), "--clients", "claude", "--year", "x", "--facts", str(tmp_path / "facts")]) == 2
    assert main(["tail-sim", "--root", str(tmp_path / ".claude"), "--client", "claude", "--now-ms", "1714521600000", "--work", str(tmp_path / "work")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["trace"][0]["tokens"] == 1_000_000


def test_equal_clients_keep_the_order_of_the_trace(spark):
    rows = spark.createDataFrame([("amp", "main", "m", 3, 1, 0.3), ("amp", "main", "n", 3, 1, 0.3), ("grok", "main", "m", 5, 1, 0.5), ("grok", "main", "n", 1, 1, 0.1)], "client string, agent string, model string, tokens long, messages long, tokens_per_min float")
    assert [r["client"] for r in trace.top(trace.collapse(rows)).collect()] == ["grok", "amp"]


def test_tail_live(spark, tmp_path, capsys, monkeypatch):
    from meterglass import __main__ as cli

    now = 1_714_521_600_000
    log = tmp_path / "logs/a/x.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text(json.dumps({"type": "assistant", "timestamp": "2024-05-01T00:00:00Z", "requestId": "r", "message": {"id": "m", "model": "claude-x", "usage": {"input_tokens": 600, "output_tokens": 0}}}) + "\n")
    monkeypatch.setattr(cli, "TICK_S", 0)
    times = iter([now] + [now + 700_000] * 9)  # the first tick; then the window has passed
    monkeypatch.setattr(cli, "clock", lambda: next(times, now + 700_000))
    assert cli.main(["tail-live", "--root", str(tmp_path / "logs"), "--client", "claude", "--ticks", "3", "--work", str(tmp_path / "work")]) == 0
    shown = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [[r["tokens"] for r in s["trace"]] for s in shown] == [[600], []]  # only what changed
    assert [(s["tokens_per_min"], s["in_window"]) for s in shown] == [(600.0, 60.0), (0.0, 0.0)]
