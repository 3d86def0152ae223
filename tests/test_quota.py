import json
import struct

import pytest
from pyspark.sql import functions as F

from meterglass.functions import json as J
from meterglass.functions import labels
from meterglass.operators import quota as Q

NOW = 1_700_000_000_000


def windows(spark, f, doc):
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(f(J.parse(F.col("t")), F.lit(NOW)).alias("w"))
    return [tuple(w) for w in df.first()["w"]]


def test_codex(spark):
    week = {"used_percent": 30, "limit_window_seconds": 604800, "reset_at": NOW // 1000 + 7200}
    session = {"used_percent": 120, "limit_window_seconds": 18000, "reset_at": 0}
    extra = lambda name, p: {"limit_name": name, "rate_limit": {"primary_window": {"used_percent": p}}}
    doc = {"rate_limit": {"primary_window": week, "secondary_window": session}, "additional_rate_limits": [extra("gpt-5_mini", 5), extra("gpt-5_mini", 6), extra("x spark", 7), {"limit_name": "none"}], "spend_control": {"individual_limit": {"remaining_percent": 75}}}
    got = windows(spark, Q.codex_windows, doc)
    assert [w[:3] for w in got] == [("Session", 100.0, 0.0), ("Weekly", 30.0, 70.0), ("GPT 5 Mini", 5.0, 95.0), ("Codex Spark", 7.0, 93.0), ("Monthly spend", 25.0, 75.0)]
    assert got[1][3:] == ("2023-11-15T00:13:20.000Z", "Resets in 2h") and got[0][3:] == (None, None)


def test_claude(spark):
    doc = {"five_hour": {"utilization": 42.5, "resets_at": "2023-11-14T22:43:20Z"}, "seven_day": None, "design": None, "omelette": {"utilization": 1}, "extra_usage": {"is_enabled": True, "used_credits": 250, "monthly_limit": 1000}}
    got = windows(spark, Q.claude_windows, doc)
    assert got == [("Session", 42.5, 57.5, "2023-11-14T22:43:20.000Z", "Resets in 30m"), ("Designs", 1.0, 99.0, None, None), ("Extra usage", 25.0, 75.0, None, "Monthly cap: $2.50 / $10.00")]


def test_cursor(spark):
    assert [w[:2] for w in windows(spark, Q.cursor_windows, {"planUsage": {"autoPercentUsed": 3, "apiPercentUsed": "14", "totalPercentUsed": 5}})] == [("Cursor Models", 3.0), ("Other Models", 14.0)]
    got = windows(spark, Q.cursor_windows, {"planUsage": {"limit": 200, "remaining": 50}, "billingCycleEnd": str(NOW + 60_000)})
    assert got == [("Monthly", 75.0, 25.0, "2023-11-14T22:14:20.000Z", "Resets in 1m")]


def test_grok(spark):
    doc = {"a": [{"billingCycle": {"billingPeriodStart": "2023-11-01T00:00:00Z", "billingPeriodEnd": "2023-12-01T00:00:00Z"}, "monthlyLimit": {"val": 2000}, "usage": {"totalUsed": 500}}], "b": {"usage": 3, "limit": "10", "c": {"usage": 3, "limit": 10, "frequentLimit": 4}}}
    df = spark.createDataFrame([(json.dumps(doc), None), ("{", None)], "t string, b binary").select(Q.grok_metrics("t").alias("m"))
    rows = [[tuple(m) for m in r["m"]] for r in df.collect()]
    assert rows[0] == [("Monthly", 25.0, 75.0, "$15.00/$20.00 left", "2023-12-01T00:00:00Z"), ("Tasks", 30.0, 70.0, "7/10 left", None), ("Frequent", 0.0, 100.0, "4/4 left", None)]
    assert rows[1] == []
    doc = {"subscriptions": [{"status": "X_INACTIVE", "tier": "A"}, {"status": "SUBSCRIPTION_STATUS_ACTIVE", "tier": "SUBSCRIPTION_TIER_SUPER_GROK"}]}
    assert spark.createDataFrame([(json.dumps(doc),)], "t string").select(Q.grok_plan(J.parse(F.col("t")))).first()[0] == "Super Grok"


def frame(config, flag=0):
    body = b"\x0a" + bytes([len(config)]) + config
    return bytes([flag]) + len(body).to_bytes(4, "big") + body


def stamp(field, seconds):
    out, n = b"\x08", seconds
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    out += bytes([n])
    return bytes([field << 3 | 2, len(out)]) + out


def test_frames(spark):
    week = stamp(4, 1_700_000_000) + stamp(5, 1_700_604_800)
    bodies = [frame(b"\x0d" + struct.pack("<f", 12.5) + week), frame(week), frame(b"", 0x80) + frame(b"\x0d" + struct.pack("<f", 150)), frame(week)[:-3], b"", None]
    rows = [[tuple(m) for m in r["m"]] for r in spark.createDataFrame([(b,) for b in bodies], "b binary").select(Q.grok_frame_metrics("b").alias("m")).collect()]
    end = "2023-11-21T22:13:20+00:00"
    assert rows == [[("Weekly", 12.5, 87.5, None, end)], [("Weekly", 0.0, 100.0, None, end)], [("Credits", 100.0, 0.0, None, None)], [], [], []]


def test_bounds_beyond_the_calendar(spark):
    """Periods that no calendar holds have no end; the rest of the response counts."""
    docs = ['{"usedPercent": 5, "billingPeriodEnd": 1e30}', '{"usedPercent": 5, "billingPeriodEnd": 99999999999999}', '{"usedPercent": 5, "billingPeriodStart": -1e15}', '{"usedPercent": 1%s}' % ("0" * 400), '{"usage": 3, "limit": 1%s}' % ("0" * 400)]
    rows = [[tuple(m) for m in r["m"]] for r in spark.createDataFrame([(d,) for d in docs], "t string").select(Q.grok_metrics("t").alias("m")).collect()]
    assert rows == [[("Credits", 5.0, 95.0, None, None)]] * 3 + [[], []]
    bodies = [frame(b"\x0d" + struct.pack("<f", 5) + stamp(5, 2**63)), frame(stamp(4, 1_700_000_000) + stamp(5, 2**62))]
    rows = [[tuple(m) for m in r["m"]] for r in spark.createDataFrame([(b,) for b in bodies], "b binary").select(Q.grok_frame_metrics("b").alias("m")).collect()]
    assert rows == [[("Credits", 5.0, 95.0, None, None)], [("Credits", 0.0, 100.0, None, None)]]


SCHEMA = f"client_id string, source string, updated_at string, windows array<{Q.WINDOW}>, credits double, plan string, error string, stale boolean"


def snap(client, *used, at="2023-11-14T22:00:00.000Z", error=None, source="oauth", **more):
    return (client, source, at, [(f"w{i}", float(u), 100.0 - u, None, None) for i, u in enumerate(used)], more.get("credits"), more.get("plan"), error, None)


def test_stale_carry(spark):
    before = spark.createDataFrame([snap("claude", 40), snap("codex", 50, at="2023-11-13T22:00:00.000Z"), snap("grok", 10)], SCHEMA)
    now = spark.createDataFrame([snap("claude", error="expired"), snap("codex", error="down"), snap("grok", 20), snap("cursor", error="x")], SCHEMA)
    got = {r["client_id"]: r for r in Q.carry_stale(now, before, NOW).collect()}
    assert got["claude"]["windows"][0]["used_percent"] == 40 and got["claude"]["stale"] and got["claude"]["error"] == "expired"
    assert got["codex"]["windows"] == [] and got["grok"]["windows"][0]["used_percent"] == 20 and got["cursor"]["windows"] == []


def test_empty_rule_and_status(spark):
    df = Q.checked(spark.createDataFrame([snap("claude"), snap("codex"), snap("grok", plan="Super"), snap("cursor", 1), snap("amp"), snap("omp")], SCHEMA))
    assert {r["client_id"]: r["error"] is not None for r in df.collect()} == {"claude": True, "codex": True, "grok": False, "cursor": False, "amp": False, "omp": False}
    live = spark.createDataFrame([("amp",)], "client string")
    assert dict(Q.tile_status(df, live).collect()) == {"claude": "Error", "codex": "Error", "grok": "No quota", "cursor": "OAUTH", "amp": "Live", "omp": "No quota"}


@pytest.mark.parametrize(
    ("rows", "provider", "label", "mode", "title"),
    [
        ([("codex", 80, 3), ("claude", 42)], "auto", "", "used", "⚠ Codex 80%"), ([("codex", 80)], "auto", "", "left", "⚠ Codex 20% left"), ([("codex", 80), ("claude", 42, 7)], "claude", "gone", "used", "Claude 42%"),
        ([("claude", 42, 7)], "claude", "w1", "used", "Claude 7%"), ([("claude", 79.5)], "auto", "", "used", "⚠ Claude 80%"), ([("claude", 5), ("codex", 5)], "auto", "", "used", "Codex 5%"), ([("gemini", 99)], "auto", "", "used", "—"), ([], "claude", "", "used", "—"),
    ],
)
def test_plan_title(spark, rows, provider, label, mode, title):
    df = spark.createDataFrame([snap(*r) for r in rows], SCHEMA)
    assert Q.plan_title(Q.pick_window(df, provider, label), mode).first()["title"] == title


def test_tray_and_visible(spark):
    stats = {"tokens": "1.5K", "cost": "$12.95"}
    assert [Q.tray_title(m, stats) for m in ("total_tokens", "total_cost", "today_tokens", "today_cost", "tokens_per_min", "plan_percent", "hidden")] == ["1.5K", "$12.95", "0", "$0.00", "—/m", "—", ""]
    assert Q.tray_title("tokens_per_min", stats, tokens_per_min="12.4K") == "12.4K/m" and Q.tray_title("total_tokens") == ""
    listed = spark.createDataFrame([("amp", 0), ("gemini", 1), ("claude", 2), ("gemini", 3)], "client string, ord int")
    df = spark.createDataFrame([snap("claude", 1), snap("cursor", 1)], SCHEMA)
    assert [r["client_id"] for r in Q.visible_clients(listed, df).orderBy("place").collect()] == ["gemini", "claude", "cursor"]


def test_latest_payload_and_labels(spark):
    df = spark.createDataFrame([("2023-11-14T22:13:20.500Z", "new"), ("2023-11-14T22:13:20.100Z", "old")], "generated_at string, payload string")
    assert Q.latest_payload(df).first()["payload"] == "new"
    row = spark.range(1).select(labels.plan_label(F.lit("pro_plus-x")), labels.minor_units(F.lit(1234.0), F.lit("eur")), labels.display_name(F.lit("new-tool")), labels.jwt_claim(F.lit("a.eyJlbWFpbCI6ICJ4QHkueiJ9.b"), "email"), labels.jwt_claim(F.lit("nope"), "email")).first()
    assert tuple(row) == ("Pro Plus X", "12.34 EUR", "New Tool", "x@y.z", None)


def test_deep_documents_do_no_harm():
    from meterglass.operators import quota

    deep = "[" * 400 + '{"usage": 3, "limit": 4, "usedPercent": 5}' + "]" * 400
    assert [m[0] for m in quota._metrics(deep)] == ["Credits", "Tasks"]
    assert quota._metrics("[" * 200_000 + "]" * 200_000) == [] == quota._metrics(None)


def test_opted_in(spark):
    df = spark.createDataFrame([("cursor",), ("codex",), (None,)], "client_id string")
    assert [r[0] for r in Q.opted_in(df, False).collect()] == ["codex", None] and Q.opted_in(df, True).count() == 3
