import json

import pytest
from pyspark.sql import functions as F

from meterglass.functions import format as fmt
from meterglass.functions import json as J
from meterglass.functions import labels, models, pricing
from meterglass.functions import time as times
from meterglass.sources import logs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def coerced(spark, f, texts):
    """What ``f`` makes of the field x of each JSON value."""
    rows = [(i, json.dumps({"x": t}) if not isinstance(t, str) or not t.startswith("raw:") else '{"x":' + t[4:] + "}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r["x"] for r in df.select("i", f(J.node(J.parse(F.col("t")), "$.x")).alias("x")).orderBy("i").collect()]


def test_i64(spark):
    got = coerced(spark, J.i64_value, [" 42 ", "4.2", True, 2.9, -2.9, 1e30, 7, None, "raw:18446744073709551615", "raw:9223372036854775807", -1e30, "x"])
    assert got == [42, None, None, 2, -2, 2**63 - 1, 7, None, -1, 2**63 - 1, -(2**63), None]


def test_string_and_double(spark):
    assert coerced(spark, J.string_value, ["  hi  ", "   ", 7, True, None, [1]]) == ["hi", None, "7", None, None, None]
    assert coerced(spark, J.f64_value, [" 4.2 ", 7, 2.5, True, "x"]) == [4.2, 7.0, 2.5, None, None]


def test_epoch(spark):
    values = [1700000000, 99999999999, 100000000000, 1700000000123456, 1700000000123456789, -1700000000]
    df = spark.createDataFrame([(v,) for v in values], "n long").select(times.normalize_epoch_ms(F.col("n")).alias("x"))
    assert [r["x"] for r in df.collect()] == [1700000000000, 99999999999000, 100000000000, 1700000000123, 1700000000123, -1700000000000]
    doubles = [1700000000.9, 1700000000.0004, 1700000000.0006, 0.0, -5.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in doubles], "n double").select(times.normalize_epoch_ms_double(F.col("n")).alias("x"))
    assert [r["x"] for r in df.collect()] == [1700000000900, 1700000000000, 1700000000001, None, None, None]
    assert coerced(spark, times.timestamp_ms, [1700000000.9, "1700000000", " 1700000000"]) == [1700000000000, 1700000000000, None]


@pytest.mark.parametrize(
    ("text", "ms"),
    [
        ("2023-11-14T22:13:20Z", 1700000000000), ("2023-11-14t22:13:20.1239z", 1700000000123), ("2023-11-14 22:13:20+00:00", 1700000000000),
        ("2023-11-15T07:13:20+09:00", 1700000000000), ("2023-11-14T22:13:20", None), ("2023-02-30T00:00:00Z", None), ("2023-11-14", None),
        ("2016-12-31T23:59:60Z", 1483228800000), ("2023-11-14T22:13Z", None),
    ],
)
def test_rfc3339(spark, text, ms):
    assert one(spark, times.rfc3339_ms(F.col("t")), t=text) == ms


def test_dates(spark):
    assert one(spark, times.date_or_zero_ms(F.col("t")), t="2026-05-24") == 1779624000000
    assert one(spark, times.date_or_zero_ms(F.col("t")), t="soon") == 0
    assert one(spark, times.local_date(F.col("t")), t=1700000000000) == "2023-11-14"


@pytest.mark.parametrize(("minutes", "text"), [(0, "Resets now"), (-3, "Resets now"), (59, "Resets in 59m"), (61, "Resets in 1h 1m"), (47 * 60 + 5, "Resets in 47h 5m"), (49 * 60, "Resets in 2d 1h"), (48 * 60, "Resets in 2d"), (120, "Resets in 2h")])
def test_reset_text(spark, minutes, text):
    assert one(spark, times.reset_text(F.lit(0), F.col("m") * 60_000), m=minutes) == text


def test_csv(spark):
    cases = {'"a""b,c",d': ['"a""b,c"', "d"], '"a,b': ['"a,b'], "": [""], "a,b,": ["a", "b", ""], '\x01a,"\x01,\x012",2\x011': ["\x01a", '"\x01,\x012"', "2\x011"]}
    for line, fields in cases.items():
        assert one(spark, logs.split_csv(F.col("t")), t=line) == fields
    costs = {"$1,234.56": 1234.56, "Included": 0.0, "NaN": 0.0, "-": 0.0, "": 0.0, "x": 0.0}
    for text, usd in costs.items():
        assert one(spark, logs.parse_cost(F.col("t")), t=text) == usd
    assert one(spark, logs.clean_csv(F.col("t")), t=' ""x"" ') == "x"


def test_models(spark):
    names = {"custom:GPT_5.5 Codex": "gpt-5-5-codex", "claude-sonnet-4[beta] ": "claude-sonnet-4", "a..__b": "a-b", "-x-": "x", "a[b": "a"}
    for raw, model in names.items():
        assert one(spark, models.normalize_settings_model(F.col("t")), t=raw) == model
    assert one(spark, models.normalize_live_model(F.col("t")), t="Claude-Sonnet-4-20250514") == "claude-sonnet-4"
    assert one(spark, models.normalize_live_model(F.col("t")), t="-20250514") == "-20250514"
    assert [one(spark, models.live_client(F.col("t")), t=t) for t in ("claude-code", "codex-cli", "x-cli", "amp")] == ["claude", "codex", "x", "amp"]
    assert one(spark, models.sidechain_label(F.col("t")), t="/a/agent-7f.jsonl") == "subagent:7f"
    assert [one(spark, models.routing_provider(F.col("t")), t=t) for t in (" Azure ", "openrouter", "gemini")] == ["openai", "", "google"]
    assert one(spark, models.billing_provider(F.col("b"), F.lit("gpt-5")), b=" ") == "openai"


PRICES = {
    ("claude-opus-4-7-fast", ""): (30.0, 150.0), ("claude-opus-4.5", ""): (5.0, 25.0), ("claude-3-opus", ""): (15.0, 75.0), ("gpt-5.5-pro", ""): (30.0, 180.0), ("openai/gpt-5", ""): (1.25, 10.0),
    ("grok-composer-2", ""): (0.5, 2.5), ("grok-4.5", ""): (2.0, 6.0), ("gemini-2.5-flash-lite", ""): (0.1, 0.4), ("mystery", "anthropic"): (3.0, 15.0), ("mystery", "unknown"): (0.0, 0.0), ("gpt-4o-mini", ""): (0.15, 0.6),
}


def test_prices(spark):
    df = spark.createDataFrame(list(PRICES), "model_id string, provider_id string")
    got = {(r["model_id"], r["provider_id"]): (r["input_price"], r["output_price"]) for r in pricing.price_table(df).collect()}
    assert got == PRICES


def test_tiered_cost(spark):
    df = pricing.price_table(spark.createDataFrame([("gpt-5.5", "openai")], "model_id string, provider_id string"))
    usd = df.select(pricing.estimated_cost(F.lit(300_000), F.lit(100_000), F.lit(300_000), F.lit(0), F.lit(0)).alias("x")).first()["x"]
    assert usd == pytest.approx(4.804)
    assert one(spark, pricing.tiered(F.lit(200_000), F.lit(3.0), F.lit(200_000), F.lit(6.0))) == 600_000


def test_humanize(spark):
    shown = {0: "0", 999: "999", 1000: "1.0K", 1050: "1.1K", 1949: "1.9K", 1950: "1.9K", 999950: "1000.0K", 1250000: "1.3M", 43712345678: "43.7B", 1500000000000: "1.5T"}
    for n, text in shown.items():
        assert one(spark, fmt.humanize_tokens(F.col("n")), n=n) == text


def test_format_cost(spark):
    for usd, text in {0.004: "$0.00", 0.005: "$0.01", 12.345: "$12.35", 999.995: "$1,000.00", 1234567.891: "$1,234,567.89"}.items():
        assert one(spark, fmt.format_cost(F.col("x")), x=usd) == text
    assert one(spark, fmt.clamp_percent(F.col("x")), x=79.5) == 80
    assert one(spark, fmt.clamp_percent(F.col("x")), x=-3.0) == 0


def test_scales_of_an_idle_calendar(spark):
    from meterglass.functions import format as fmt

    df = spark.createDataFrame([(0, 0), (5, 5)], "tokens long, most long")
    got = df.orderBy("tokens").select(fmt.tile_height(F.col("tokens"), F.col("most")).alias("h"), fmt.color_ratio(F.col("tokens"), F.col("most")).alias("c")).collect()
    assert [(r["h"], r["c"]) for r in got] == [(0.05, 0.0), (4.05, 1.0)]


def test_diff_days(spark):
    df = spark.sql("SELECT timestamp'2026-03-30 00:00:00' AS a, timestamp'2026-03-28 01:00:00' AS b, timestamp'2026-03-28 12:00:00' AS c")
    assert tuple(df.select(times.diff_days(F.col("a"), F.col("b")), times.diff_days(F.col("b"), F.col("a")), times.diff_days(F.col("a"), F.col("c")), times.diff_days(F.col("c"), F.col("a"))).first()) == (2, -2, 2, -1)


def test_client_color(spark):
    df = spark.createDataFrame([("claude",), ("synthetic",), ("other",)], "c string")
    assert [r[0] for r in df.select(labels.client_color(F.col("c"))).collect()] == ["#d97706", "#64748b", "#6b7280"]
