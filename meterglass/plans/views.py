"""Queries of the functions and of the limit, label and narrowing operators, on columns made from the tables."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions import json as J
from ..functions import labels, models
from ..functions import time as times
from ..operators import quota, rollup, stateful, trace
from ..sources import files, logs
from .adapters import EVENTS_SQL, MESSAGES_SQL, table, text_array, usage_events, usage_messages
from .catalog import NOW_MS
from .registry import query


def choice(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def choice_sql(values, index: str) -> str:
    return f"[{text_array(values)}][{index} % {len(values)} + 1]"


# --- limit windows and snapshots -----------------------------------------------------------------


def limit_windows(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("client_id"), F.lit(0).alias("agent_ord"), F.col("s_suppkey").alias("window_ord"),
        F.concat(F.lit("w"), (F.col("s_suppkey") % 7).cast("string")).alias("label"), (F.floor(F.abs("s_acctbal")) % 100).cast("double").alias("used_percent"),
    )


LIMITS_SQL = "w AS (SELECT 'n' || s_nationkey AS client_id, s_suppkey AS window_ord, 'w' || (s_suppkey % 7) AS label, CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) % 100 AS DOUBLE) AS used_percent FROM supplier)"


@query(f"WITH {LIMITS_SQL} SELECT client_id, window_ord, label, used_percent FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY used_percent DESC, window_ord) AS rn FROM w) WHERE rn = 1")
def most_constrained(spark, sf_dir):
    return quota.most_constrained(limit_windows(spark, sf_dir)).select("client_id", "window_ord", "label", "used_percent")


@query(f"WITH {LIMITS_SQL} SELECT client_id, window_ord, label, used_percent FROM (SELECT *, row_number() OVER (PARTITION BY client_id, label ORDER BY window_ord) AS rn FROM w) WHERE rn = 1")
def seen_label_dedup(spark, sf_dir):
    return quota.first_by_label(limit_windows(spark, sf_dir)).drop("agent_ord")


def snapshots(spark, sf_dir, client: Column, used: Column, error: Column, updated_ms: Column, **more: Column) -> DataFrame:
    """Nations as provider snapshots with one window, or none where ``used`` is null."""
    none = {"credits": F.lit(None).cast("double"), "plan": F.lit(None).cast("string"), "stale": F.lit(None).cast("boolean"), **more}
    one = quota.present(quota.window(F.lit("Session"), used, F.lit(None).cast("long"), F.lit(NOW_MS)))
    return table(spark, sf_dir, "nation").select(
        client.alias("client_id"), F.lit("oauth").alias("source"), times.rfc3339_text(updated_ms).alias("updated_at"), one.alias("windows"),
        none["credits"].alias("credits"), none["plan"].alias("plan"), error.alias("error"), none["stale"].alias("stale"),
    )


@query(f"""SELECT n_name AS client_id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey + 1 WHEN n_nationkey < 12 THEN n_nationkey END::DOUBLE AS used, CASE WHEN n_nationkey % 3 > 0 THEN 'down' END AS error,
  CASE WHEN n_nationkey % 3 > 0 AND n_nationkey < 12 THEN true END AS stale,
  strftime(make_timestamp(({NOW_MS} - CASE WHEN n_nationkey % 3 > 0 AND n_nationkey < 12 THEN n_nationkey * 7200000 ELSE 0 END) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at FROM nation""")
def stale_carry(spark, sf_dir):
    n, now = F.col("n_nationkey").cast("long"), F.lit(NOW_MS)
    failed = n % 3 > 0
    before = snapshots(spark, sf_dir, F.col("n_name"), n.cast("double"), F.lit(None).cast("string"), now - n * 7_200_000)
    fresh = snapshots(spark, sf_dir, F.col("n_name"), F.when(~failed, n + 1).cast("double"), F.when(failed, "down"), now)
    return quota.carry_stale(fresh, before, NOW_MS).select("client_id", F.get("windows", F.lit(0))["used_percent"].alias("used"), "error", "stale", "updated_at")


def first_clients(spark, sf_dir) -> DataFrame:
    """A snapshot for each of the first nations, named as the clients are; every third without windows."""
    n = F.col("n_nationkey").cast("long")
    made = snapshots(spark, sf_dir, F.concat(choice(models.CLIENTS, n), F.lit(":"), n.cast("string")), F.when(n % 3 > 0, n * 9).cast("double"), F.when(n % 4 == 1, "expired"), F.lit(NOW_MS), stale=F.when(n % 5 == 1, F.lit(True)))
    place = F.split("client_id", ":")
    return made.filter(place[1].cast("int") < len(models.CLIENTS)).withColumn("client_id", place[0])


CLIENT_SQL = f"c AS (SELECT {choice_sql(models.CLIENTS, 'n_nationkey')} AS client_id, n_nationkey AS n, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 9 END AS used FROM nation WHERE n_nationkey < {len(models.CLIENTS)})"


@query(f"WITH {CLIENT_SQL} SELECT client_id, CASE WHEN n % 5 = 1 THEN 'Stale' WHEN n % 4 = 1 THEN 'Error' WHEN used IS NOT NULL THEN 'OAUTH' WHEN client_id IN ('claude', 'amp') THEN 'Live' ELSE 'No quota' END AS status FROM c")
def tile_status(spark, sf_dir):
    live = table(spark, sf_dir, "nation").filter("n_nationkey IN (0, 6)").select(choice(models.CLIENTS, F.col("n_nationkey")).alias("client"))
    return quota.tile_status(first_clients(spark, sf_dir), live)


@query(f"""WITH {CLIENT_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY used DESC, list_position(['codex', 'claude', 'grok', 'cursor'], client_id)) AS rn FROM c WHERE used IS NOT NULL AND client_id IN ('codex', 'claude', 'grok', 'cursor'))
SELECT CASE WHEN used >= 80 THEN '⚠ ' ELSE '' END || upper(client_id[1]) || client_id[2:] || ' ' || used || '%' AS title FROM p WHERE rn = 1""")
def plan_title(spark, sf_dir):
    return quota.plan_title(quota.pick_window(first_clients(spark, sf_dir)))


@query(f"""WITH {CLIENT_SQL}, first AS (SELECT client_id, 0 AS part, 20 - n AS ord FROM c WHERE n % 2 = 0), rest AS (SELECT client_id, 1, list_position(['codex', 'claude', 'grok', 'cursor'], client_id) FROM c WHERE client_id IN ('codex', 'grok'))
SELECT client_id, CAST(row_number() OVER (ORDER BY part, ord) - 1 AS INTEGER) AS place FROM (SELECT * FROM first UNION ALL SELECT * FROM rest WHERE client_id NOT IN (SELECT client_id FROM first))""")
def visible_clients(spark, sf_dir):
    n = F.col("n_nationkey")
    listed = table(spark, sf_dir, "nation").filter((n < len(models.CLIENTS)) & (n % 2 == 0)).select(choice(models.CLIENTS, n).alias("client"), (F.lit(20) - n).alias("ord"))
    known = first_clients(spark, sf_dir)
    return quota.visible_clients(listed, known.filter(F.col("client_id").isin("codex", "grok") | F.col("client_id").isin(*models.CLIENTS[::2])))


@query("SELECT arg_max(CAST(o_orderkey AS VARCHAR), epoch_ms(o_orderdate) + o_orderkey) AS payload FROM orders")
def latest_payload(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ms = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86_400_000 + F.col("o_orderkey")
    return quota.latest_payload(o.select(times.rfc3339_text(ms).alias("generated_at"), F.col("o_orderkey").cast("string").alias("payload")))


# --- provider responses --------------------------------------------------------------------------


def responses(spark, sf_dir, text: Column) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", J.parse(text).alias("v"))


def windows_of(rows: DataFrame, windows: Column) -> DataFrame:
    return rows.select("c_custkey", F.explode(windows).alias("w")).select("c_custkey", "w.label", F.round("w.used_percent", 6).alias("used_percent"), "w.reset_text")


def filled(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def key() -> Column:
    return F.col("c_custkey")


@query("""SELECT c_custkey, 'Session' AS label, CAST(c_custkey % 90 AS DOUBLE) AS used_percent, NULL AS reset_text FROM customer
UNION ALL SELECT c_custkey, 'Weekly', least(100, c_custkey % 130)::DOUBLE, 'Resets in 2h' FROM customer UNION ALL SELECT c_custkey, 'GPT 5 Mini', CAST(c_custkey % 7 AS DOUBLE), NULL FROM customer""")
def codex_windows(spark, sf_dir):
    text = filled(
        '{"rate_limit": {"primary_window": {"used_percent": %d, "limit_window_seconds": 604800, "reset_at": 7200}, "secondary_window": {"used_percent": %d, "limit_window_seconds": 18000}}, '
        '"additional_rate_limits": [{"limit_name": "gpt-5_mini", "rate_limit": {"primary_window": {"used_percent": %d}}}, {"limit_name": "gpt 5 mini", "rate_limit": {"primary_window": {"used_percent": 1}}}]}',
        key() % 130, key() % 90, key() % 7,
    )
    return windows_of(responses(spark, sf_dir, text), quota.codex_windows(F.col("v"), F.lit(0).cast("long")))


@query("""SELECT c_custkey, 'Session' AS label, least(100, c_custkey % 130)::DOUBLE AS used_percent, 'Resets in 30m' AS reset_text FROM customer
UNION ALL SELECT c_custkey, 'Designs', CAST(c_custkey % 50 AS DOUBLE), NULL FROM customer""")
def claude_windows(spark, sf_dir):
    text = filled('{"five_hour": {"utilization": %d, "resets_at": "1970-01-01T00:30:00Z"}, "seven_day": null, "design": null, "omelette": {"utilization": "%d"}}', key() % 130, key() % 50)
    return windows_of(responses(spark, sf_dir, text), quota.claude_windows(F.col("v"), F.lit(0).cast("long")))


@query("""SELECT c_custkey, 'Monthly' AS label, round((200 - c_custkey % 200) / 200.0::DOUBLE * 100, 6) AS used_percent, 'Resets in 1m' AS reset_text FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'Cursor Models', CAST(c_custkey % 100 AS DOUBLE), 'Resets in 1m' FROM customer WHERE c_custkey % 2 = 1""")
def cursor_windows(spark, sf_dir):
    pool = F.when(key() % 2 == 1, filled('"autoPercentUsed": %d, ', key() % 100)).otherwise("")
    text = filled('{"planUsage": {%s"limit": 200, "remaining": %d}, "billingCycleEnd": "60000"}', pool, key() % 200)
    return windows_of(responses(spark, sf_dir, text), quota.cursor_windows(F.col("v"), F.lit(0).cast("long")))


@query("""SELECT c_custkey, 'Tasks' AS label, round(least(20, c_custkey % 30) / 20.0::DOUBLE * 100, 6) AS used_percent, (20 - least(20, c_custkey % 30)) || '/20 left' AS remaining_label FROM customer""")
def task_limit_dedup(spark, sf_dir):
    text = filled('{"a": {"usage": %d, "limit": 20}, "b": [{"usage": "%d", "limit": {"val": 20}}]}', key() % 30, key() % 30)
    found = table(spark, sf_dir, "customer").select("c_custkey", F.explode(quota.grok_metrics(text)).alias("m"))
    return found.select("c_custkey", "m.label", F.round("m.used_percent", 6).alias("used_percent"), "m.remaining_label")


@query("""SELECT c_custkey, kind, CASE WHEN c_custkey % 5 > 2 THEN 'Credits' WHEN c_custkey % 2 = 0 THEN 'Weekly' ELSE 'Monthly' END AS label, CAST(least(100, c_custkey % 130) AS DOUBLE) AS used_percent,
  CASE WHEN c_custkey % 5 <= 2 THEN strftime(make_timestamp((1700000000 + c_custkey * 60 + CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 30 END * 86400) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS resets_at
FROM customer, (VALUES ('text'), ('frame')) v(kind) WHERE kind = 'text' OR c_custkey % 5 <> 4""")
def billing_bounds(spark, sf_dir):
    """Billing periods of a week or a month, in documents and in frames; two in five end beyond the calendar and have no end."""
    start = F.lit(1_700_000_000) + key() * 60
    end = start + F.when(key() % 2 == 0, 7).otherwise(30) * 86_400
    far = F.when(key() % 5 == 3, "1e30").when(key() % 5 == 4, "99999999999999").otherwise(end.cast("string"))
    text = filled('{"usedPercent": %d, "billingPeriodStart": %d, "billingPeriodEnd": %s}', key() % 130, start, far)
    seven = lambda n, k: F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 7 * k).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if k < 4 else 0))), 2, "0")
    bound = lambda field, n: F.concat(F.lit(field + "0608"), *[seven(n, k) for k in range(5)])  # noqa: E731  of five bytes
    last = F.when(key() % 5 == 3, F.lit("2A0B0880808080808080808001")).otherwise(bound("2A", end))  # 2^63 seconds
    share = F.concat(F.lit("0D"), F.element_at(F.array(*[F.lit(struct.pack("<f", n).hex()) for n in range(130)]), (key() % 130 + 1).cast("int")))
    config = F.concat(share, bound("22", start), last)
    size = lambda hexed, more, digits: F.lpad(F.hex((F.length(hexed) / 2 + more).cast("long")), digits, "0")
    frame = F.unhex(F.concat(F.lit("00"), size(config, 2, 8), F.lit("0A"), size(config, 0, 2), config))
    each = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(quota.grok_metrics(text), F.when(key() % 5 != 4, quota.grok_frame_metrics(frame)))).alias("i", "found"))
    return each.select("c_custkey", F.when(F.col("i") == 0, "text").otherwise("frame").alias("kind"), F.explode("found").alias("m")).select("c_custkey", "kind", "m.label", "m.used_percent", "m.resets_at")


@query("SELECT c_custkey, 'c' || c_custkey || '@example.org' AS email, CASE c_custkey % 3 WHEN 0 THEN 'Super Grok' WHEN 1 THEN 'Pro' END AS tier FROM customer")
def account_claims(spark, sf_dir):
    body = F.encode(filled('{"email": "c%d@example.org"}', key()), "utf-8")
    token = F.concat(F.lit("e30."), F.regexp_replace(F.translate(F.base64(body), "+/", "-_"), "=+$", ""), F.lit(".sig"))
    tier = F.when(key() % 3 == 0, "SUBSCRIPTION_TIER_SUPER_GROK").when(key() % 3 == 1, "TIER_PRO").otherwise("NONE")
    status = F.when(key() % 3 == 2, "SUBSCRIPTION_STATUS_INACTIVE").otherwise("SUBSCRIPTION_STATUS_ACTIVE")
    text = filled('{"subscriptions": [{"status": "X_CANCELLED", "tier": "A"}, {"status": "%s", "tier": "%s"}]}', status, tier)
    return table(spark, sf_dir, "customer").select("c_custkey", labels.jwt_claim(token, "email").alias("email"), quota.grok_plan(J.parse(text)).alias("tier"))


@query("""SELECT 1700000000000 + c_custkey AS timestamp_ms, CASE WHEN c_custkey % 2 = 0 THEN 'gpt-5' ELSE 'cursor' END AS model, c_custkey AS input_tokens, 0::BIGINT AS output_tokens, 7::BIGINT AS cache_read_tokens,
  round(c_custkey % 1000 / 100.0::DOUBLE, 6) AS cost FROM customer""")
def cursor_page_events(spark, sf_dir):
    model = F.when(key() % 2 == 0, '"gpt-5"').otherwise("null")
    page = filled(
        '{"totalUsageEventsCount": 2, "usageEventsDisplay": [{"timestamp": " %d ", "model": %s, "tokenUsage": {"inputTokens": %d, "outputTokens": -5, "cacheReadTokens": 7, "totalCents": %d}}, {"timestamp": "soon", "tokenUsage": {}}]}',
        key() + 1700000000000, model, key(), key() % 1000,
    )
    return logs.cursor_pages(table(spark, sf_dir, "customer").select(page.alias("value"))).withColumn("cost", F.round("cost", 6))


# --- functions -----------------------------------------------------------------------------------


@query("""WITH x AS (SELECT o_orderkey, o_orderkey * 37 - 5000 AS s FROM orders), m AS (SELECT *, (s + 59) // 60 AS m FROM x)
SELECT o_orderkey, CASE WHEN s <= 0 THEN 'Resets now' WHEN m < 60 THEN 'Resets in ' || m || 'm'
  WHEN m // 60 < 48 THEN 'Resets in ' || (m // 60) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || 'm' ELSE '' END
  ELSE 'Resets in ' || (m // 1440) || 'd' || CASE WHEN m // 60 % 24 > 0 THEN ' ' || (m // 60 % 24) || 'h' ELSE '' END END AS shown FROM m""")
def reset_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", times.reset_text(F.lit(NOW_MS), F.lit(NOW_MS) + (F.col("o_orderkey") * 37 - 5000) * 1000).alias("shown"))


@query("""SELECT event_id, CAST(floor(least(100, greatest(0, value - 100)) + 0.5) AS BIGINT) AS percent, round(greatest(4, value / 490 * 100), 6) AS bar, round(0.05 + pow(value / 490, 0.6) * 4, 6) AS height,
  round(least(1, pow(value / 490, 0.5)), 6) AS color, round(least(100, value * 2500 / 10000), 6) AS load, CAST(floor(500 / greatest(1, least(100, value * 2500 / 10000) / 5)) AS BIGINT) AS interval_ms FROM events""")
def view_scales(spark, sf_dir):
    v, most = F.col("value"), F.lit(490.0)
    load = fmt.animation_load(v * 2500)
    return table(spark, sf_dir, "events").select(
        "event_id", fmt.clamp_percent(v - 100).alias("percent"), F.round(fmt.bar_percent(v, most), 6).alias("bar"), F.round(fmt.tile_height(v, most), 6).alias("height"),
        F.round(fmt.color_ratio(v, most), 6).alias("color"), F.round(load, 6).alias("load"), fmt.animation_interval_ms(load).alias("interval_ms"),
    )


def cased_sql(text: str, split: str, word: str = "x") -> str:
    return f"array_to_string(list_transform(list_filter(string_split_regex({text}, '{split}'), lambda x: x <> ''), lambda x: upper({word}[1]) || {word}[2:]), ' ')"


@query(f"""SELECT p_partkey, {cased_sql("p_name || '-' || p_type", '[_-]')} AS plan, 'GPT ' || {cased_sql("p_name || '_' || p_brand", r'[\s_-]+')} AS limit_label,
  {cased_sql("p_type || '_' || p_name", r'[\s_-]+', 'lower(x)')} AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Codex Spark' ELSE 'Codex' END AS extra FROM part""")
def label_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", labels.plan_label(F.concat_ws("-", "p_name", "p_type")).alias("plan"), labels.limit_label(F.concat(F.lit("gpt-"), "p_name", F.lit("_"), "p_brand")).alias("limit_label"),
        labels.title_words(F.concat_ws("_", "p_type", "p_name")).alias("title"), labels.extra_limit_label(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "a Spark").otherwise("codex")).alias("extra"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '$' || printf('%.2f', round(o_totalprice) / 100) WHEN 1 THEN printf('%.2f', round(o_totalprice) / 100) || ' EUR' ELSE '$' || printf('%.2f', round(o_totalprice) / 100) END AS money,
  CASE WHEN o_orderkey % 40 BETWEEN 6 AND 8 THEN 'Weekly' WHEN o_orderkey % 40 BETWEEN 27 AND 33 THEN 'Monthly' ELSE 'Credits' END AS cycle FROM orders""")
def money_and_cycles(spark, sf_dir):
    k = F.col("o_orderkey")
    currency = F.when(k % 3 == 0, " usd ").when(k % 3 == 1, "eur")
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.minor_units(F.round("o_totalprice"), currency).alias("money"), labels.cycle_label(F.lit(0).cast("long"), k % 40 * 86_400_000).alias("cycle"))


#: Names as live views meet them, and what the dashboard calls them; the same for billing and routing names.
LIVE = ("claude-code", "codex-cli", "gemini-cli", "amp-cli", "omp"), ("claude", "codex", "gemini", "amp", "omp")
BILLED = ("Anthropic API", "openai", "vertex-google", "XAI", "deepseek", "meta-llama", "", "custom-gw"), ("anthropic", "openai", "google", "xai", "deepseek", "meta", "openai", "custom-gw")
ROUTED = ("anthropic-messages", " Azure ", "google-vertex", "xai", "openrouter"), ("anthropic", "openai", "google", "xai", "")
DEFAULTS = ("anthropic", "openai", "google", "xai", "meta"), ("claude-unknown", "gpt-unknown", "gemini-unknown", "grok-unknown", "unknown")


@query(f"""SELECT event_id, {choice_sql(LIVE[1], 'user_id')} AS client, {choice_sql(BILLED[1], 'event_id')} AS billed, {choice_sql(ROUTED[1], 'event_id')} AS routed, {choice_sql(DEFAULTS[1], 'event_id')} AS model,
  'subagent:' || user_id AS agent, CASE user_id % 3 WHEN 0 THEN 'OpenCode' WHEN 1 THEN 'Omp' ELSE 'New Client' END AS shown FROM events""")
def name_maps(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    path = F.concat(F.lit("/home/x.y/"), "event_type", F.lit("/agent-"), u.cast("string"), F.lit(".jsonl"))
    return table(spark, sf_dir, "events").select(
        "event_id", models.live_client(choice(LIVE[0], u)).alias("client"), models.billing_provider(choice(BILLED[0], e), F.lit("gpt-5")).alias("billed"), models.routing_provider(choice(ROUTED[0], e)).alias("routed"),
        models.default_model(choice(DEFAULTS[0], e)).alias("model"), models.sidechain_label(path).alias("agent"), labels.display_name(choice(("opencode", "omp", "new-client"), u)).alias("shown"),
    )


ZONES = ("Z", "+02:00", "-05:30", "")


@query("""WITH x AS (SELECT o_orderkey, epoch_ms(o_orderdate) AS d, o_orderkey % 1000000 // 1000 AS f, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 120 WHEN 2 THEN -330 END AS z, o_orderdate FROM orders)
SELECT o_orderkey, d + f - z * 60000 AS ms, CASE WHEN o_orderkey % 2 = 0 THEN d + 43200000 ELSE 0 END AS noon, strftime(o_orderdate, '%b %-d') AS short, strftime(o_orderdate, '%m/%d') AS day FROM x""")
def timestamp_texts(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.concat(day.cast("string"), F.lit("T00:00:00."), F.lpad((k % 1_000_000).cast("string"), 6, "0"), choice(ZONES, k))
    plain = F.when(k % 2 == 0, day.cast("string")).otherwise("yesterday")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.rfc3339_ms(text).alias("ms"), times.date_or_zero_ms(plain).alias("noon"), fmt.short_date(day).alias("short"), fmt.month_day(day).alias("day"))


@query("""SELECT event_id, CASE WHEN event_id % 7 < 4 THEN user_id END AS whole, CASE WHEN event_id % 7 < 3 THEN user_id::DOUBLE WHEN event_id % 7 = 3 THEN user_id + 0.9::DOUBLE END AS number,
  CASE WHEN event_id % 7 < 3 THEN user_id::VARCHAR WHEN event_id % 7 = 3 THEN user_id || '.9' END AS text, CASE WHEN event_id % 7 = 6 THEN 1 WHEN event_id % 7 = 5 THEN NULL WHEN event_id % 7 < 4 THEN user_id END AS either FROM events""")
def lenient_json(spark, sf_dir):
    u = F.col("user_id").cast("string")
    shapes = [F.concat(F.lit('{"x": '), u, F.lit("}")), F.concat(F.lit('{"x": "'), u, F.lit('"}')), F.concat(F.lit('{"x": " '), u, F.lit(' "}')), F.concat(F.lit('{"x": '), u, F.lit(".9}")), F.lit('{"x": true}'), F.lit('{"x": null}'), F.lit('{"y": 1}')]
    rows = table(spark, sf_dir, "events").select("event_id", J.parse(F.element_at(F.array(*shapes), (F.col("event_id") % 7 + 1).cast("int"))).alias("v"))
    x = J.node(F.col("v"), "$.x")
    return rows.select("event_id", J.i64_value(x).alias("whole"), J.f64_value(x).alias("number"), J.string_value(x).alias("text"), J.i64_value(J.first_present(F.col("v"), "$.x", "$.y")).alias("either"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 9223372036854775000::HUGEINT WHEN 1 THEN -9223372036854775000::HUGEINT ELSE event_id END AS a, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END::HUGEINT AS b FROM events)
SELECT event_id, CAST(greatest(-9223372036854775808::HUGEINT, least(9223372036854775807::HUGEINT, a + b)) AS BIGINT) AS added, CAST(greatest(-9223372036854775808::HUGEINT, least(9223372036854775807::HUGEINT, a - b)) AS BIGINT) AS taken,
  CAST(greatest(-9223372036854775808::HUGEINT, least(9223372036854775807::HUGEINT, a * b)) AS BIGINT) AS times FROM x""")
def saturating_arithmetic(spark, sf_dir):
    k = F.col("event_id")
    a = F.when(k % 3 == 0, F.lit(9223372036854775000)).when(k % 3 == 1, F.lit(-9223372036854775000)).otherwise(k)
    b = F.when(k % 2 == 0, k).otherwise(-k)
    return table(spark, sf_dir, "events").select("event_id", J.saturating_add(a, b).alias("added"), J.saturating_subtract(a, b).alias("taken"), J.saturating_multiply(a, b).alias("times"))


@query("SELECT c_custkey, 3 AS fields, c_name || ', x' AS name, CASE WHEN c_custkey % 2 = 0 THEN 1000.5 + c_custkey ELSE 0 END::DOUBLE AS cost FROM customer")
def csv_fields(spark, sf_dir):
    cost = F.when(key() % 2 == 0, F.format_number(F.lit(1000.5) + key(), 2)).otherwise("Included")
    line = F.concat(key().cast("string"), F.lit(',"'), "c_name", F.lit(', x","$'), cost, F.lit('"'))
    parts = logs.split_csv(line)
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(parts).alias("fields"), logs.clean_csv(F.get(parts, F.lit(1))).alias("name"), logs.parse_cost(logs.clean_csv(F.get(parts, F.lit(2)))).alias("cost"))


# --- order, retention and narrowing --------------------------------------------------------------


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY replace(p_name, ' ', chr(1)), CAST(p_partkey AS VARCHAR)) AS INTEGER) AS place FROM part")
def path_sort(spark, sf_dir):
    path = F.concat(F.translate("p_name", " ", "/"), F.lit("/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(files.path_key(path))).alias("place"))


@query(f"WITH {EVENTS_SQL} SELECT ts_ms, client, agent, model, input, output, cache_read, cache_write FROM ev WHERE ts_ms >= {NOW_MS - 3_600_000}")
def retained_events(spark, sf_dir):
    order = ["ts_ms", "client", "agent", "model", "input", "output", "cache_read", "cache_write"]
    return trace.retained(usage_events(spark, sf_dir), NOW_MS).select(*order).orderBy(*order)


ORDER_DAYS_SQL = "g AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, sum(CAST(o_totalprice AS DECIMAL(28,10))) AS cost FROM orders GROUP BY 1)"


def order_days(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("date")).agg(rollup.money_sum(F.col("o_totalprice")).alias("cost"))


@query(f"""WITH {ORDER_DAYS_SQL}, s AS (SELECT *, CAST(cost AS DOUBLE) / (SELECT CAST(max(cost) AS DOUBLE) FROM g) AS share FROM g)
SELECT date, round(CAST(cost AS DOUBLE), 2) AS cost, CASE WHEN share >= 0.75 THEN 4 WHEN share >= 0.5 THEN 3 WHEN share >= 0.25 THEN 2 WHEN share > 0 THEN 1 ELSE 0 END AS intensity FROM s WHERE date LIKE '1998-%'""")
def narrowed_year(spark, sf_dir):
    """Narrowed after the rollup: intensities stay relative to the dearest of all days."""
    return rollup.narrow(rollup.with_intensity(order_days(spark, sf_dir)), "1998").withColumn("cost", F.round("cost", 2))


@query("""SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS start, strftime(max(o_orderdate), '%Y-%m-%d') AS "end" FROM orders""")
def date_range(spark, sf_dir):
    return rollup.date_range(order_days(spark, sf_dir))


@query(f"""WITH {MESSAGES_SQL}, t AS (SELECT user_id, sum(k) AS s, max(timestamp_ms) AS ts FROM u WHERE user_id % 5 > 0 GROUP BY user_id), g AS (SELECT DISTINCT user_id, user_id * 40 AS total, user_id * 10 AS "before", CASE WHEN user_id % 2 = 1 THEN user_id * 60 END AS context FROM u),
e AS (SELECT user_id, CASE WHEN context IS NULL THEN "before" + total ELSE greatest(total, "before" + context) END AS total FROM g)
SELECT user_id, CAST(total - coalesce(s, 0) AS BIGINT) AS extra, coalesce(ts, 7) AS timestamp_ms FROM e LEFT JOIN t USING (user_id) WHERE total > 0 AND total - coalesce(s, 0) > 0""")
def signals_remainder(spark, sf_dir):
    u = usage_messages(spark, sf_dir)
    signals = u.select("user_id").distinct().select(
        "user_id", (F.col("user_id") * 40).alias("total"), (F.col("user_id") * 10).alias("before"), F.when(F.col("user_id") % 2 == 1, F.col("user_id") * 60).alias("context"), F.lit(7).cast("long").alias("session_ms"),
    )
    turns = u.filter("user_id % 5 > 0").select("user_id", F.col("k").alias("delta"), "timestamp_ms")
    return stateful.signals_remainder(turns, signals, ["user_id"]).select("user_id", "extra", "timestamp_ms")
