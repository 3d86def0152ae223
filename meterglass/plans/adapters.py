"""The benchmark tables read as usage logs, in Spark and, for the oracle, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models

#: Model ids as logged, the provider that the log names, and what is expected of each, written out by
#: hand from the price list: the provider, the number of the rule, USD per million tokens of input,
#: output, cache read and cache write, and the same above a threshold. Every rule is reached.
EXPECTED = (
    ("claude-fable-1", "", "anthropic", 1, 10.0, 50.0, 1.0, 12.5),
    ("claude-opus-4.6-fast", "", "anthropic", 2, 30.0, 150.0, 3.0, 37.5),
    ("claude-opus-4-8-fast", "", "anthropic", 3, 10.0, 50.0, 1.0, 12.5),
    ("Claude-Opus-4.6", "", "anthropic", 4, 5.0, 25.0, 0.5, 6.25),
    ("claude-3-opus", "", "anthropic", 5, 15.0, 75.0, 1.5, 18.75),
    ("claude-haiku-4-5-20251001", "", "anthropic", 6, 1.0, 5.0, 0.1, 1.25),
    ("claude-3-5-haiku", "", "anthropic", 7, 0.8, 4.0, 0.08, 1.0),
    ("claude-sonnet-4-20250514", "", "anthropic", 8, 3.0, 15.0, 0.3, 3.75, 200000, 6.0, 22.5, 0.6, 7.5),
    ("claude-3-5-sonnet", "", "anthropic", 9, 3.0, 15.0, 0.3, 3.75, 200000, 6.0, 30.0, 0.6, 7.5),
    ("claude-2.1", "", "anthropic", 10, 3.0, 15.0, 0.3, 3.75),
    ("gpt-4o-2024-05-13", "", "openai", 11, 5.0, 15.0, 0.0, 0.0),
    ("openai/gpt-4o-mini", "", "unknown", 12, 0.15, 0.6, 0.075, 0.0),
    ("gpt-4o", "", "openai", 13, 2.5, 10.0, 1.25, 0.0),
    ("gpt-5.5-pro", "", "openai", 14, 30.0, 180.0, 0.0, 0.0, 272000, 60.0, 270.0, 0.0, None),
    ("gpt-5.2-pro", "", "openai", 15, 21.0, 168.0, 0.0, 0.0),
    ("gpt-5-pro", "", "openai", 16, 15.0, 120.0, 0.0, 0.0),
    ("gpt-5.4-mini", "", "openai", 17, 0.75, 4.5, 0.075, 0.0),
    ("gpt-5.4-nano", "", "openai", 18, 0.2, 1.25, 0.02, 0.0),
    ("gpt-5.5", "", "openai", 19, 5.0, 30.0, 0.5, 0.0, 272000, 10.0, 45.0, 1.0, None),
    (" GPT-5.4 Codex ", "", "openai", 20, 2.5, 15.0, 0.25, 0.0, 272000, 5.0, 22.5, 0.5, None),
    ("gpt-5.3-codex", "", "openai", 21, 1.75, 14.0, 0.175, 0.0),
    ("gpt-5.2", "", "openai", 22, 1.75, 14.0, 0.175, 0.0),
    ("gpt-5.1-codex-mini", "", "openai", 23, 0.25, 2.0, 0.025, 0.0),
    ("gpt-5-nano", "", "openai", 24, 0.05, 0.4, 0.005, 0.0),
    ("codex-auto", "", "unknown", 25, 1.25, 10.0, 0.125, 0.0),
    ("o3-pro", "", "openai", 26, 20.0, 80.0, 0.0, 0.0),
    ("o3-mini", "", "openai", 27, 1.1, 4.4, 0.55, 0.0),
    ("o3-deep-research", "", "openai", 28, 10.0, 40.0, 2.5, 0.0),
    ("o3", "", "openai", 29, 2.0, 8.0, 0.5, 0.0),
    ("o4-mini-deep-research", "", "openai", 30, 2.0, 8.0, 0.5, 0.0),
    ("o4-mini", "", "openai", 31, 1.1, 4.4, 0.275, 0.0),
    ("o4", "", "openai", 32, 2.0, 8.0, 0.5, 0.0),
    ("glm-4.7-flashx", "", "unknown", 33, 0.07, 0.4, 0.01, 0.0),
    ("glm-4.7", "", "unknown", 34, 0.6, 2.2, 0.11, 0.0),
    ("kimi-k2.5", "", "unknown", 35, 0.6, 3.0, 0.1, 0.0),
    ("composer-1", "", "unknown", 36, 1.25, 10.0, 0.125, 0.0),
    ("composer-1.5", "", "unknown", 37, 3.5, 17.5, 0.35, 0.0),
    ("grok-composer-2", "", "xai", 38, 0.5, 2.5, 0.2, 0.0),
    ("composer-2.5-fast", "", "unknown", 39, 1.5, 7.5, 0.35, 0.0),
    ("gemini-3.5-flash", "", "google", 40, 1.5, 9.0, 0.15, 0.0),
    ("gemini-3.1-flash-lite", "", "google", 41, 0.25, 1.5, 0.025, 0.0),
    ("gemini-3-pro-preview", "", "google", 42, 2.0, 12.0, 0.2, 0.0, 200000, 4.0, 18.0, 0.4, 0.0),
    ("gemini-3-flash", "", "google", 43, 0.5, 3.0, 0.05, 0.0),
    ("gemini-2.5-flash-lite", "", "google", 44, 0.1, 0.4, 0.01, 0.0),
    ("gemini-2.5-flash", "", "google", 45, 0.3, 2.5, 0.03, 0.0),
    ("gemini-2.0-flash-lite", "", "google", 46, 0.075, 0.3, 0.0, 0.0),
    ("gemini-2.0-flash", "", "google", 47, 0.1, 0.4, 0.025, 0.0),
    ("gemini-2.5-pro", "", "google", 48, 1.25, 10.0, 0.125, 0.0, 200000, 2.5, 15.0, 0.25, 0.0),
    ("gemini-flash-lite-latest", "", "google", 49, 0.1, 0.4, 0.025, 0.0),
    ("gemini-flash-latest", "", "google", 50, 0.3, 2.5, 0.075, 0.0),
    ("gemini-1.5-flash", "", "google", 51, 0.3, 2.5, 0.075, 0.0),
    ("gemini-1.5-pro", "", "google", 52, 1.25, 10.0, 0.125, 0.0),
    ("grok-4.5", "", "xai", 53, 2.0, 6.0, 0.5, 0.0),
    ("grok-4.3", "", "xai", 54, 1.25, 2.5, 0.2, 0.0),
    ("grok-4.1", "", "xai", 55, 0.2, 0.5, 0.05, 0.0),
    ("grok-4", "", "xai", 56, 3.0, 15.0, 0.75, 0.0),
    ("grok-3-mini", "", "xai", 57, 0.3, 0.5, 0.075, 0.0),
    ("grok-3", "", "xai", 58, 3.0, 15.0, 0.75, 0.0),
    ("grok-code", "", "xai", 59, 2.0, 6.0, 0.5, 0.0),
    ("mystery-a", "anthropic", "anthropic", 60, 3.0, 15.0, 0.3, 3.75),
    ("o1-preview", " ", "openai", 61, 1.25, 10.0, 0.125, 0.0),
    ("mystery-b", "google", "google", 62, 1.25, 10.0, 0.125, 0.0),
    ("mystery-c", "xai", "xai", 63, 2.0, 6.0, 0.5, 0.0),
    ("mystery-1", "", "unknown", 64, 0.0, 0.0, 0.0, 0.0),
    ("deepseek-v3", "", "deepseek", 64, 0.0, 0.0, 0.0, 0.0),
    ("llama-3.1-70b", "", "meta", 64, 0.0, 0.0, 0.0, 0.0),
)
PALETTE = tuple(x[0] for x in EXPECTED)
NAMED = tuple(x[1] for x in EXPECTED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_array(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def picked(values, by: str) -> Column:
    return F.expr(f"element_at(array({text_array(values)}), CAST({by} % {len(values)} + 1 AS INT))")


def usage_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as message rows; every eleventh has no tokens, keys repeat within a user's day, and every thirteenth has none."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    some = F.when(F.col("event_id") % 11 == 0, 0).otherwise(1)
    millis = F.unix_date(F.to_date("ts")).cast("long") * 86_400_000 + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.floor(F.expr("extract(SECOND FROM ts)") * 1000).cast("long")
    day = F.to_date("ts").cast("string")
    return e.select(
        F.col("event_id").alias("ord"),
        picked(models.CLIENTS, "user_id").alias("client"),
        models.normalize_model(picked(PALETTE, "event_id")).alias("model_id"),
        picked(NAMED, "event_id").alias("provider_id"),
        millis.alias("timestamp_ms"),
        day.alias("date"),
        (F.round(F.col("value") * 100).cast("long") * 100 * some).alias("input"),
        (k * 1000 * some).alias("output"),
        (F.col("event_id") % 7 * 50_000 * some).alias("cache_read"),
        (F.col("event_id") % 3 * 10_000 * some).alias("cache_write"),
        (F.col("event_id") % 5 * 100 * some).alias("reasoning"),
        F.when(F.col("event_type") == "purchase", F.col("value") / 100).otherwise(0.0).alias("cost"),
        F.lit(1).alias("messages"),
        F.when(F.col("event_id") % 13 > 0, F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"), day)).alias("dedup_key"),
        F.col("user_id"), F.col("event_type"), k.alias("k"),
    )


MESSAGES_SQL = f"""
u AS (
  SELECT event_id AS ord, [{text_array(models.CLIENTS)}][user_id % 11 + 1] AS client,
    lower(trim([{text_array(PALETTE)}][event_id % {len(PALETTE)} + 1])) AS model_id, [{text_array(NAMED)}][event_id % {len(NAMED)} + 1] AS provider_id,
    epoch_us(ts) // 1000 AS timestamp_ms, strftime(ts, '%Y-%m-%d') AS date,
    CAST(round(value * 100) AS BIGINT) * 100 * z AS input, k * 1000 * z AS output, event_id % 7 * 50000 * z AS cache_read,
    event_id % 3 * 10000 * z AS cache_write, event_id % 5 * 100 * z AS reasoning,
    CASE WHEN event_type = 'purchase' THEN value / 100 ELSE 0.0::DOUBLE END AS cost, 1 AS messages,
    CASE WHEN event_id % 13 > 0 THEN user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') END AS dedup_key, user_id, event_type, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS z FROM events))
"""


def sql_value(v) -> str:
    return "NULL" if v is None else repr(v)


#: Of each normalised model id what is expected of it.
EXPECTED_SQL = ", ".join(
    "(" + ", ".join([repr(model.strip().lower()), *map(sql_value, (provider, *values, *(None,) * (10 - len(values))))]) + ")" for model, _, provider, *values in EXPECTED
)
#: What tells rows apart that have no key.
KEY_SQL = "coalesce(dedup_key, client || ':' || model_id || ':' || provider_id || ':' || timestamp_ms || ':' || input || ':' || output || ':' || cache_read || ':' || cache_write)"


def tier_sql(tokens: str, part: str) -> str:
    return (
        f"CASE WHEN tier_at IS NOT NULL AND {part}_above IS NOT NULL THEN least({tokens}, tier_at)::DOUBLE * {part}_price"
        f" + greatest({tokens} - tier_at, 0)::DOUBLE * {part}_above ELSE ({tokens})::DOUBLE * {part}_price END"
    )


ESTIMATE_SQL = f"({tier_sql('input', 'input')} + {tier_sql('output + reasoning', 'output')} + {tier_sql('cache_read', 'cache_read')} + {tier_sql('cache_write', 'cache_write')}) / 1e6"

PRICED_SQL = f"""
expected(model_id, provider, price_rule, input_price, output_price, cache_read_price, cache_write_price, tier_at, input_above, output_above, cache_read_above, cache_write_above)
  AS (VALUES {EXPECTED_SQL}),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY ord) AS rn FROM u) WHERE rn = 1),
v AS (SELECT *, input + output + cache_read + cache_write + reasoning AS tokens FROM d
      WHERE timestamp_ms > 0 AND input + output + cache_read + cache_write + reasoning > 0),
q AS (SELECT v.* EXCLUDE (provider_id), provider AS provider_id, expected.* EXCLUDE (model_id, provider) FROM v JOIN expected USING (model_id)),
e AS (SELECT q.* EXCLUDE (cost), CASE WHEN cost <= 0 THEN {ESTIMATE_SQL} ELSE cost END AS cost FROM q)
"""

#: Enriched messages as the oracle's CTE ``e``.
ENRICHED_SQL = f"WITH {MESSAGES_SQL}, {PRICED_SQL}"


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as live events; the key repeats within a user's hour."""
    m = usage_messages(spark, sf_dir)
    return m.select(
        F.col("timestamp_ms").alias("ts_ms"), F.concat("client", F.when(F.col("client").isin("codex", "gemini"), F.lit("-cli")).otherwise("")).alias("client"),
        F.when(F.col("ord") % 4 == 0, F.concat(F.lit("subagent:a"), (F.col("user_id") % 3).cast("string"))).otherwise("main").alias("agent"),
        F.when(F.col("ord") % 9 == 0, "unknown").otherwise(models.normalize_live_model(F.col("model_id"))).alias("model"),
        "input", "output", "cache_read", "cache_write",
        F.when(F.col("ord") % 5 > 0, F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.col("timestamp_ms") / 3_600_000).cast("string"))).alias("key"), "ord",
    )


EVENTS_SQL = f"""{MESSAGES_SQL},
ev AS (SELECT timestamp_ms AS ts_ms, client || CASE WHEN client IN ('codex', 'gemini') THEN '-cli' ELSE '' END AS client,
  CASE WHEN ord % 4 = 0 THEN 'subagent:a' || (user_id % 3) ELSE 'main' END AS agent,
  CASE WHEN ord % 9 = 0 THEN 'unknown' WHEN length(model_id) > 9 THEN regexp_replace(lower(model_id), '-[0-9]{{8}}$', '') ELSE lower(model_id) END AS model,
  input, output, cache_read, cache_write, CASE WHEN ord % 5 > 0 THEN user_id || ':' || (timestamp_ms // 3600000) END AS key, ord FROM u)"""
