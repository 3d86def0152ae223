"""Every batch query by name, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions import models, pricing
from ..functions import time as times
from ..operators import derived, messages, rollup, stateful, trace
from .adapters import ENRICHED_SQL, EVENTS_SQL, KEY_SQL, MESSAGES_SQL, table, usage_events, usage_messages
from .registry import query

#: A moment after which the trace queries look back: the end of January 29, 2024, in milliseconds.
NOW_MS = 1706572800000
TRACE_S = 86_400


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.enriched(usage_messages(spark, sf_dir))


def money(*names: str) -> dict:
    return {n: F.round(F.col(n), 8) for n in names}


FIVE = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(reasoning) AS BIGINT) AS reasoning"
COST = "round(CAST(sum(CAST(cost AS DECIMAL(28,10))) AS DOUBLE), 8)"
TOTALS = f"{FIVE}, CAST(sum(tokens) AS BIGINT) AS tokens, {COST} AS cost, CAST(sum(messages) AS BIGINT) AS messages"


@query(f"WITH {MESSAGES_SQL} SELECT ord, client, model_id, timestamp_ms, date, input, output, cache_read, cache_write, reasoning, round(cost, 8) AS cost, dedup_key FROM u")
def usage_message_rows(spark, sf_dir):
    return usage_messages(spark, sf_dir).select("ord", "client", "model_id", "timestamp_ms", "date", *messages.TOKENS, F.round("cost", 8).alias("cost"), "dedup_key")


@query(f"WITH {MESSAGES_SQL} SELECT ord, client, model_id, dedup_key, input FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY ord) AS rn FROM u) WHERE rn = 1")
def dedup_first_wins(spark, sf_dir):
    return messages.dedup(usage_messages(spark, sf_dir)).select("ord", "client", "model_id", "dedup_key", "input")


@query(f"{ENRICHED_SQL} SELECT ord, client, model_id, provider_id, date, tokens, price_rule, round(cost, 8) AS cost FROM e")
def enriched_messages(spark, sf_dir):
    rows = messages.enriched(usage_messages(spark, sf_dir), keep=("price_rule",))
    return rows.select("ord", "client", "model_id", "provider_id", "date", messages.total_tokens().alias("tokens"), "price_rule", F.round("cost", 8).alias("cost"))


@query(f"{ENRICHED_SQL} SELECT DISTINCT model_id, provider_id, price_rule, input_price, output_price, cache_read_price, cache_write_price, CAST(tier_at AS BIGINT) AS tier_at, CAST(input_above AS DOUBLE) AS input_above FROM q")
def model_price_lookup(spark, sf_dir):
    rows = messages.with_provider(messages.valid(messages.dedup(usage_messages(spark, sf_dir))))
    return pricing.price_table(rows).select("model_id", "provider_id", "price_rule", "input_price", "output_price", "cache_read_price", "cache_write_price", "tier_at", "input_above")


@query(f"{ENRICHED_SQL} SELECT date, {TOTALS} FROM e GROUP BY date")
def daily_totals(spark, sf_dir):
    return rollup.daily_totals(enriched(spark, sf_dir)).withColumns(money("cost"))


@query(f"{ENRICHED_SQL} SELECT date, client, provider_id, model_id, {TOTALS} FROM e GROUP BY ALL")
def daily_client_rollup(spark, sf_dir):
    return rollup.daily_client(enriched(spark, sf_dir)).withColumns(money("cost"))


@query(f"""{ENRICHED_SQL}, days AS (SELECT date, {TOTALS}, CAST(sum(CAST(cost AS DECIMAL(28,10))) AS DOUBLE) AS exact FROM e GROUP BY date)
SELECT * EXCLUDE (exact), CASE WHEN max(exact) OVER () <= 0 THEN 0 WHEN exact / max(exact) OVER () >= 0.75 THEN 4 WHEN exact / max(exact) OVER () >= 0.5 THEN 3
  WHEN exact / max(exact) OVER () >= 0.25 THEN 2 WHEN exact > 0 THEN 1 ELSE 0 END AS intensity FROM days""")
def daily_contributions(spark, sf_dir):
    return rollup.with_intensity(rollup.daily_totals(enriched(spark, sf_dir))).withColumns(money("cost"))


@query(f"""{ENRICHED_SQL}, g AS (SELECT date, client, provider_id, model_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY ALL)
SELECT date, CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(client || '/' || provider_id || '/' || model_id || '=' || tokens, ',' ORDER BY client, provider_id, model_id) AS clients FROM g GROUP BY date""")
def nested_clients(spark, sf_dir):
    days = rollup.contributions(enriched(spark, sf_dir))
    tokens = lambda t: t["input"] + t["output"] + t["cache_read"] + t["cache_write"] + t["reasoning"]
    text = F.transform("clients", lambda c: F.concat(c["client"], F.lit("/"), c["provider_id"], F.lit("/"), c["model_id"], F.lit("="), tokens(c["tokens"]).cast("string")))
    return days.select("date", F.col("totals.tokens").alias("tokens"), F.array_join(text, ",").alias("clients"))


@query(f"""{ENRICHED_SQL}, g AS (SELECT date, sum(tokens) AS t, sum(CAST(cost AS DECIMAL(28,10))) AS c FROM e GROUP BY date)
SELECT (SELECT CAST(sum(t) AS BIGINT) FROM g) AS total_tokens, (SELECT round(CAST(sum(c) AS DOUBLE), 8) FROM g) AS total_cost, (SELECT CAST(count(*) AS INTEGER) FROM g) AS total_days,
  (SELECT CAST(count(*) AS INTEGER) FROM g WHERE t > 0) AS active_days, (SELECT round(CAST(max(c) AS DOUBLE), 8) FROM g) AS max_cost_in_single_day, (SELECT min(date) FROM g) AS start, (SELECT max(date) FROM g) AS "end",
  (SELECT round(CAST(sum(c) AS DOUBLE) / count(*) FILTER (t > 0), 8) FROM g) AS average_per_day,
  (SELECT string_agg(DISTINCT client, ',' ORDER BY client) FROM e) AS clients, (SELECT string_agg(DISTINCT model_id, ',' ORDER BY model_id) FROM e) AS models""")
def usage_summary(spark, sf_dir):
    one = rollup.summary(enriched(spark, sf_dir)).withColumns(money("total_cost", "max_cost_in_single_day", "average_per_day"))
    return one.withColumns({"clients": F.array_join("clients", ","), "models": F.array_join("models", ",")})


@query(f"""{ENRICHED_SQL} SELECT substr(date, 1, 4) AS year, CAST(sum(tokens) AS BIGINT) AS total_tokens, {COST} AS total_cost, min(date) AS start, max(date) AS "end" FROM e GROUP BY 1""")
def year_rollup(spark, sf_dir):
    return rollup.years(enriched(spark, sf_dir)).withColumns(money("total_cost"))


@query("""SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS orders, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28,10))) AS DOUBLE), 2) AS total_cost, strftime(min(o_orderdate), '%Y-%m-%d') AS start, strftime(max(o_orderdate), '%Y-%m-%d') AS "end" FROM orders GROUP BY 1""")
def order_years(spark, sf_dir):
    """The years of the library's rollup, an order counting as one token."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("output", "cache_read", "cache_write", "reasoning")]
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").cast("string").alias("date"), F.lit(1).cast("long").alias("input"), *zero, F.col("o_totalprice").alias("cost"))
    return rollup.years(o).withColumnRenamed("total_tokens", "orders").withColumn("total_cost", F.round("total_cost", 2))


@query(f"{ENRICHED_SQL} SELECT date, {TOTALS} FROM e WHERE date LIKE '2024-%' GROUP BY date")
def year_filter(spark, sf_dir):
    return rollup.daily_totals(messages.enriched(usage_messages(spark, sf_dir), year=" 2024 ")).withColumns(money("cost"))


SELECTED = ["claude", "codex", "grok"]
SELECTED_SQL = "('claude', 'codex', 'grok')"
PER_DAY_SQL = f"per_day AS (SELECT date, CAST(sum(tokens) AS BIGINT) AS tokens, sum(CAST(cost AS DECIMAL(28,10))) AS cost FROM e WHERE client IN {SELECTED_SQL} GROUP BY date)"


@query(f"""{ENRICHED_SQL}, {PER_DAY_SQL},
r AS (SELECT min(date) AS start, max(date) AS "end" FROM e),
i AS (SELECT date, CAST(date AS DATE) - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS a FROM per_day WHERE tokens > 0),
runs AS (SELECT max(date) AS last, CAST(count(*) AS INTEGER) AS n FROM i GROUP BY a)
SELECT (SELECT CAST(sum(tokens) AS BIGINT) FROM per_day) AS total_tokens, (SELECT round(CAST(sum(cost) AS DOUBLE), 8) FROM per_day) AS total_cost, (SELECT CAST(count(*) AS INTEGER) FROM per_day) AS active_days,
  (SELECT max(tokens) FROM per_day) AS max_tokens, (SELECT date FROM per_day ORDER BY cost DESC, date LIMIT 1) AS best_day, (SELECT round(CAST(max(cost) AS DOUBLE), 8) FROM per_day) AS best_cost,
  (SELECT round(CAST(sum(cost) AS DOUBLE) / count(*), 8) FROM per_day) AS average_per_day, start, "end",
  (SELECT string_agg(DISTINCT client, ',' ORDER BY client) FROM e) AS present_clients,
  (SELECT max(n) FROM runs) AS longest_streak, coalesce((SELECT n FROM runs WHERE last = r."end"), 0) AS current_streak FROM r""")
def stats_by_client(spark, sf_dir):
    one = derived.stats(rollup.daily_client(enriched(spark, sf_dir)), SELECTED).withColumns(money("total_cost", "best_cost", "average_per_day"))
    return one.withColumn("present_clients", F.array_join("present_clients", ","))


@query(f"{ENRICHED_SQL}, {PER_DAY_SQL} SELECT date, tokens, round(CAST(cost AS DOUBLE), 8) AS cost FROM per_day WHERE tokens <> 0 OR cost <> 0")
def client_semi_join(spark, sf_dir):
    chosen = spark.createDataFrame([(c,) for c in SELECTED], "client string")
    return derived.per_day(rollup.daily_client(enriched(spark, sf_dir)), chosen).withColumns(money("cost"))


@query("""WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS INTEGER) AS a FROM d),
runs AS (SELECT o_custkey, max(day) AS last, CAST(count(*) AS INTEGER) AS n FROM i GROUP BY o_custkey, a)
SELECT o_custkey, max(n) AS longest_streak, coalesce(max(CASE WHEN last = DATE '1998-07-01' THEN n END), 0) AS current_streak
FROM runs JOIN (SELECT DISTINCT o_custkey AS k FROM d) ON k = o_custkey GROUP BY o_custkey""")
def order_streaks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("date"), F.lit(1).alias("tokens"))
    found = derived.streaks(o, F.lit("1990-01-01").cast("date"), F.lit("2010-01-01").cast("date"), ("o_custkey",))
    ends = derived.islands(o.select("o_custkey", F.col("date").cast("date").alias("day")).distinct(), ("o_custkey",)).filter(F.col("last") == F.lit("1998-07-01").cast("date"))
    return found.drop("current_streak").join(ends.select("o_custkey", F.col("length").alias("current_streak")), "o_custkey", "left").fillna(0, ["current_streak"])


@query("""WITH f AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS tokens, sum(CAST(o_totalprice AS DECIMAL(28,10))) AS cost FROM orders GROUP BY 1),
c AS (SELECT i, DATE '1999-12-26' + CAST(i AS INTEGER) AS day FROM range(378) t(i))
SELECT CAST(i // 7 AS INTEGER) AS col, CAST(i % 7 AS INTEGER) AS row, strftime(c.day, '%Y-%m-%d') AS date, year(c.day) = 2000 AS in_year,
  year(c.day) = 2000 AND coalesce(tokens, 0) > 0 AS active, coalesce(tokens, 0) AS tokens, round(coalesce(CAST(cost AS DOUBLE), 0), 2) AS cost FROM c LEFT JOIN f ON c.day = f.day""")
def calendar_grid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("tokens"), rollup.money_sum(F.col("o_totalprice")).alias("cost"))
    return derived.calendar_grid(o, 2000).withColumn("cost", F.round("cost", 2))


BARS_SQL = f"""parts AS (SELECT date, client, CAST(sum(tokens) AS BIGINT) AS tokens, sum(CAST(cost AS DECIMAL(28,10))) AS cost FROM e GROUP BY ALL),
bars AS (SELECT date, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(CAST(sum(cost) AS DOUBLE), 8) AS total_cost, string_agg(client || '=' || tokens, ',' ORDER BY client) AS segments FROM parts GROUP BY date)"""


def written_segments(bars: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["client"], F.lit("="), s["tokens"].cast("string"))), ",")
    return bars.withColumns({"segments": text, "total_cost": F.round("total_cost", 8)})


@query(f"{ENRICHED_SQL}, {BARS_SQL} SELECT * FROM bars")
def day_bars(spark, sf_dir):
    return written_segments(derived.day_bars(rollup.daily_client(enriched(spark, sf_dir))))


@query(f"""{ENRICHED_SQL}, {BARS_SQL}, s AS (SELECT strftime(DATE '2024-02-10' - CAST(29 - i AS INTEGER), '%Y-%m-%d') AS date FROM range(30) t(i))
SELECT s.date, coalesce(total_tokens, 0) AS total_tokens, coalesce(total_cost, 0) AS total_cost, coalesce(segments, '') AS segments FROM s LEFT JOIN bars ON s.date = bars.date""")
def trailing_30d_bars(spark, sf_dir):
    return written_segments(derived.trailing_bars(derived.day_bars(rollup.daily_client(enriched(spark, sf_dir))), "2024-02-10", 30))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT key, arg_min(ts_ms, ord) AS ts_ms, arg_min(client, ord) AS client, arg_min(agent, ord) AS agent, arg_min(model, ord) AS model,
  max(input) AS input, max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write, min(ord) AS ord FROM ev WHERE key IS NOT NULL GROUP BY key)
SELECT ts_ms, client, agent, model, input, output, cache_read, cache_write, key, ord FROM ev WHERE key IS NULL UNION ALL SELECT ts_ms, client, agent, model, input, output, cache_read, cache_write, key, ord FROM k""")
def event_max_merge(spark, sf_dir):
    return trace.merged(usage_events(spark, sf_dir))


WINDOW_SQL = f"WITH {EVENTS_SQL}, w AS (SELECT *, input + output + cache_read + cache_write AS t FROM ev WHERE ts_ms >= {NOW_MS - TRACE_S * 1000})"
TRACE_SQL = f"{WINDOW_SQL}, tr AS (SELECT client, agent, model, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS messages, CAST(sum(t) / {TRACE_S / 60} AS FLOAT) AS tokens_per_min FROM w GROUP BY ALL)"
COLLAPSE_SQL = f"""{TRACE_SQL}, b AS (SELECT *, CASE WHEN client LIKE '%-cli' THEN left(client, length(client) - 4) ELSE client END AS c FROM tr),
co AS (SELECT c AS client, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(messages) AS BIGINT) AS messages, sum(CAST(tokens_per_min AS DOUBLE)) AS tokens_per_min, string_agg(DISTINCT agent, ', ' ORDER BY agent) AS agents,
  CASE WHEN count(DISTINCT model) > 1 THEN string_agg(DISTINCT model, ', ' ORDER BY model) FILTER (model <> 'unknown') ELSE min(model) END AS models, min(row(-tokens, client, agent, model)) AS seen FROM b GROUP BY c)"""


@query(f"{TRACE_SQL} SELECT client, agent, model, tokens, messages, round(CAST(tokens_per_min AS DOUBLE), 3) AS tokens_per_min FROM tr")
def trace_window(spark, sf_dir):
    return trace.trace(usage_events(spark, sf_dir), NOW_MS, TRACE_S).withColumn("tokens_per_min", F.round(F.col("tokens_per_min").cast("double"), 3))


@query(f"{COLLAPSE_SQL} SELECT client, tokens, messages, round(tokens_per_min, 3) AS tokens_per_min, agents, models FROM co")
def trace_collapse(spark, sf_dir):
    return trace.collapse(trace.trace(usage_events(spark, sf_dir), NOW_MS, TRACE_S)).withColumn("tokens_per_min", F.round("tokens_per_min", 3)).drop("seen")


@query(f"{COLLAPSE_SQL} SELECT client, tokens, round(greatest(4.0::DOUBLE, tokens::DOUBLE / (SELECT max(tokens) FROM co) * 100), 8) AS bar_percent, (SELECT CAST(sum(tokens) AS BIGINT) FROM co) AS all_tokens FROM co ORDER BY tokens DESC, seen LIMIT 5")
def top5_trace(spark, sf_dir):
    rows = trace.collapse(trace.trace(usage_events(spark, sf_dir), NOW_MS, TRACE_S))
    return trace.top(rows).select("client", "tokens", F.round("bar_percent", 8).alias("bar_percent"), "all_tokens")


@query(f"{WINDOW_SQL} SELECT round(CAST(CAST(coalesce(sum(t), 0) / {TRACE_S / 60} AS FLOAT) AS DOUBLE), 2) AS tokens_per_min, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens FROM w")
def rate_in_window(spark, sf_dir):
    e = usage_events(spark, sf_dir)
    return trace.rate(e, NOW_MS, TRACE_S).select(F.round(F.col("tokens_per_min").cast("double"), 2).alias("tokens_per_min")).crossJoin(trace.window_tokens(e, NOW_MS, TRACE_S))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT client, agent, model, ts_ms // 5000 AS pane, input + output + cache_read + cache_write AS t FROM ev), m AS (SELECT DISTINCT client, agent, model, unnest([pane, pane + 120]) AS pane FROM e)
SELECT client, agent, model, m.pane, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens, count(t) AS messages FROM m LEFT JOIN e USING (client, agent, model) WHERE e.pane <= m.pane AND e.pane > m.pane - 120 OR e.pane IS NULL GROUP BY ALL
UNION ALL SELECT client, agent, model, m.pane, CAST(0 AS BIGINT), 0 FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.client = m.client AND e.agent = m.agent AND e.model = m.model AND e.pane <= m.pane AND e.pane > m.pane - 120)""")
def sliding_rates(spark, sf_dir):
    """Every ten-minute window that ends with a pane at which its sum may change."""
    return trace.sliding(trace.panes(usage_events(spark, sf_dir)), 600).drop("tokens_per_min")


#: The registry written out by hand, as the oracle has it: id, place, name, colour.
REGISTRY_SQL = """known AS (SELECT * FROM (VALUES ('claude', 0, 'Claude', '#d97706'), ('codex', 1, 'Codex', '#9ca3af'), ('cursor', 2, 'Cursor', '#0ea5e9'), ('opencode', 3, 'OpenCode', '#1f2937'), ('gemini', 4, 'Gemini', '#60a5fa'),
  ('copilot', 5, 'Copilot', '#1f2937'), ('amp', 6, 'Amp', '#10b981'), ('droid', 7, 'Droid', '#22c55e'), ('hermes', 8, 'Hermes', '#a78bfa'), ('grok', 9, 'Grok', '#111827'), ('omp', 10, 'Omp', '#6b7280')) v(id, place, name, color))"""


@query(f"""{TRACE_SQL}, {REGISTRY_SQL}, r AS (SELECT CASE client WHEN 'claude-code' THEN 'claude' ELSE regexp_replace(client, '-cli$', '') END || CASE WHEN agent LIKE '%1' THEN ' lab' ELSE '' END AS registry_id, agent, model, tokens FROM tr)
SELECT registry_id, agent, model, tokens, place, coalesce(name, upper(registry_id[1]) || substr(registry_id, 2, length(registry_id) - 5) || ' Lab') AS name, coalesce(color, '#6b7280') AS color FROM r LEFT JOIN known ON id = registry_id""")
def styled_trace(spark, sf_dir):
    """Trace rows joined with the registry; agents that end with 1 are of clients that it lacks."""
    rows = trace.trace(usage_events(spark, sf_dir), NOW_MS, TRACE_S)
    renamed = rows.withColumn("client", F.when(F.col("agent").endswith("1"), F.concat(models.live_client(F.col("client")), F.lit(" lab"))).otherwise(F.col("client")))
    return trace.styled(renamed).select("registry_id", "agent", "model", "tokens", "place", "name", "color")


@query(f"{COLLAPSE_SQL} SELECT DISTINCT client FROM co WHERE tokens_per_min > 0")
def live_clients(spark, sf_dir):
    return trace.live_clients(trace.trace(usage_events(spark, sf_dir), NOW_MS, TRACE_S))


@query(f"""WITH {MESSAGES_SQL}, h AS (SELECT user_id, ord, k, max(k) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM u)
SELECT user_id, ord, k, k - mark AS delta FROM h WHERE k > mark""")
def high_water_deltas(spark, sf_dir):
    return trace.high_water_deltas(usage_messages(spark, sf_dir).select("user_id", "ord", "k"), ["user_id"], ["ord"], "k")


@query(f"""WITH {MESSAGES_SQL}, h AS (SELECT user_id, max(input) FILTER (ord % 2 = 0) AS a, max(input) FILTER (ord % 2 = 1) AS b, max(output) FILTER (ord % 2 = 0) AS c, max(output) FILTER (ord % 2 = 1) AS d FROM u GROUP BY user_id)
SELECT user_id AS session_id, greatest(b - coalesce(a, 0), 0) AS input, greatest(d - coalesce(c, 0), 0) AS output, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write FROM h
WHERE b IS NOT NULL AND greatest(b - coalesce(a, 0), 0) + greatest(d - coalesce(c, 0), 0) > 0""")
def snapshot_diff(spark, sf_dir):
    u = usage_messages(spark, sf_dir)
    zero = F.lit(0).cast("long")
    side = lambda odd: u.filter(F.col("ord") % 2 == odd).groupBy(F.col("user_id").alias("session_id")).agg(F.max("input").alias("input"), F.max("output").alias("output")).withColumns({"cache_read": zero, "cache_write": zero})
    return trace.snapshot_diff(side(0), side(1))


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT user_id AS file, dedup_key, min(ord) AS ord, arg_min(model_id, ord) AS model_id, max(input) AS input, max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write FROM u WHERE ord % 6 > 0 AND dedup_key IS NOT NULL GROUP BY ALL)
SELECT user_id AS file, NULL AS dedup_key, ord, model_id, input, output, cache_read, cache_write FROM u WHERE ord % 6 = 0 OR dedup_key IS NULL UNION ALL SELECT file, dedup_key, ord, model_id, input, output, cache_read, cache_write FROM k""")
def in_file_max_merge(spark, sf_dir):
    rows = usage_messages(spark, sf_dir).select(F.col("user_id").alias("file"), F.when(F.col("ord") % 6 > 0, F.col("dedup_key")).alias("dedup_key"), "ord", "model_id", *stateful.FOUR)
    return stateful.max_merge(rows)


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT user_id AS file, dedup_key, min(ord) AS ord, arg_max(model_id, ord) AS model_id, arg_max(input, ord) AS input FROM u WHERE ord % 6 > 0 AND dedup_key IS NOT NULL GROUP BY ALL)
SELECT user_id AS file, NULL AS dedup_key, ord, model_id, input FROM u WHERE ord % 6 = 0 OR dedup_key IS NULL UNION ALL SELECT file, dedup_key, ord, model_id, input FROM k""")
def in_file_replace(spark, sf_dir):
    rows = usage_messages(spark, sf_dir).select(F.col("user_id").alias("file"), F.when(F.col("ord") % 6 > 0, F.col("dedup_key")).alias("dedup_key"), "ord", "model_id", "input")
    return stateful.replace_in_place(rows)


#: Counter logs made of messages: forked files, totals that restart or come late or not at all, and models named by turns.
FOLD_SQL = f"""WITH RECURSIVE {MESSAGES_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS rn FROM u),
p AS (SELECT *, CASE WHEN rn = 1 AND user_id % 4 = 0 THEN 'meta' WHEN ord % 7 = 0 THEN 'turn' ELSE 'count' END AS kind,
  CAST(sum(k) OVER w AS BIGINT) AS a, CAST(sum(k % 5) OVER w AS BIGINT) AS b, CAST(sum(k % 3) OVER w AS BIGINT) AS c FROM n WINDOW w AS (PARTITION BY user_id, rn // 13 ORDER BY ord)),
r AS (SELECT user_id, rn, ord, timestamp_ms, kind, CASE WHEN kind = 'turn' OR ord % 4 = 1 THEN model_id WHEN ord % 8 = 0 THEN 'unknown' END AS named,
  CASE WHEN kind = 'count' AND ord % 5 > 0 THEN [greatest(a - CASE WHEN ord % 11 = 0 THEN 3 ELSE 0 END, 0), b, c] END AS total, CASE WHEN kind = 'count' AND ord % 3 > 0 THEN [k, k % 5, k % 3] END AS last,
  CASE WHEN user_id % 8 = 0 THEN a // 50 END AS reported FROM p),
s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::VARCHAR AS model, 'openai' AS provider, NULL::BIGINT[] AS before, false AS replaying, NULL::BIGINT[] AS parent, NULL::BIGINT AS parent_reported,
    NULL::BIGINT AS ord, NULL::BIGINT AS timestamp_ms, NULL::VARCHAR AS shown, NULL::BIGINT[] AS made FROM r
  UNION ALL
  SELECT user_id, rn, model, provider, CASE WHEN takes THEN total WHEN emits THEN after ELSE before END, replaying,
    CASE WHEN opens OR counts THEN NULL WHEN replays THEN total ELSE parent END, CASE WHEN opens OR counts THEN NULL WHEN replays THEN reported ELSE parent_reported END,
    ord, timestamp_ms, coalesce(named, model, 'unknown'), CASE WHEN emits THEN grown END
  FROM (SELECT *, coalesce(counts AND NOT repeats AND grown[1] + grown[2] > 0, false) AS emits,
      replays OR repeats OR (counts AND total IS NOT NULL AND last IS NULL AND before IS NOT NULL AND total <> before AND less) AS takes
    FROM (SELECT *,
        CASE WHEN total IS NOT NULL AND before IS NOT NULL AND (total = before OR (last IS NOT NULL AND less AND late)) THEN NULL
          WHEN last IS NOT NULL THEN last WHEN total IS NOT NULL AND before IS NULL THEN total
          WHEN total IS NOT NULL AND NOT less THEN [total[1] - before[1], total[2] - before[2], total[3] - before[3]] END AS grown,
        CASE WHEN total IS NOT NULL THEN total WHEN before IS NOT NULL THEN [before[1] + last[1], before[2] + last[2], before[3] + last[3]] END AS after
      FROM (SELECT r.user_id, r.rn, r.ord, r.timestamp_ms, r.named, r.total, r.last, r.reported, s.before, s.parent, s.parent_reported,
          r.kind = 'meta' AS opens, r.kind = 'meta' OR (r.kind <> 'turn' AND s.replaying) AS replaying, r.kind = 'count' AND NOT s.replaying AS counts, r.kind = 'count' AND s.replaying AND r.total IS NOT NULL AS replays,
          CASE WHEN r.kind = 'meta' THEN 'acme' ELSE s.provider END AS provider,
          CASE WHEN r.kind = 'turn' OR (r.kind = 'count' AND NOT s.replaying AND r.named <> 'unknown') THEN r.named ELSE s.model END AS model,
          coalesce(r.kind = 'count' AND NOT s.replaying AND r.total IS NOT NULL AND (coalesce(r.total = s.parent, false) OR coalesce(r.reported = s.parent_reported, false)), false) AS repeats,
          coalesce(r.total[1] < s.before[1] OR r.total[2] < s.before[2] OR r.total[3] < s.before[3], false) AS less,
          coalesce(list_sum(r.total) > 0 AND list_sum(r.last) > 0 AND list_sum(s.before) > 0 AND (list_sum(r.total) * 100 >= list_sum(s.before) * 98 OR list_sum(r.total) + 2 * list_sum(r.last) >= list_sum(s.before)), false) AS late
        FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1))))"""


@query(f"""{FOLD_SQL} SELECT CAST(user_id AS VARCHAR) AS file, ord, shown AS model, provider, made[1] - least(made[3], made[1]) AS input, made[2] AS output, least(made[3], made[1]) AS cache_read, 0::BIGINT AS reasoning, timestamp_ms FROM s WHERE made IS NOT NULL""")
def counter_fold(spark, sf_dir):
    file = Window.partitionBy("user_id").orderBy("ord")
    u = usage_messages(spark, sf_dir).withColumn("rn", F.row_number().over(file))
    running = Window.partitionBy("user_id", F.floor(F.col("rn") / 13)).orderBy("ord")
    k, n, none = F.col("k"), F.col("ord"), F.lit(0).cast("long")
    kind = F.when((F.col("rn") == 1) & (F.col("user_id") % 4 == 0), "meta").when(n % 7 == 0, "turn").otherwise("count")
    u = u.withColumns({"type": kind, "a": F.sum(k).over(running), "b": F.sum(k % 5).over(running), "c": F.sum(k % 3).over(running)})
    counts = F.col("type") == "count"
    fields = lambda *parts: F.struct(*[p.cast("long").alias(name) for p, name in zip((*parts, none), stateful.COUNTERS)])
    total = fields(F.greatest(F.col("a") - F.when(n % 11 == 0, 3).otherwise(0), F.lit(0)), F.col("b"), F.col("c"))
    named = F.when((F.col("type") == "turn") | (n % 4 == 1), F.col("model_id")).when(n % 8 == 0, "unknown")
    return stateful.counter_deltas(u.select(
        F.col("user_id").cast("string").alias("file"), "ord", "type", named.alias("model"), F.when(F.col("type") == "meta", "acme").alias("provider"), (F.col("type") == "meta").alias("forked"), "timestamp_ms",
        F.when(counts & (n % 5 > 0), total).alias("total"), F.when(counts & (n % 3 > 0), fields(k, k % 5, k % 3)).alias("last"),
        F.when(F.col("user_id") % 8 == 0, F.call_function("div", F.col("a"), F.lit(50))).alias("reported"),
    ))


@query(f"""WITH RECURSIVE {MESSAGES_SQL},
r AS (SELECT user_id, ord, event_type = 'purchase' AS opens, CASE WHEN ord % 7 = 0 THEN NULL ELSE sum(k) OVER (PARTITION BY user_id ORDER BY ord) - CASE WHEN ord % 5 = 0 THEN 100 ELSE 0 END END AS total,
  CASE WHEN ord % 4 = 0 THEN model_id END AS model, timestamp_ms, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS rn FROM u),
s AS (
  SELECT user_id, 0::BIGINT AS rn, 'grok-unknown' AS now, NULL::HUGEINT AS mark, 0 AS closed, false AS open, NULL::VARCHAR AS turn_model, 0::HUGEINT AS base, NULL::HUGEINT AS most, NULL::BIGINT AS hit, NULL::BIGINT AS first, NULL::BIGINT AS seen_at, NULL::BIGINT AS start,
    NULL::VARCHAR AS out_model, NULL::HUGEINT AS out_delta, NULL::BIGINT AS out_at, NULL::BIGINT AS out_ord, 0 AS out_turn FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL
  SELECT user_id, rn, now, mark, closed, open, turn_model, base, most, hit, first, seen_at, start, out_model, out_delta, out_at, out_ord, out_turn FROM (
    SELECT n.user_id, n.rn, n.now, CASE WHEN n.counts THEN n.total ELSE n.mark END AS mark, n.closed2 AS closed,
      (n.open2 OR n.grows) AS open, CASE WHEN n.open2 THEN n.tm2 WHEN n.grows THEN n.now END AS turn_model, CASE WHEN n.open2 THEN n.base2 ELSE coalesce(n.mark, 0) END AS base,
      CASE WHEN n.grows OR (n.seeds AND n.open2) THEN n.total WHEN n.open2 THEN n.most2 END AS most,
      CASE WHEN n.grows OR (n.seeds AND n.open2) THEN n.timestamp_ms WHEN n.open2 THEN n.at2 END AS hit, CASE WHEN n.open2 THEN n.first2 WHEN n.grows THEN n.ord END AS first,
      CASE WHEN n.counts THEN n.timestamp_ms ELSE n.seen_at END AS seen_at, coalesce(n.start, n.ord) AS start,
      CASE WHEN n.shuts THEN n.tm1 END AS out_model, CASE WHEN n.shuts THEN n.pmost - n.pbase END AS out_delta, CASE WHEN n.shuts THEN n.pat END AS out_at, CASE WHEN n.shuts THEN n.pfirst END AS out_ord, n.closed AS out_turn
    FROM (SELECT m.*, m.opens AND m.popen AS shuts, m.closed + CASE WHEN m.opens AND m.popen THEN 1 ELSE 0 END AS closed2, m.opens OR m.popen AS open2,
        CASE WHEN m.opens THEN m.now ELSE m.tm1 END AS tm2, CASE WHEN m.opens THEN coalesce(m.mark, 0) ELSE m.pbase END AS base2, CASE WHEN NOT m.opens THEN m.pmost END AS most2,
        CASE WHEN NOT m.opens THEN m.pat END AS at2, CASE WHEN m.opens THEN m.ord ELSE m.pfirst END AS first2
      FROM (SELECT r.user_id, r.rn, r.ord, r.opens, r.total, r.timestamp_ms, coalesce(r.model, s.now) AS now, s.mark, s.closed, s.open AS popen, s.base AS pbase, s.most AS pmost, s.hit AS pat, s.first AS pfirst, s.seen_at, s.start,
          CASE WHEN s.turn_model = 'grok-unknown' AND r.model IS NOT NULL THEN r.model ELSE s.turn_model END AS tm1,
          coalesce(r.total >= 0 AND r.total >= coalesce(s.mark, 0), false) AS counts, coalesce(r.total > s.mark, false) AS grows, coalesce(s.mark IS NULL AND r.total >= 0, false) AS seeds
        FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1) m) n) x),
last AS (SELECT user_id, max(rn) AS rn FROM s GROUP BY user_id),
outs AS (SELECT user_id, out_turn AS k, out_model AS model, out_delta AS delta, out_at AS timestamp_ms, out_ord AS ord FROM s WHERE out_ord IS NOT NULL
  UNION ALL SELECT user_id, closed, turn_model, most - base, hit, first FROM s JOIN last USING (user_id, rn) WHERE open),
kept AS (SELECT * FROM outs WHERE delta > 0)
SELECT user_id, CAST(k AS INTEGER) AS turn, model, CAST(delta AS BIGINT) AS delta, timestamp_ms, ord FROM kept
UNION ALL SELECT user_id, 0, now, CAST(mark AS BIGINT), seen_at, start FROM s JOIN last USING (user_id, rn) WHERE mark > 0 AND user_id NOT IN (SELECT user_id FROM kept)""")
def turn_segments(spark, sf_dir):
    rows = usage_messages(spark, sf_dir).select(
        "user_id", "ord", (F.col("event_type") == "purchase").alias("opens"), F.when(F.col("ord") % 7 > 0, F.sum("k").over(Window.partitionBy("user_id").orderBy("ord")) - F.when(F.col("ord") % 5 == 0, 100).otherwise(0)).alias("total"),
        F.when(F.col("ord") % 4 == 0, F.col("model_id")).alias("model"), "timestamp_ms", F.lit("grok-unknown").alias("fallback_model"),
    )
    return stateful.turn_segments(rows, ["user_id"])


@query(f"""WITH {MESSAGES_SQL} SELECT user_id, ord, last_value(CASE WHEN ord % 4 = 0 THEN model_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM u""")
def forward_fill(spark, sf_dir):
    u = usage_messages(spark, sf_dir)
    return u.select("user_id", "ord", stateful.forward_fill(F.when(F.col("ord") % 4 == 0, F.col("model_id")), ["user_id"], ["ord"]).alias("model"))


NAMES_SQL = "p_partkey, p_name || '[' || p_brand || ']_' || p_type AS name"


@query(f"""WITH p AS (SELECT {NAMES_SQL}, CASE p_partkey % 3 WHEN 0 THEN '-20250514' WHEN 1 THEN '-2025' ELSE '' END AS tail FROM part)
SELECT p_partkey, lower(trim(name)) AS model, CASE WHEN length(name || tail) > 9 THEN regexp_replace(lower(name || tail), '-[0-9]{{8}}$', '') ELSE lower(name || tail) END AS live_model,
  trim(regexp_replace(translate(lower(regexp_replace(name, '\\[[^\\]]*(\\]|$)', '', 'g')), '._ ', '---'), '-{{2,}}', '-', 'g'), '-') AS settings_model FROM p""")
def model_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("["), "p_brand", F.lit("]_"), "p_type").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "-20250514").when(F.col("p_partkey") % 3 == 1, "-2025").otherwise("").alias("tail"))
    return p.select("p_partkey", models.normalize_model(F.col("name")).alias("model"), models.normalize_live_model(F.concat("name", "tail")).alias("live_model"), models.normalize_settings_model(F.col("name")).alias("settings_model"))


@query(f"{ENRICHED_SQL} SELECT model_id, provider_id, count(*) AS n FROM e GROUP BY ALL")
def provider_infer(spark, sf_dir):
    return enriched(spark, sf_dir).groupBy("model_id", "provider_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT event_id, (event_id % 10000 * 7919 + 1) * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000003 WHEN 2 THEN 1000000007 WHEN 3 THEN 100000000003 ELSE -20000003 END AS raw FROM events)
SELECT event_id, raw, CASE WHEN abs(raw) >= 100000000000000000 THEN raw // 1000000 WHEN abs(raw) >= 100000000000000 THEN raw // 1000 WHEN abs(raw) >= 100000000000 THEN raw ELSE raw * 1000 END AS ms FROM x""")
def epoch_normalize(spark, sf_dir):
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1000003, 1000000007, 100000000003, -20000003)]), (F.col("event_id") % 5 + 1).cast("int"))
    x = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 10000 * 7919 + 1) * factor).alias("raw"))
    return x.select("event_id", "raw", times.normalize_epoch_ms(F.col("raw")).alias("ms"))


def humanize_sql(n: str) -> str:
    out = ""
    for unit, name in fmt.UNITS:
        q = f"({n}::DOUBLE / {unit}.0::DOUBLE)"
        scaled = f"(CAST(floor({q}) AS HUGEINT) * 4503599627370496 + CAST(({q} - floor({q})) * 4503599627370496 AS HUGEINT))"
        up = f"CASE WHEN {n} % {unit // 10} * 2 = {unit // 10} THEN {scaled} * {unit} >= {n}::HUGEINT * 4503599627370496 ELSE {n} % {unit // 10} * 2 > {unit // 10} END"
        t = f"({n} // {unit // 10} + CASE WHEN {up} THEN 1 ELSE 0 END)"
        out += f" WHEN {n} >= {unit} THEN ({t} // 10) || '.' || ({t} % 10) || '{name}'"
    return f"CASE{out} ELSE CAST({n} AS VARCHAR) END"


@query(f"WITH x AS (SELECT event_id, event_id * 50 * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END AS n FROM events) SELECT event_id, {humanize_sql('n')} AS shown FROM x")
def humanize(spark, sf_dir):
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1000, 1000000, 1000000000)]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", fmt.humanize_tokens(F.col("event_id") * 50 * factor).alias("shown"))


@query("SELECT o_orderkey, '$' || format('{:,.2f}', round(CAST(o_totalprice AS DECIMAL(28,10)), 2)::DOUBLE) AS shown FROM orders")
def format_cost(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", fmt.format_cost(F.col("o_totalprice")).alias("shown"))


@query("SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def assistant_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def session_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "o_custkey", "c_name")


@query(f"{ENRICHED_SQL} SELECT client FROM (SELECT DISTINCT client FROM e UNION SELECT lower(r_name) FROM region)")
def tab_union(spark, sf_dir):
    return derived.tabs(enriched(spark, sf_dir), table(spark, sf_dir, "region").select(F.lower("r_name").alias("client")))


PAYLOAD = (
    "meta struct<generatedAt:string,dateRange:struct<start:string,end:string>>, summary struct<totalTokens:bigint,totalDays:int,activeDays:int,clients:array<string>,models:array<string>,totalCost:double,maxCostInSingleDay:double>, "
    "years array<struct<year:string,totalTokens:bigint,totalCost:double,range:struct<start:string,end:string>>>, contributions array<struct<date:string,totals:struct<tokens:bigint,cost:double,messages:bigint>,intensity:int,"
    "tokenBreakdown:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,reasoning:bigint>,clients:array<struct<client:string,modelId:string,providerId:string,cost:double,messages:bigint,tokens:struct<input:bigint>>>>>"
)


@query(f"""{ENRICHED_SQL}, g AS (SELECT date, client, provider_id, model_id, CAST(sum(input) AS BIGINT) AS i, sum(CAST(cost AS DECIMAL(28,10))) AS c, sum(messages) AS n FROM e GROUP BY ALL),
days AS (SELECT date, {TOTALS}, sum(CAST(cost AS DECIMAL(28,10))) AS exact FROM e GROUP BY date),
cl AS (SELECT date, string_agg(client || '/' || provider_id || '/' || model_id || '/' || i || '/' || n, ',' ORDER BY client, provider_id, model_id) AS clients, CAST(count(*) AS INTEGER) AS n_clients FROM g GROUP BY date),
y AS (SELECT substr(date, 1, 4) AS year, sum(tokens) AS t, min(date) AS a, max(date) AS z FROM e GROUP BY 1),
s AS (SELECT CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(count(*) AS INTEGER) AS total_days, CAST(count(*) FILTER (tokens > 0) AS INTEGER) AS active_days, round(CAST(sum(exact) AS DOUBLE), 8) AS total_cost,
  round(CAST(max(exact) AS DOUBLE), 8) AS max_cost, min(date) AS start, max(date) AS "end" FROM days)
SELECT '2024-03-01T00:00:00.000Z' AS generated_at, start, "end", total_tokens, total_days, active_days, total_cost, max_cost, (SELECT string_agg(DISTINCT client, ',' ORDER BY client) FROM e) AS all_clients,
  (SELECT string_agg(DISTINCT model_id, ',' ORDER BY model_id) FROM e) AS all_models, (SELECT string_agg(year || '=' || t || '=' || a || '=' || z, ',' ORDER BY year) FROM y) AS years,
  date, tokens, cost, messages, CASE WHEN exact / (SELECT max(exact) FROM days) >= 0.75 THEN 4 WHEN exact / (SELECT max(exact) FROM days) >= 0.5 THEN 3 WHEN exact / (SELECT max(exact) FROM days) >= 0.25 THEN 2 WHEN exact > 0 THEN 1 ELSE 0 END AS intensity,
  input, output, cache_read, cache_write, reasoning, clients, n_clients FROM s, days JOIN cl USING (date)""")
def payload_json(spark, sf_dir):
    """The document, read back: one row a day with what stands above the days."""
    doc = rollup.payload(enriched(spark, sf_dir), "2024-03-01T00:00:00.000Z").select(F.from_json("payload", PAYLOAD).alias("p")).select("p.*", F.posexplode("p.contributions").alias("place", "d"))
    text = lambda *parts: F.concat_ws("/", *[p.cast("string") for p in parts])
    clients = F.transform("d.clients", lambda c: text(c["client"], c["providerId"], c["modelId"], c["tokens"]["input"], c["messages"]))
    years = F.transform("years", lambda y: F.concat_ws("=", y["year"], y["totalTokens"].cast("string"), y["range"]["start"], y["range"]["end"]))
    b = "d.tokenBreakdown."
    return doc.select(
        F.col("meta.generatedAt").alias("generated_at"), "meta.dateRange.start", "meta.dateRange.end", F.col("summary.totalTokens").alias("total_tokens"), F.col("summary.totalDays").alias("total_days"),
        F.col("summary.activeDays").alias("active_days"), F.round("summary.totalCost", 8).alias("total_cost"), F.round("summary.maxCostInSingleDay", 8).alias("max_cost"), F.array_join("summary.clients", ",").alias("all_clients"),
        F.array_join("summary.models", ",").alias("all_models"), F.array_join(years, ",").alias("years"), "d.date", "d.totals.tokens", F.round("d.totals.cost", 8).alias("cost"), "d.totals.messages", "d.intensity",
        F.col(b + "input").alias("input"), F.col(b + "output").alias("output"), F.col(b + "cacheRead").alias("cache_read"), F.col(b + "cacheWrite").alias("cache_write"), F.col(b + "reasoning").alias("reasoning"),
        F.array_join(clients, ",").alias("clients"), F.size("d.clients").alias("n_clients"),
    )
