"""Sources under the oracle: the events table written as a client's logs, read by that client's source."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Callable
from contextlib import closing, suppress
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import increments, trace
from ..session import fresh_path, scratch
from ..sources import cache, ingest, listing, logs
from ..streaming import live, publish, tail
from .adapters import EXPECTED_SQL, MESSAGES_SQL, usage_messages
from .registry import SQL, query

#: What every client's query returns.
SHOWN = ("model_id", "provider_id", "timestamp_ms", "date", "input", "output", "cache_read", "cache_write", "reasoning", "dedup_key")


def iso() -> Column:
    return F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def written(rows: DataFrame, value: Column, by: str | None = None, name: str | Callable[[str], str] = "{}.jsonl", path: str | None = None) -> str:
    """A shared folder, a fresh one unless given, of files with a line a row, in the order of ``ord``; with ``by`` a file, of that name, for each of its values.

    Tasks write the files under their names: the driver touches none. Run again, a task writes the same files.
    """
    named = name if callable(name) else name.format
    spark = rows.sparkSession
    path = path or fresh_path(spark, "logs")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # there without rows, too
    kept = [F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("by")] if by else []
    lines = rows.select("user_id", "ord", value.alias("value"), *kept).repartition("user_id").sortWithinPartitions("user_id", "ord")

    def write(batches):
        from pyspark import TaskContext

        store, root = tail.file_system(path)
        made, n, at, out = set(), 0, None, None
        try:
            for b in batches:
                values = b.column("value")
                names = b.column("by") if by else pa.repeat(pa.scalar(f"part-{TaskContext.get().partitionId():05d}"), len(b))
                runs = pc.run_end_encode(names)
                start = 0
                for of, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if of != at:
                        if out:
                            out.close()
                        target = f"{root}/{named(of)}"
                        folder = target.rpartition("/")[0]
                        if folder not in made:
                            store.create_dir(folder)
                            made.add(folder)
                        out, at, n = store.open_output_stream(target), of, n + 1
                    out.write("".join(f"{v or ''}\n" for v in values[start:end].to_pylist()).encode())
                    start = end
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    lines.drop("user_id", "ord").mapInArrow(write, "n long").agg(F.sum("n")).collect()  # makes the files
    return path


def databases(rows: DataFrame, create: str, path: str, name: str, *more: str, parts: int = 4) -> None:
    """Rows as tables of SQLite files in shared storage, one a partition: run again, a task writes the same file. ``more``: statements after them."""
    into = f"INSERT INTO {create.split()[2]} VALUES ({', '.join('?' * len(rows.columns))})"

    def write(batches):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        with tempfile.TemporaryDirectory() as folder:
            with closing(sqlite3.connect(f"{folder}/made.db")) as db:
                db.execute(create)
                for b in batches:
                    db.executemany(into, zip(*b.to_pydict().values()))
                for statement in more:
                    db.execute(statement)
                db.commit()
            store, root = tail.file_system(path)
            target = f"{root}/{name.format(k)}"
            store.create_dir(target.rpartition("/")[0])
            with store.open_output_stream(target) as out, Path(f"{folder}/made.db").open("rb") as source:
                while piece := source.read(8 << 20):
                    out.write(piece)
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32())})

    rows.repartition(parts, F.col(rows.columns[0])).mapInArrow(write, "k int").collect()  # a number a file


def read(spark: SparkSession, client: str, *paths: str, more: tuple[str, ...] = ()) -> DataFrame:
    return logs.SOURCES[client](spark, logs.Config(home=paths[0], roots={client: list(paths)})).select(*SHOWN, *more)


def json_line(**fields) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


KEYED = "user_id || ':' || event_type || ':' || date"
SOURCE_SQL = f"WITH {MESSAGES_SQL}, k AS (SELECT *, {KEYED} AS id FROM u)"
ZERO = "CAST(0 AS BIGINT)"


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_messages(spark, sf_dir)
    return rows.withColumn("id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type", "date"))


@query(f"""{SOURCE_SQL}, c AS (SELECT *, 'claude:' || id || ':r' || (ord % 2) AS key FROM k WHERE ord % 10 > 0 AND ord % 17 > 0 AND input + output + cache_read + cache_write > 0)
SELECT arg_min(model_id, ord) AS model_id, 'anthropic' AS provider_id, arg_min(timestamp_ms, ord) AS timestamp_ms, arg_min(date, ord) AS date, max(input) AS input, max(output) AS output, max(cache_read) AS cache_read,
  max(cache_write) AS cache_write, {ZERO} AS reasoning, key AS dedup_key FROM c GROUP BY key""")
def claude_logs(spark, sf_dir):
    """Among prompts and broken lines; of one message's lines the first one with each field's maximum."""
    use = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"))
    line = json_line(
        type=F.when(F.col("ord") % 10 == 0, "user").otherwise("assistant"), timestamp=iso(), requestId=F.concat(F.lit("r"), (F.col("ord") % 2).cast("string")),
        message=F.struct("id", F.col("model_id").alias("model"), use.alias("usage")),
    )
    rows = logged(spark, sf_dir)
    return read(spark, "claude", written(rows, F.when(F.col("ord") % 17 == 0, F.substring(line, 1, 40)).otherwise(line)))


@query(f"""{SOURCE_SQL}, c AS (SELECT *, coalesce(last_value(CASE WHEN ord % 7 = 0 THEN model_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS m, least(k.k % 3, k.k) AS cached FROM k)
SELECT m AS model_id, 'openai' AS provider_id, timestamp_ms, date, k - cached AS input, k % 5 AS output, cached AS cache_read, {ZERO} AS cache_write, {ZERO} AS reasoning,
  'codex:' || timestamp_ms || ':' || m || ':' || (k - cached) || ':' || (k % 5) || ':' || cached AS dedup_key FROM c WHERE ord % 7 > 0 AND k > 0""")
def codex_logs(spark, sf_dir):
    """A session file a user: turns that name the model, and cumulative counters, a third of them without their last step."""
    rows = logged(spark, sf_dir).withColumn("n", F.when(F.col("ord") % 7 > 0, F.col("k")).otherwise(0))
    running = Window.partitionBy("user_id").orderBy("ord")
    parts = {"input_tokens": F.col("n"), "output_tokens": F.col("n") % 5, "cached_input_tokens": F.col("n") % 3}
    total, last = F.struct(*[F.sum(c).over(running).alias(p) for p, c in parts.items()]), F.struct(*[c.alias(p) for p, c in parts.items()])
    info = F.struct(total.alias("total_token_usage"), F.when(F.col("ord") % 3 > 0, last).alias("last_token_usage"))
    turn = json_line(type=F.lit("turn_context"), timestamp=iso(), payload=F.struct(F.col("model_id").alias("model")))
    count = json_line(type=F.lit("event_msg"), timestamp=iso(), payload=F.struct(F.lit("token_count").alias("type"), info.alias("info")))
    rows = rows.withColumn("line", F.when(F.col("ord") % 7 == 0, turn).otherwise(count))
    path = written(rows, F.col("line"), by="user_id")
    return logs.SOURCES["codex"](spark, logs.Config(home=path, roots={"codex": [moved(spark, path)]})).select(*SHOWN)


def without(users: DataFrame, path: str, name: Callable[[str], str]) -> None:
    """Deletes the files, of that name, of the users' logs: in tasks, as ``written`` makes them."""

    def delete(batches):
        store, root = tail.file_system(path)
        n = 0
        for b in batches:
            for user in b.column("user_id").to_pylist():
                n += 1
                with suppress(FileNotFoundError):
                    store.delete_file(f"{root}/{name(user)}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    users.select(F.col("user_id").cast("string")).distinct().mapInArrow(delete, "n long").agg(F.sum("n")).collect()


def moved(spark: SparkSession, path: str, to: str = "sessions") -> str:
    """The folder as the sessions of a home."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    home = scratch(f"{path}-home")
    store.mkdirs(hadoop(f"{home}/{to}").getParent())
    store.rename(hadoop(path), hadoop(f"{home}/{to}"))
    return home


@query(f"""{SOURCE_SQL} SELECT arg_max(model_id, ord) AS model_id, 'google' AS provider_id, arg_max(timestamp_ms, ord) AS timestamp_ms, arg_max(date, ord) AS date, arg_max(input, ord) AS input, arg_max(output, ord) AS output,
  arg_max(cache_read, ord) AS cache_read, {ZERO} AS cache_write, arg_max(reasoning, ord) AS reasoning, 'gemini:' || id AS dedup_key FROM k GROUP BY id""")
def gemini_logs(spark, sf_dir):
    """A message's later lines replace it."""
    tokens = F.struct("input", "output", F.col("cache_read").alias("cached"), F.col("reasoning").alias("thoughts"))
    line = json_line(type=F.lit("gemini"), id=F.col("id"), timestamp=iso(), model=F.col("model_id"), tokens=tokens)
    return read(spark, "gemini", written(logged(spark, sf_dir), line))


@query(f"""{SOURCE_SQL} SELECT model_id, 'google' AS provider_id, input, output, cache_read, {ZERO} AS cache_write, reasoning, CAST(NULL AS VARCHAR) AS dedup_key FROM k WHERE input + output + cache_read + reasoning > 0""")
def gemini_stats_logs(spark, sf_dir):
    """Lines of statistics, a third of them under a result, half of them by model."""
    tokens = F.struct((F.col("input") + F.col("cache_read")).alias("prompt"), F.col("output").alias("candidates"), F.col("cache_read").alias("cached"), F.col("reasoning").alias("thoughts"))
    by_model = F.to_json(F.struct(F.create_map("model_id", F.struct(tokens.alias("tokens"))).alias("models")))
    stats = F.when(F.col("ord") % 2 == 0, by_model).otherwise(F.to_json(tokens))
    line = F.concat(F.lit('{"model": '), F.to_json(F.array("model_id")).substr(F.lit(2), F.length(F.to_json(F.array("model_id"))) - 2), F.when(F.col("ord") % 3 == 0, F.concat(F.lit(', "result": {"stats": '), stats, F.lit("}}"))).otherwise(F.concat(F.lit(', "stats": '), stats, F.lit("}"))))
    return read(spark, "gemini", written(logged(spark, sf_dir), line)).drop("timestamp_ms", "date")


@query(f"""{SOURCE_SQL}, x(model_id, provider) AS (SELECT col0, CASE WHEN col0 LIKE 'mystery%' THEN 'unknown' ELSE col1 END FROM (VALUES {EXPECTED_SQL}))
SELECT model_id, provider AS provider_id, timestamp_ms, date, input - least(cache_read, input) AS input, output, cache_read, cache_write, reasoning, 'copilot:t' || user_id || ':s' || ord AS dedup_key
FROM k JOIN x USING (model_id) WHERE input - least(cache_read, input) + output + cache_read + cache_write + reasoning > 0""")
def copilot_logs(spark, sf_dir):
    """Spans whose times are [seconds, nanoseconds]; cached tokens are part of the input."""
    names = {"gen_ai.usage.input_tokens": "input", "gen_ai.usage.output_tokens": "output", "gen_ai.usage.cache_read.input_tokens": "cache_read", "gen_ai.usage.cache_creation.input_tokens": "cache_write", "gen_ai.usage.reasoning_tokens": "reasoning", "gen_ai.request.model": "model_id"}
    ms = F.col("timestamp_ms")
    line = json_line(
        traceId=F.concat(F.lit("t"), F.col("user_id").cast("string")), spanId=F.concat(F.lit("s"), F.col("ord").cast("string")),
        endTime=F.array(F.call_function("div", ms, F.lit(1000)), ms % 1000 * 1_000_000), attributes=F.struct(*[F.col(c).alias(n) for n, c in names.items()]),
    )
    return read(spark, "copilot", written(logged(spark, sf_dir), line))


@query(f"""{SOURCE_SQL} SELECT model_id, CASE ord % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'google' END AS provider_id, timestamp_ms, date, input, output, cache_read, cache_write, {ZERO} AS reasoning,
  'omp:' || CASE WHEN ord % 5 = 1 THEN user_id || ':' || ord ELSE 'x' || ord END AS dedup_key FROM k WHERE ord % 4 > 0 AND input + output + cache_read + cache_write > 0""")
def omp_logs(spark, sf_dir):
    """Messages of routed providers; every fourth line is the user's, every fifth has no response id."""
    use = F.struct("input", "output", F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"))
    routed = F.element_at(F.array(F.lit("anthropic-messages"), F.lit("azure"), F.lit("google-vertex")), (F.col("ord") % 3 + 1).cast("int"))
    message = F.struct(F.when(F.col("ord") % 4 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("ord") % 5 != 1, F.concat(F.lit("x"), F.col("ord").cast("string"))).alias("responseId"), F.col("model_id").alias("model"), routed.alias("provider"), use.alias("usage"))
    line = json_line(type=F.lit("message"), id=F.col("ord").cast("string"), timestamp=iso(), message=message)
    path = moved(spark, written(logged(spark, sf_dir), line, "user_id"))
    return logs.SOURCES["omp"](spark, logs.Config(home=path, roots={"omp": [path]})).select(*SHOWN)


PROVIDED_SQL = f"x(model_id, provider) AS (SELECT col0, CASE WHEN col0 LIKE 'mystery%' THEN 'unknown' ELSE col1 END FROM (VALUES {EXPECTED_SQL}))"
DAY_SQL = "strftime(make_timestamp({} * 1000), '%Y-%m-%d')"


def sums(rows: DataFrame, *more: Column) -> DataFrame:
    """A row a user: the sums of its tokens, its last model and time."""
    tokens = ("input", "output", "cache_read", "cache_write", "reasoning")
    return rows.groupBy("user_id").agg(F.max("ord").alias("last"), F.max_by("model_id", "ord").alias("model_id"), F.max("timestamp_ms").alias("timestamp_ms"), *[F.sum(t).alias(t) for t in tokens], *more).withColumnRenamed("last", "ord")


SUMS_SQL = "s AS (SELECT user_id, arg_max(model_id, ord) AS model_id, max(timestamp_ms) AS timestamp_ms, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(reasoning) AS BIGINT) AS reasoning FROM k GROUP BY user_id)"


@query(f"""{SOURCE_SQL}, {PROVIDED_SQL}, t AS (SELECT *, user_id * 100000000 + ord * 1000 AS said, row_number() OVER (PARTITION BY user_id ORDER BY ord) - 1 AS i FROM k)
SELECT model_id, provider AS provider_id, timestamp_ms, date, input, output, cache_read, cache_write, {ZERO} AS reasoning, 'amp:th' || user_id || ':ledger:' || i AS dedup_key, cost FROM t JOIN x USING (model_id) WHERE user_id % 2 = 0
UNION ALL SELECT model_id, provider, said, {DAY_SQL.format('said')}, input, output, cache_read, cache_write, {ZERO}, 'amp:th' || user_id || ':message:' || ord, cost FROM t JOIN x USING (model_id) WHERE user_id % 2 = 1 AND ord % 4 > 0""")
def amp_logs(spark, sf_dir):
    """A thread a user: half of them have a ledger, the others messages of either side."""
    rows = logged(spark, sf_dir)
    tokens = F.struct("input", "output", F.col("cache_read").alias("cacheReadInputTokens"), F.col("cache_write").alias("cacheCreationInputTokens"))
    use = F.struct(F.col("model_id").alias("model"), F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), F.col("cache_read").alias("cacheReadInputTokens"), F.col("cache_write").alias("cacheCreationInputTokens"), F.col("cost").alias("credits"))
    listed = lambda *fields: F.array_sort(F.collect_list(F.struct(F.col("ord").alias("messageId"), *fields)))
    threads = rows.groupBy("user_id").agg(
        F.max("ord").alias("ord"), listed(iso().alias("timestamp"), F.col("model_id").alias("model"), tokens.alias("tokens"), F.col("cost").alias("credits")).alias("events"),
        listed(F.when(F.col("ord") % 4 > 0, "assistant").otherwise("user").alias("role"), use.alias("usage")).alias("messages"),
    )
    even = F.col("user_id") % 2 == 0
    line = json_line(
        id=F.concat(F.lit("th"), F.col("user_id").cast("string")), created=F.col("user_id").cast("long") * 100_000_000,
        usageLedger=F.when(even, F.struct("events")), messages=F.col("messages"),
    )
    return read(spark, "amp", written(threads, line, "user_id", "T-{}.json"), more=("cost",))


@query(f"""{SOURCE_SQL}, {PROVIDED_SQL}, {SUMS_SQL}
SELECT trim(regexp_replace(translate(model_id, '._ ', '---'), '-{{2,}}', '-', 'g'), '-') AS model_id, CASE WHEN user_id % 3 = 0 THEN 'acme' ELSE provider END AS provider_id, timestamp_ms, {DAY_SQL.format('timestamp_ms')} AS date,
  input, output, cache_read, cache_write, reasoning, 'droid:' || user_id || '.settings' AS dedup_key FROM s JOIN x USING (model_id)""")
def droid_logs(spark, sf_dir):
    """A session's settings a user, a third of them locked to a provider."""
    use = {"inputTokens": "input", "outputTokens": "output", "cacheReadTokens": "cache_read", "cacheCreationTokens": "cache_write", "thinkingTokens": "reasoning"}
    line = json_line(
        model=F.concat("model_id", F.lit("[high]")), providerLock=F.when(F.col("user_id") % 3 == 0, "acme"), providerLockTimestamp=iso(), tokenUsage=F.struct(*[F.col(c).alias(n) for n, c in use.items()])
    )
    return read(spark, "droid", written(sums(logged(spark, sf_dir)), line, "user_id", "{}.settings.json"))


@query(f"""{SOURCE_SQL}, {PROVIDED_SQL}, {SUMS_SQL}
SELECT model_id, CASE WHEN ord % 2 = 0 THEN 'acme' ELSE provider END AS provider_id, timestamp_ms, date, input, output, cache_read, cache_write, reasoning, CASE WHEN ord % 6 > 0 THEN 'opencode:' ELSE '' END || 'm' || ord AS dedup_key, cost
FROM k JOIN x USING (model_id) WHERE ord % 10 > 0
UNION ALL SELECT model_id, provider, timestamp_ms, {DAY_SQL.format('timestamp_ms')}, input, output, cache_read, cache_write, reasoning, CAST(user_id AS VARCHAR), 0.0 FROM s JOIN x USING (model_id)""")
def opencode_logs(spark, sf_dir):
    """Messages in SQLite files, a few of another storage class, beside a session table that knows some of their sessions; and a stored document a user."""
    rows = logged(spark, sf_dir)
    tokens = F.struct("input", "output", "reasoning", F.struct(F.col("cache_read").alias("read"), F.col("cache_write").alias("write")).alias("cache"))
    data = lambda **more: json_line(modelID=F.col("model_id"), tokens=tokens, time=F.struct(F.col("timestamp_ms").alias("created")), **more)
    home = moved(spark, written(sums(rows), data(role=F.lit("assistant")), "user_id", "{}.json"), "storage/message")
    id_ = F.concat(F.lit("m"), F.col("ord").cast("string"))
    stored = rows.select(id_.alias("id"), F.col("user_id").cast("string").alias("session_id"), data(
        role=F.when(F.col("ord") % 10 > 0, "assistant").otherwise("user"), id=F.when(F.col("ord") % 6 > 0, id_), providerID=F.when(F.col("ord") % 2 == 0, "acme"), cost=F.col("cost"),
    ).alias("data"))
    databases(stored, "CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, data TEXT)", home, "opencode-{}.db", "CREATE TABLE session (id TEXT, title TEXT)", "INSERT INTO session SELECT DISTINCT session_id, 'a' FROM message WHERE id LIKE '%3'", "INSERT INTO message VALUES ('odd', 's', x'00'), (CAST(x'41' AS BLOB), 's', '{}')")
    return read(spark, "opencode", home, more=("cost",))


@query(f"""{SOURCE_SQL}, {PROVIDED_SQL}
SELECT model_id, CASE ord % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'anthropic' ELSE provider END AS provider_id, timestamp_ms, date, input, output, cache_read, cache_write, reasoning, 'hermes:s' || ord AS dedup_key,
  CASE WHEN cost > 0 THEN cost WHEN ord % 3 = 0 THEN 0.25 ELSE 0.0 END AS cost, CAST(greatest(ord % 4, 1) AS INTEGER) AS messages FROM k JOIN x USING (model_id) WHERE ord % 9 > 0""")
def hermes_logs(spark, sf_dir):
    """Sessions in SQLite files; every ninth is without a model, and a few count in words."""
    n = F.col("ord")
    rows = logged(spark, sf_dir).select(
        F.concat(F.lit("s"), n.cast("string")).alias("id"), F.when(n % 9 > 0, F.col("model_id")).otherwise(" ").alias("model"), "input", "output", "cache_read", "cache_write", "reasoning",
        F.when(n % 4 == 0, " Acme").when(n % 4 == 1, "Anthropic API").otherwise("").alias("billing"), (F.col("timestamp_ms") / 1000).alias("started"),
        F.col("cost").alias("actual"), F.when(n % 3 == 0, 0.25).otherwise(0.0).alias("estimated"), (n % 4).alias("count"),
    )
    path, parts = fresh_path(spark, "logs"), 4
    create = """CREATE TABLE sessions (id TEXT, model TEXT, input_tokens INTEGER, output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, reasoning_tokens INTEGER,
        billing_provider TEXT, started_at REAL, actual_cost_usd REAL, estimated_cost_usd REAL, message_count INTEGER)"""
    odd = "INSERT INTO sessions SELECT 'odd' || id, model, 'many', output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, billing_provider, started_at, actual_cost_usd, estimated_cost_usd, message_count FROM sessions LIMIT 5"
    databases(rows, create, path, "{}/state.db", odd, parts=parts)
    return read(spark, "hermes", *[f"{path}/{k}" for k in range(parts)], more=("cost", "messages"))


@query(f"""{SOURCE_SQL}, {PROVIDED_SQL} SELECT model_id, provider AS provider_id, timestamp_ms, date, input, output, cache_read, cache_write, {ZERO} AS reasoning,
  'cursor:usage.' || user_id || ':' || strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(timestamp_ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS dedup_key, ord % 100 / 4 AS cost FROM k JOIN x USING (model_id)""")
def cursor_csv_logs(spark, sf_dir):
    """A CSV file a user, with a column Kind and quoted models and costs."""
    head = "Date,Kind,Model,Max Mode,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost"
    cost = F.concat(F.lit('"$'), F.format_number(F.col("ord") % 100 / 4, 2), F.lit('"'))
    line = F.concat_ws(",", iso(), F.lit("Included"), F.concat(F.lit('"'), "model_id", F.lit('"')), F.lit("No"), F.col("input") + F.col("cache_write"), "input", "cache_read", "output", F.lit("1"), cost)
    files = logged(spark, sf_dir).groupBy("user_id").agg(F.max("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit(head + "\r\n"), F.array_join("lines.line", "\r\n"))
    return read(spark, "cursor", written(files, text, "user_id", "usage.{}.csv"), more=("cost",))


def grok_lines(spark: SparkSession, sf_dir: str, named: bool = True) -> str:
    """A session folder a user: the same cumulative totals as ``turn_segments``; ``named``: every fourth line names its model."""
    running = F.sum("k").over(Window.partitionBy("user_id").orderBy("ord"))
    rows = usage_messages(spark, sf_dir).withColumn("total", F.when(F.col("ord") % 7 > 0, running - F.when(F.col("ord") % 5 == 0, 100).otherwise(0)))
    meta = F.struct(F.col("total").alias("totalTokens"), F.col("timestamp_ms").alias("agentTimestampMs"))
    kind = F.when(F.col("event_type") == "purchase", "user_message_chunk").otherwise("agent_message_chunk")
    line = json_line(params=F.struct(meta.alias("_meta"), F.struct(kind.alias("sessionUpdate")).alias("update"), F.when((F.col("ord") % 4 == 0) & F.lit(named), F.col("model_id")).alias("modelId")))
    return written(rows, line, "user_id", "{}/updates.jsonl")


@query(f"""SELECT model AS model_id, 'xai' AS provider_id, timestamp_ms, {DAY_SQL.format('timestamp_ms')} AS date, delta AS input, {ZERO} AS output, {ZERO} AS cache_read, {ZERO} AS cache_write, {ZERO} AS reasoning,
  'grok:sessions:' || user_id || ':' || turn AS dedup_key FROM ({SQL['turn_segments']})""")
def grok_logs(spark, sf_dir):
    """Turns of a session's cumulative totals."""
    return read(spark, "grok", moved(spark, grok_lines(spark, sf_dir)))


@query(f"""SELECT CASE user_id % 3 WHEN 0 THEN 'grok-summary' WHEN 1 THEN 'grok-journal' ELSE 'grok-signals' END AS model_id, 'xai' AS provider_id, timestamp_ms, {DAY_SQL.format('timestamp_ms')} AS date, delta AS input, {ZERO} AS output,
  {ZERO} AS cache_read, {ZERO} AS cache_write, {ZERO} AS reasoning, 'grok:sessions:' || user_id || ':' || turn AS dedup_key FROM ({SQL['turn_segments']})""")
def grok_sibling_logs(spark, sf_dir):
    """Sessions whose lines name no model: a summary, a journal or signals beside them do; a journal of which others know more counts less."""
    path = grok_lines(spark, sf_dir, named=False)
    users = logged(spark, sf_dir).groupBy("user_id").agg(F.max("ord").alias("ord"))
    of = lambda k: users.filter(F.col("user_id") % 3 == k)
    written(of(0), json_line(current_model_id=F.lit("grok-summary"), updated_at=F.lit("2024-01-01T00:00:00Z")), "user_id", "{}/summary.json", path)
    journal = users.filter("user_id % 3 < 2").select("user_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord")).withColumn("model", F.when(F.col("ord") == 2, "grok-journal").when(F.col("ord") == 3, "later"))
    written(journal, json_line(ts=F.lit("2024-01-01T00:00:00Z"), model_id=F.col("model")), "user_id", "{}/events.jsonl", path)
    written(of(2), json_line(primaryModelId=F.lit("grok-signals")), "user_id", "{}/signals.json", path)
    return read(spark, "grok", moved(spark, path))


@query(f"""{SOURCE_SQL}, {PROVIDED_SQL} SELECT model_id, provider AS provider_id, timestamp_ms, date, input, output, cache_read, {ZERO} AS cache_write, {ZERO} AS reasoning,
  'cursor:' || timestamp_ms || ':' || input || ':' || output AS dedup_key, ord % 100 / 4 AS cost FROM k JOIN x USING (model_id) WHERE ord % 8 > 0""")
def cursor_cache_logs(spark, sf_dir):
    """Captured pages, a user's events each, become the cache, in which every eighth event has no time; it goes before the CSV file beside it."""
    use = F.struct(F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), F.col("cache_read").alias("cacheReadTokens"), (F.col("ord") % 100 * 25).alias("totalCents"))
    event = F.struct(F.when(F.col("ord") % 8 > 0, F.col("timestamp_ms").cast("string")).otherwise("soon").alias("timestamp"), F.col("model_id").alias("model"), use.alias("tokenUsage"))
    pages = logged(spark, sf_dir).groupBy("user_id").agg(F.collect_list(event).alias("usageEventsDisplay")).select(F.to_json(F.struct("usageEventsDisplay")).alias("value"))
    head = spark.createDataFrame([(0, 0, "Date,Model\n2023-11-15,other,1,1,1,1,1,1")], "user_id int, ord int, value string")
    path = written(head, F.col("value"), "user_id", "usage.{}.csv")
    cache.write_cache(spark, logs.cursor_pages(pages), path)
    return read(spark, "cursor", path, more=("cost",))


# --- listing and increments -----------------------------------------------------------------------


def claude_line(rows: DataFrame, id_: Column | None = None) -> Column:
    id_ = F.concat(F.lit("m"), F.col("ord").cast("string")) if id_ is None else id_
    use = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"))
    return json_line(type=F.lit("assistant"), timestamp=iso(), requestId=F.lit("r"), message=F.struct(id_.alias("id"), F.col("model_id").alias("model"), use.alias("usage")))


CLAUDE_SQL = f"""SELECT model_id, 'anthropic' AS provider_id, timestamp_ms, date, input, output, cache_read, cache_write, {ZERO} AS reasoning, 'claude:m' || ord || ':r' AS dedup_key"""


@query(f"WITH {MESSAGES_SQL} {CLAUDE_SQL} FROM u WHERE input + output + cache_read + cache_write > 0")
def hidden_and_linked_logs(spark, sf_dir):
    """A file a user, in names and folders that begin with a dot or an underscore; a link to a folder of other logs is not followed."""
    rows = usage_messages(spark, sf_dir)
    shapes = ("p/{}.jsonl", "p/_{}.jsonl", "_q/r/.{}.jsonl", ".h/{}.jsonl")
    path = written(rows, claude_line(rows), "user_id", lambda user: shapes[int(user) % 4].format(user))
    if (at := listing.local(path)) is not None:
        other = written(rows.limit(50).withColumn("ord", -F.col("ord") - 1), claude_line(rows))
        os.symlink(listing.local(other), f"{at}/p/linked")
    return read(spark, "claude", path)


@query(f"""WITH {MESSAGES_SQL}, f AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'b00000002' ELSE 'b00000001' END AS batch FROM u WHERE user_id % 5 <> 1 AND (user_id % 5 = 0 OR ord % 3 > 0))
{CLAUDE_SQL}, batch FROM f WHERE input + output + cache_read + cache_write > 0""")
def incremental_ingest(spark, sf_dir):
    """Logs in two states: a fifth of the users' files grow, a fifth vanish; messages of all others stay from the first batch."""
    rows = usage_messages(spark, sf_dir)
    path, facts = written(rows.filter("ord % 3 > 0"), claude_line(rows), "user_id"), ingest.Facts(spark, fresh_path(spark, "facts"))
    config = logs.Config(home=path, roots={"claude": [path]})
    facts.update(config, ["claude"])
    written(rows.filter("user_id % 5 = 0"), claude_line(rows), "user_id", path=path)
    without(rows.filter("user_id % 5 = 1"), path, "{}.jsonl".format)
    facts.update(config, ["claude"])
    return facts.read(["claude"], keep=("batch",)).select(*SHOWN, "batch")


@query(f"""WITH {MESSAGES_SQL}, p AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN '0-' ELSE '' END || user_id || '.jsonl' AS file, ord % 700 AS id FROM u WHERE user_id % 7 > 0 AND input + output + cache_read + cache_write > 0),
m AS (SELECT id, file, min(ord) AS ord, arg_min(model_id, ord) AS model_id, arg_min(date, ord) AS date, max(input) AS input, max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write FROM p GROUP BY id, file),
w AS (SELECT id, min(row(file, ord)) AS f FROM m GROUP BY id)
SELECT date, 'claude' AS client, 'anthropic' AS provider_id, model_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
  CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens, count(*) AS messages FROM m JOIN w USING (id) WHERE f = row(file, ord) GROUP BY ALL""")
def incremental_daily(spark, sf_dir):
    """Messages that stand in several files: files that sort earlier come later and take them, files that go give them back; only touched days are made again."""
    rows = usage_messages(spark, sf_dir)
    line = claude_line(rows, F.concat(F.lit("i"), (F.col("ord") % 700).cast("string")))
    path, daily = written(rows.filter("user_id % 3 > 0"), line, "user_id"), increments.Increments(spark, fresh_path(spark, "daily"))
    config = logs.Config(home=path, roots={"claude": [path]})
    daily.update(config, ["claude"])
    written(rows.filter("user_id % 3 = 0"), line, "user_id", "0-{}.jsonl", path)
    daily.update(config, ["claude"])
    without(rows.filter("user_id % 7 = 0"), path, lambda user: f"{'0-' if int(user) % 3 == 0 else ''}{user}.jsonl")
    daily.update(config, ["claude"])
    return daily.daily().drop("cost", "reasoning")


# --- the same logs as streams --------------------------------------------------------------------

LIVE = ("ts_ms", "client", "agent", "model", "input", "output", "cache_read", "cache_write")
LIVE_SQL = "CASE WHEN length({0}) > 9 THEN regexp_replace({0}, '-[0-9]{{8}}$', '') ELSE {0} END"


def streamed(spark: SparkSession, client: str, path: str, **options) -> DataFrame:
    """All events that the growing files under ``path`` give, through a stream and back."""
    out = fresh_path(spark, "events")
    events = live.live_events(spark, client, path, **options)
    run = events.writeStream.format("parquet").option("checkpointLocation", scratch(f"{out}-checkpoint")).start(out)
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(live.EVENT).parquet(out)


@query(f"""WITH {MESSAGES_SQL}, c AS (SELECT *, user_id || ':' || event_type || ':' || date || ':' || (ord % 2) AS id FROM u WHERE ord % 10 > 0 AND ord % 17 > 0 AND input + output + cache_read + cache_write > 0)
SELECT arg_min(timestamp_ms, ord) AS ts_ms, 'claude-code' AS client, arg_min(CASE WHEN ord % 3 = 0 THEN 'subagent:a' || (ord % 4) ELSE 'main' END, ord) AS agent, arg_min({LIVE_SQL.format('model_id')}, ord) AS model,
  max(input) AS input, max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write, 'claude:' || id || ':r' AS key FROM c GROUP BY id""")
def claude_stream(spark, sf_dir):
    """Appended lines as events, repeats of a message merged; a third are of side chains."""
    use = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_write").alias("cache_creation_input_tokens"))
    message = F.struct(F.concat_ws(":", "id", (F.col("ord") % 2).cast("string")).alias("id"), F.col("model_id").alias("model"), use.alias("usage"))
    line = json_line(
        type=F.when(F.col("ord") % 10 == 0, "user").otherwise("assistant"), timestamp=iso(), requestId=F.lit("r"), isSidechain=F.col("ord") % 3 == 0,
        agentId=F.concat(F.lit("a"), (F.col("ord") % 4).cast("string")), message=message,
    )
    path = written(logged(spark, sf_dir), F.when(F.col("ord") % 17 == 0, F.substring(line, 1, 40)).otherwise(line))
    return trace.merged(streamed(spark, "claude", path)).select(*LIVE, "key")


@query(f"""WITH {MESSAGES_SQL}, c AS (SELECT *, coalesce(last_value(CASE WHEN ord % 7 = 0 THEN model_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS m, k % 3 AS cached FROM u)
SELECT timestamp_ms AS ts_ms, 'codex-cli' AS client, 'main' AS agent, {LIVE_SQL.format('m')} AS model, greatest(k - cached, 0) AS input, k % 5 AS output, cached AS cache_read, {ZERO} AS cache_write
FROM c WHERE ord % 7 > 0 AND greatest(k - cached, 0) + k % 5 + cached > 0""")
def codex_stream(spark, sf_dir):
    """A file a user; the model named last is state between lines."""
    last = F.struct(F.col("k").alias("input_tokens"), (F.col("k") % 5).alias("output_tokens"), (F.col("k") % 3).alias("cached_input_tokens"))
    turn = json_line(type=F.lit("turn_context"), timestamp=iso(), payload=F.struct(F.col("model_id").alias("model")))
    count = json_line(type=F.lit("event_msg"), timestamp=iso(), payload=F.struct(F.lit("token_count").alias("type"), F.struct(last.alias("last_token_usage")).alias("info")))
    path = written(logged(spark, sf_dir), F.when(F.col("ord") % 7 == 0, turn).otherwise(count), "user_id")
    return streamed(spark, "codex", path).select(*LIVE)


@query(f"""WITH {MESSAGES_SQL}, r AS (SELECT *, CASE WHEN ord % 7 > 0 THEN sum(k) OVER (PARTITION BY user_id ORDER BY ord) - CASE WHEN ord % 5 = 0 THEN 100 ELSE 0 END END AS total FROM u),
c AS (SELECT *, coalesce(max(CASE WHEN total >= 0 THEN total END) OVER before, 0) AS mark, coalesce(last_value(CASE WHEN ord % 4 = 0 THEN model_id END IGNORE NULLS) OVER upto, 'unknown') AS m FROM r
  WINDOW before AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT timestamp_ms AS ts_ms, 'grok' AS client, 'main' AS agent, {LIVE_SQL.format('m')} AS model, CAST(total - mark AS BIGINT) AS input, {ZERO} AS output, {ZERO} AS cache_read, {ZERO} AS cache_write FROM c WHERE total > mark""")
def grok_stream(spark, sf_dir):
    """A file a user; the model and the high-water mark are state between lines."""
    return streamed(spark, "grok", grok_lines(spark, sf_dir)).select(*LIVE)


@query(SQL["grok_stream"])
def bounded_stream(spark, sf_dir):
    """The same in batches of a third of all bytes: models and marks go on from batch to batch."""
    path = grok_lines(spark, sf_dir)
    size = listing.files(spark, [path], "*.jsonl").agg(F.sum("size")).first()[0] or 0
    return streamed(spark, "grok", path, batch_bytes=size // 3 + 1, progress=scratch(f"{path}-progress")).select(*LIVE)


@query(f"""WITH {MESSAGES_SQL}, t AS (SELECT user_id, j, CAST(sum(k) FILTER (ord % 3 <= j) AS BIGINT) AS total FROM u, range(3) AS s(j) GROUP BY ALL),
c AS (SELECT user_id, j, CASE WHEN j = 1 AND user_id % 7 = 0 THEN total // 2 ELSE total END AS input, total // 3 AS output FROM t WHERE total IS NOT NULL AND (j > 0 OR user_id % 5 > 0)),
g AS (SELECT user_id, j, greatest(input - coalesce(lag(input) OVER w, 0), 0) AS input, greatest(output - coalesce(lag(output) OVER w, 0), 0) AS output FROM c WINDOW w AS (PARTITION BY user_id ORDER BY j))
SELECT 's' || user_id AS session_id, 1700000000000 + j AS ts_ms, 'hermes' AS client, 'm' AS model, input, output FROM g WHERE j > 0 AND input + output > 0""")
def hermes_stream(spark, sf_dir):
    """Three snapshots of four databases, the query restarted for each: sessions grow, fall and come later."""
    rows, path, parts = usage_messages(spark, sf_dir), fresh_path(spark, "logs"), 4
    create = "CREATE TABLE sessions (id TEXT, model TEXT, input_tokens INTEGER, output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER)"
    out, checkpoint = fresh_path(spark, "events"), scratch(f"{path}-checkpoint")
    for j in range(3):
        total = rows.filter(F.pmod("ord", F.lit(3)) <= j).filter(f"{j} > 0 OR user_id % 5 > 0").groupBy("user_id").agg(F.sum("k").cast("long").alias("total"))
        half = F.when((F.col("user_id") % 7 == 0) & F.lit(j == 1), F.expr("total div 2")).otherwise(F.col("total"))
        stored = total.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("id"), F.lit("M-20250514").alias("model"), half.alias("i"), F.expr("total div 3").alias("o"), F.lit(0).alias("r"), F.lit(None).cast("int").alias("w"))
        databases(stored, create, path, "{}/state.db", parts=parts)
        events = live.all_events(spark, {"hermes": [f"{path}/{k}" for k in range(parts)]}, 1_700_000_000_000 + j)
        events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    session = F.element_at(F.split("ord", ":"), -2)
    return spark.read.schema(live.EVENT).parquet(out).select(session.alias("session_id"), "ts_ms", "client", "model", "input", "output")


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT *, ord % 7200 AS n FROM u), e AS (SELECT n, 1700000000000 + n * 1000 AS ts_ms, max(k % 1000 + 1) AS input FROM k GROUP BY n)
SELECT ts_ms, 'claude-code' AS client, 'main' AS agent, 'm' || (n % 3) AS model, CAST(input AS BIGINT) AS input, 'claude:i' || n || ':r' AS key FROM e WHERE ts_ms >= (SELECT max(ts_ms) FROM e) - 3600000""")
def live_last_hour(spark, sf_dir):
    """Logs that come in three batches, the query restarted for each: repeats merge across batches, what is past an hour has left the state."""
    rows, path = usage_messages(spark, sf_dir).withColumn("n", F.col("ord") % 7200), fresh_path(spark, "logs")
    message = F.struct(F.concat(F.lit("i"), F.col("n").cast("string")).alias("id"), F.concat(F.lit("m"), (F.col("n") % 3).cast("string")).alias("model"), F.struct((F.col("k") % 1000 + 1).alias("input_tokens")).alias("usage"))
    at = F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("n") * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    line = json_line(type=F.lit("assistant"), timestamp=at, requestId=F.lit("r"), message=message)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop(path))
    checkpoint = scratch(f"{path}-checkpoint")
    for part in range(3):
        store.rename(hadoop(written(rows.filter(F.pmod("ord", F.lit(3)) == part), line)), hadoop(path, str(part)))
        live.follow(live.live_events(spark, "claude", path, 1_700_010_000_000, lookback_ms=1 << 50), checkpoint, 1_700_010_000_000, availableNow=True).awaitTermination()
    return live.hour(spark, checkpoint).select("ts_ms", "client", "agent", "model", "input", "key")


@query(f"""WITH {MESSAGES_SQL}, e AS (SELECT 1700000000000 + ord % 3000 * 1000 AS ts_ms, k % 1000 + 1 AS n FROM u), c(client) AS (VALUES ('claude-code'), ('codex-cli'), ('grok'), ('omp'))
SELECT client, count(*) AS events, CAST(sum(n) AS BIGINT) AS tokens, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM e, c GROUP BY client""")
def live_all_clients(spark, sf_dir):
    """The same numbers logged by four clients, each in its own form, followed by one query."""
    rows = usage_messages(spark, sf_dir).withColumns({"n": F.col("k") % 1000 + 1, "ms": F.lit(1_700_000_000_000) + F.col("ord") % 3000 * 1000})
    stamp, id_ = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.concat(F.lit("a"), F.col("ord").cast("string"))
    use = lambda name: F.struct(F.col("n").alias(name))
    total = F.sum("n").over(Window.partitionBy("user_id").orderBy("ord"))
    lines = {
        "claude": json_line(type=F.lit("assistant"), timestamp=stamp, requestId=F.lit("r"), message=F.struct(id_.alias("id"), use("input_tokens").alias("usage"))),
        "codex": json_line(type=F.lit("event_msg"), timestamp=stamp, payload=F.struct(F.lit("token_count").alias("type"), F.struct(use("input_tokens").alias("last_token_usage")).alias("info"))),
        "grok": json_line(params=F.struct(F.struct(F.col("total").alias("totalTokens"), F.col("ms").alias("agentTimestampMs")).alias("_meta"))),
        "omp": json_line(type=F.lit("message"), message=F.struct(F.lit("assistant").alias("role"), F.col("ms").alias("timestamp"), id_.alias("responseId"), use("input").alias("usage"))),
    }
    roots = {c: [written(rows.withColumn("total", total), line, "user_id", "{}/updates.jsonl")] for c, line in lines.items()}
    checkpoint, now = scratch(f"{roots['claude'][0]}-checkpoint"), 1_700_003_000_000
    live.follow(live.all_events(spark, roots, now, lookback_ms=1 << 50), checkpoint, now, availableNow=True).awaitTermination()
    found = live.hour(spark, checkpoint).groupBy("client")
    return found.agg(F.count(F.lit(1)).alias("events"), F.sum("input").alias("tokens"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(f"""WITH {MESSAGES_SQL}, e AS (SELECT ord % 1001 AS n, ord % 3 AS part, k % 50 + 1 AS tokens FROM u),
m AS (SELECT n, j, max(tokens) AS tokens FROM e, range(3) AS s(j) WHERE part <= j GROUP BY n, j),
r AS (SELECT 'c' || (n % 11) AS client, j, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY ALL)
SELECT client, tokens, tokens / 60 AS tokens_per_min FROM (SELECT *, lag(tokens) OVER (PARTITION BY client ORDER BY j) AS before FROM r) WHERE tokens IS DISTINCT FROM before""")
def published_rates(spark, sf_dir):
    """Events of the last minute in three batches, the query restarted for each: rates over an hour, published when they change."""
    src, out = fresh_path(spark, "events"), fresh_path(spark, "rates")
    n, zero = F.col("ord") % 1001, F.lit(0).cast("long")
    now = spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0]
    rows = usage_messages(spark, sf_dir).select(
        "ord", (F.lit(now) - n * 50).alias("ts_ms"), F.concat(F.lit("c"), (n % 11).cast("string")).alias("client"), F.lit("main").alias("agent"), F.lit("m").alias("model"),
        (F.col("k") % 50 + 1).cast("long").alias("input"), zero.alias("output"), zero.alias("cache_read"), zero.alias("cache_write"), F.concat(F.lit("k"), n.cast("string")).alias("key"),
    )
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    for part in range(3):
        some = rows.filter(F.pmod("ord", F.lit(3)) == part).withColumn("ord", F.lpad(F.col("ord").cast("string"), 15, "0"))
        some.select(*live.EVENT_COLUMNS).write.mode("append").parquet(src)
        rates = publish.rates(live.last_hour(spark.readStream.schema(live.EVENT).parquet(src)), emit_ms=0, window_s=3600)
        run = rates.writeStream.format("parquet").option("checkpointLocation", scratch(f"{src}-checkpoint")).trigger(processingTime="1 second").start(out)
        # with timers by the clock a query never ends by itself: the part is read by the first or second batch
        while len(run.recentProgress) < 3 and not run.awaitTermination(1):
            pass
        run.stop()
    return spark.read.schema(publish.RATE).parquet(out).select("client", "tokens", "tokens_per_min")
