"""Usage logs of each client as rows of the fact table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import models
from ..functions import time as times
from ..operators import stateful
from ..operators.messages import total_tokens
from ..session import once, stored
from . import cache, sqlite
from .files import Config, children, documents, existing, folder, lines, listed, messages, numbered, parent, parsed, path_key, stem

V = "v"


def at(path: str, v: Column | str = V) -> Column:
    return J.node(F.col(v) if isinstance(v, str) else v, path)


def text(path: str, v: Column | str = V) -> Column:
    return J.string_value(at(path, v))


def count(path: str, v: Column | str = V) -> Column:
    return J.non_negative(at(path, v))


def positive(df: DataFrame) -> DataFrame:
    return df.filter(total_tokens() > 0)


def prefixed(prefix: str, *parts: Column) -> Column:
    """prefix:a:b, or null if a part is null."""
    out = [F.lit(prefix)]
    for p in parts:
        out += [F.lit(":"), p.cast("string")]
    return F.concat(*out)


def claude_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("claude", f"{config.home}/.claude/projects", f"{config.home}/.claude/transcripts")


def claude(spark: SparkSession, config: Config) -> DataFrame:
    rows = parsed(lines(spark, claude_roots(spark, config), "*.{jsonl,json}", config.stop_at_bad_line, config.only))
    rows = rows.filter((J.raw_string(at("$.type")) == "assistant") & at("$.message.usage").isNotNull() & text("$.message.model").isNotNull())
    use = "$.message.usage."
    made = messages(
        rows, "claude", model=text("$.message.model"), provider=F.lit("anthropic"), ts=F.coalesce(times.timestamp_ms(at("$.timestamp")), F.col("mtime_ms")),
        input=count(use + "input_tokens"), output=count(use + "output_tokens"), cache_read=count(use + "cache_read_input_tokens"), cache_write=count(use + "cache_creation_input_tokens"),
        key=prefixed("claude", text("$.message.id"), text("$.requestId")), keep=("file",),
    )
    return stateful.max_merge(positive(made)).drop("file")


def codex_events(rows: DataFrame) -> DataFrame:
    """Counter events in the fold's form."""
    kind, payload = J.raw_string(at("$.type")), "$.payload"
    inner = J.raw_string(at(f"{payload}.type"))
    info = at(f"{payload}.info")
    is_count = (kind == "event_msg") & (inner == "token_count") & info.isNotNull()

    def totals(path: str) -> Column:
        cached = F.greatest(count(f"{path}.cached_input_tokens"), count(f"{path}.cache_read_input_tokens"))
        made = F.struct(count(f"{path}.input_tokens").alias("input"), count(f"{path}.output_tokens").alias("output"), cached.alias("cached"), count(f"{path}.reasoning_output_tokens").alias("reasoning"))
        return F.when(is_count & at(path).isNotNull(), made)

    type_ = F.when(kind == "session_meta", "meta").when(kind == "turn_context", "turn").when(is_count, "count")
    # the first key that is there decides, even if it holds no text
    turn_model = J.string_value(J.first_present(F.col(V), f"{payload}.model_info.slug", f"{payload}.model", f"{payload}.model_name"))
    model = F.when(type_ == "turn", turn_model).when(type_ == "count", F.coalesce(text(f"{payload}.info.model"), text(f"{payload}.info.model_name")))
    reported = J.i64_value(at(f"{payload}.info.total_token_usage.total_tokens"))
    return rows.select(
        "file", "root_ord", "path_key", "block", "pos", "mtime_ms", type_.alias("type"), model.alias("model"), text(f"{payload}.model_provider").alias("provider"),
        text(f"{payload}.forked_from_id").isNotNull().alias("forked"), F.coalesce(times.timestamp_ms(at("$.timestamp")), F.col("mtime_ms")).alias("timestamp_ms"),
        totals(f"{payload}.info.total_token_usage").alias("total"), totals(f"{payload}.info.last_token_usage").alias("last"), F.when(reported >= 0, reported).alias("reported"),
    ).filter("type IS NOT NULL")


def codex_roots(spark: SparkSession, config: Config) -> list[str]:
    # a launcher that redirects the home keeps one for each of its runtimes
    redirected = [h for d in (f"{config.home}/Library/Application Support", config.data) for h in children(spark, f"{d}/orca/codex-runtime-home")]
    homes = config.of("codex", config.codex_home or f"{config.home}/.codex", *redirected)
    return [f"{h}/{d}" for h in homes for d in ("sessions", "archived_sessions")] + config.of("codex_exports")


def codex(spark: SparkSession, config: Config) -> DataFrame:
    events = codex_events(parsed(lines(spark, codex_roots(spark, config), "*.jsonl", config.stop_at_bad_line, config.only)))
    # the fold is told a file's place among the roots by its key, and a line's place in the file by one number: its offset
    keyed = events.withColumns({"file": F.concat(F.lpad(F.col("root_ord").cast("string"), 9, "0"), F.col("file")), "ord": F.col("pos")})
    folded = stateful.counter_deltas(keyed.select("file", "ord", "type", "model", "provider", "forked", "timestamp_ms", "total", "last", "reported"))
    name = F.substring("file", 10, 1 << 30)
    folded = folded.withColumns({"root_ord": F.substring("file", 1, 9).cast("int"), "path_key": path_key(name), "block": F.lit(0).cast("long"), "pos": F.col("ord")})
    key = prefixed("codex", *[F.col(c) for c in ("timestamp_ms", "model_key", "input", "output", "cache_read")])
    return messages(
        folded.withColumn("model_key", models.normalize_model(F.col("model"))), "codex", model=F.col("model"), provider=F.col("provider"), ts=F.col("timestamp_ms"),
        input=F.col("input"), output=F.col("output"), cache_read=F.col("cache_read"), reasoning=F.col("reasoning"), key=key,
    )


# --- Cursor: a JSON cache, else CSV ----------------------------------------------------------


def split_csv(line: Column) -> Column:
    """Fields at commas that an even number of quotes precedes; quotes stay in the text, doubled or not.

    U+0001 escapes: with 1 it stands for itself, with 2 for a comma that parts fields.
    """
    parts = F.split(F.replace(line, F.lit("\u0001"), F.lit("\u00011")), '"', -1)
    outside = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit("\u00012"))).otherwise(p))
    return F.transform(F.split(F.array_join(outside, '"'), "\u00012", -1), lambda f: F.replace(f, F.lit("\u00011"), F.lit("\u0001")))


def clean_csv(field: Column) -> Column:
    return F.regexp_replace(F.trim(field), '^"+|"+$', "")


def parse_cost(field: Column) -> Column:
    plain = F.trim(F.translate(field, "$,", ""))
    return F.when(F.lower(plain).isin("", "nan", "included", "-"), F.lit(0.0)).otherwise(F.coalesce(plain.try_cast("double"), F.lit(0.0)))


#: Bytes beyond which a cache is read by ranges if it can be.
LARGE = 16 << 20
#: One pair of braces outside of strings, no brackets.
FLAT = r'^\{(?:[^"{}\[\]]++|"(?:[^"\\]++|\\.)*+")*+\}$'


def cursor_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("cursor", f"{config.home}/.config/cursor-cache")


WHOLE = ("timestamp_ms", "input_tokens", "output_tokens", "cache_read_tokens")


def cursor_sound(e: Column) -> Column:
    ok = J.is_string(J.node(e, "$.model")) & J.is_number(J.node(e, "$.cost"))
    for f in WHOLE:
        ok = ok & J.is_integer(J.node(e, f"$.{f}"))
    return F.coalesce(ok, F.lit(False))


def cursor_lines(spark: SparkSession, config: Config, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of large caches that have a line each, as ``cache`` writes them, read by ranges; and the files (file) that are of this form.

    Every byte must be accounted for: the first and the last line, and between them a flat object a
    line, a comma after each but the last. Such a file is the document of these events.
    """
    rows = lines(spark, cursor_roots(spark, config), "events.json", only=large, size=max(LARGE, 1 << 10))
    comma = F.col("value").endswith(",")
    rows = rows.withColumns({"comma": comma, "text": F.when(comma, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))})
    # the parser passes over what follows a value: a line with one pair of braces outside of strings holds nothing more
    rows = rows.withColumn("e", F.when((F.length("text") < 4096) & F.col("text").rlike(FLAT), J.parse(F.col("text")))).withColumn("event", F.col("e").isNotNull())
    seen = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"), F.count_if(F.col("event") & F.col("comma")).alias("commas"), F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"), F.max(F.when(F.col("event"), F.col("pos"))).alias("end"), F.max(F.when(F.col("event") & ~F.col("comma"), F.col("pos"))).alias("open"),
        F.count_if(F.col("event") & ~cursor_sound(F.col("e"))).alias("unsound"),
    )
    whole = (F.col("first") == cache.HEAD) & (F.col("last") == cache.TAIL) & (F.col("n") == F.col("events") + 2) & (F.col("commas") == F.col("events") - 1) & (F.col("open") == F.col("end"))
    found = once(seen.join(large, "file").filter(whole & (F.col("bytes") - F.col("size")).isin(0, 1)).select("file", "unsound"))
    return rows.filter("event").join(F.broadcast(found.filter("unsound = 0").select("file")), "file", "left_semi").withColumn("i", F.lit(0)), found.select("file")


def cursor_json(spark: SparkSession, config: Config, name: str = "events.json") -> DataFrame:
    """Strict: one malformed event fails its document. A large cache with a line an event is read by ranges, any other document by one task."""
    files = once(listed(spark, cursor_roots(spark, config), name, only=config.only))
    large, columns = files.filter(F.col("size") > LARGE).select("file", "size"), ("file", "root_ord", "path_key", "block", "pos", "mtime_ms", "i", "e")
    by_lines, small = None, files.select("file")
    if name == "events.json" and not large.isEmpty():
        by_lines, formed = cursor_lines(spark, config, large)
        small = small.join(formed, "file", "left_anti")
    rows = parsed(documents(spark, cursor_roots(spark, config), name, small))
    events = F.try_variant_get(V, "$.events", "array<variant>")
    rows = rows.withColumn("events", events).filter(F.forall("events", cursor_sound)).select("*", F.posexplode("events").alias("i", "e")).select(*columns)
    if by_lines is not None:
        rows = rows.unionByName(by_lines.select(*columns))
    n = {f: J.i64_value(at(f"$.{f}", "e")) for f in WHOLE}
    model = J.raw_string(at("$.model", "e"))
    return messages(
        rows.filter(n["timestamp_ms"] > 0), "cursor", model=model, provider=models.infer_provider(model), ts=n["timestamp_ms"],
        input=F.greatest(n["input_tokens"], F.lit(0)), output=F.greatest(n["output_tokens"], F.lit(0)), cache_read=F.greatest(n["cache_read_tokens"], F.lit(0)),
        cost=J.f64_value(at("$.cost", "e")), key=prefixed("cursor", n["timestamp_ms"], n["input_tokens"], n["output_tokens"]), index=F.col("i"),
    )


def cursor_pages(pages: DataFrame) -> DataFrame:
    """Captured usage pages (``value``: JSON) as the events of the cache: cents become dollars, rows without a whole time go."""
    rows = pages.select(F.explode(F.try_variant_get(J.parse(F.col("value")), "$.usageEventsDisplay", "array<variant>")).alias("e"))
    ts = F.trim(J.raw_string(at("$.timestamp", "e"))).try_cast("bigint")
    names = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_read_tokens": "cacheReadTokens"}
    cents = F.greatest(F.coalesce(J.f64_value(at("$.tokenUsage.totalCents", "e")), F.lit(0.0)), F.lit(0.0))
    return rows.select(
        ts.alias("timestamp_ms"), F.coalesce(J.raw_string(at("$.model", "e")), F.lit("cursor")).alias("model"),
        *[J.non_negative(at(f"$.tokenUsage.{p}", "e")).alias(n) for n, p in names.items()], (cents / 100).alias("cost"),
    ).filter("timestamp_ms IS NOT NULL")


#: Columns of model, input with and without cache writes, cache read, output and cost, by layout.
CSV_LAYOUTS = {"wide": (4, 6, 7, 8, 9, 11), "kind": (2, 4, 5, 6, 7, 9), "plain": (1, 2, 3, 4, 5, 7)}


def cursor_csv(spark: SparkSession, config: Config) -> DataFrame:
    rows = documents(spark, cursor_roots(spark, config), "{usage.csv,usage.*.csv}", config.only)
    every = F.transform(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n", -1), split_csv)
    head = F.element_at("fields", 1)
    has_kind = F.exists(head, lambda f: F.regexp_replace(f, '^"+|"+$', "") == "Kind")
    layout = F.when(has_kind & (F.size(head) >= 12), "wide").when(has_kind & (F.size(head) >= 10), "kind").otherwise("plain")
    rows = rows.withColumn("fields", every).withColumn("layout", layout).select("*", F.posexplode("fields").alias("i", "f")).filter("i > 0").drop("value", "fields")

    def field(k: int) -> Column:
        place = F.coalesce(*[F.when(F.col("layout") == name, cols[k]) for name, cols in CSV_LAYOUTS.items()])
        return clean_csv(F.get("f", place))

    number = lambda c: F.coalesce(F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast("bigint")), F.lit(0).cast("long"))
    last = F.coalesce(*[F.when(F.col("layout") == name, cols[5]) for name, cols in CSV_LAYOUTS.items()])
    date = clean_csv(F.get("f", F.lit(0)))
    ts, model = times.date_or_zero_ms(date), field(0)
    with_cache, without = number(field(1)), number(field(2))
    rows = rows.filter((F.size("f") > last) & (model != "") & (ts > 0))
    return messages(
        rows, "cursor", model=model, provider=models.infer_provider(model), ts=ts, input=F.greatest(without, F.lit(0)), output=F.greatest(number(field(4)), F.lit(0)),
        cache_read=F.greatest(number(field(3)), F.lit(0)), cache_write=F.greatest(with_cache - without, F.lit(0)), cost=parse_cost(field(5)),
        key=prefixed("cursor", stem(F.col("file")), date), index=F.col("i"),
    )


def cursor(spark: SparkSession, config: Config) -> DataFrame:
    """The JSON cache if it has any message, else the CSV files."""
    cached = cursor_json(spark, config)
    return cursor_csv(spark, config) if cached.isEmpty() else cached


# --- OpenCode ----------------------------------------------------------------------------------


def opencode_rows(rows: DataFrame, now_ms: int, fallback_key: Column) -> DataFrame:
    rows = rows.filter((J.raw_string(at("$.role")) == "assistant") & at("$.tokens").isNotNull())
    model = F.coalesce(text("$.modelID"), text("$.model"))
    rows = rows.filter(model.isNotNull())
    return messages(
        rows, "opencode", model=model, provider=F.coalesce(text("$.providerID"), models.infer_provider(model)),
        ts=F.coalesce(times.timestamp_ms(at("$.time.created")), times.timestamp_ms(at("$.created")), F.lit(now_ms).cast("long")),
        input=count("$.tokens.input"), output=count("$.tokens.output"), cache_read=count("$.tokens.cache.read"), cache_write=count("$.tokens.cache.write"), reasoning=count("$.tokens.reasoning"),
        cost=F.coalesce(J.f64_value(at("$.cost")), F.lit(0.0)), key=F.coalesce(prefixed("opencode", text("$.id")), fallback_key),
    )


def opencode_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("opencode", f"{config.data}/opencode")


def opencode(spark: SparkSession, config: Config) -> DataFrame:
    roots = opencode_roots(spark, config)
    stored = sqlite.opencode_messages(spark, roots, config.only).withColumn("v", J.parse(F.col("data"))).filter("v IS NOT NULL")
    key = F.when((F.col("id") == "unknown") & (F.col("session_id") != ""), F.col("session_id")).otherwise(F.col("id"))
    from_db = opencode_rows(stored, config.now_ms, key)
    legacy = parsed(documents(spark, [f"{r}/storage/message" for r in roots], "*.json", config.only)).withColumn("root_ord", F.col("root_ord") + len(roots))
    return from_db.unionByName(opencode_rows(legacy, config.now_ms, stem(F.col("file"))))


# --- Gemini ------------------------------------------------------------------------------------

ENTRY = "struct<model:string,input:bigint,output:bigint,cache_read:bigint,reasoning:bigint>"


def gemini_stats(stats: Column, hint: Column) -> Column:
    """The messages of a stats object: one a model, by name; else one for the hint."""

    zero = F.lit(0).cast("long")

    def numbers(model: Column, value: Column) -> Column:
        def read(tokens: Column) -> Column:
            n = lambda *names: F.coalesce(J.first_i64(tokens, *[f"$.{x}" for x in names]), zero)
            return F.struct(
                model.alias("model"), n("prompt", "input_tokens", "prompt_tokens", "input").alias("raw"), n("candidates", "output", "output_tokens").alias("output"),
                n("cached", "cached_tokens").alias("cached"), n("thoughts", "thoughts_tokens", "reasoning", "reasoning_tokens").alias("reasoning"),
            )

        return J.let(F.coalesce(J.node(value, "$.tokens"), value), read)

    def entry(n: Column) -> Column:
        return F.struct(
            n["model"].alias("model"), F.greatest(J.saturating_subtract(n["raw"], n["cached"]), zero).alias("input"), F.greatest(n["output"], zero).alias("output"),
            F.greatest(n["cached"], zero).alias("cache_read"), F.greatest(n["reasoning"], zero).alias("reasoning"),
        )

    def entries(each: Column) -> Column:
        return F.transform(F.filter(each, lambda n: (n["raw"] != 0) | (n["output"] != 0) | (n["cached"] != 0) | (n["reasoning"] != 0)), entry)

    none = F.expr(f"cast(array() as array<{ENTRY}>)")
    by_model = F.try_variant_get(stats, "$.models", "map<string,variant>")
    named = J.let(by_model, lambda m: entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: numbers(k, F.element_at(m, k)))))
    single = F.when(hint.isNotNull(), entries(F.array(numbers(hint, stats)))).otherwise(none)
    found = J.let(F.coalesce(named, none), lambda e: F.when(F.size(e) > 0, e))
    return F.when(stats.isNull(), none).otherwise(F.coalesce(found, single))


def gemini_fields(v: Column, hint: Column) -> tuple[Column, Column, dict]:
    """Whether ``v`` is a message, its model, and its tokens."""
    n = {k: J.non_negative(J.node(v, f"$.tokens.{k}")) for k in ("input", "output", "cached", "thoughts", "tool")}
    model = F.coalesce(J.string_value(J.node(v, "$.model")), hint)
    inclusive = n["input"] + n["output"] + n["thoughts"] + n["tool"]
    shared = (n["cached"] > 0) & F.coalesce(J.i64_value(J.node(v, "$.tokens.total")) == inclusive, F.lit(False))
    fresh = F.when(shared, n["input"] - F.least(n["cached"], n["input"])).otherwise(n["input"])
    ok = J.node(v, "$.tokens").isNotNull() & model.isNotNull()
    return ok, model, {"input": fresh + n["tool"], "output": n["output"], "cache_read": n["cached"], "reasoning": n["thoughts"]}


def gemini_ts(v: Column) -> Column:
    return F.coalesce(times.timestamp_ms(J.first_present(v, "$.timestamp", "$.created_at")), F.col("mtime_ms"))


def gemini_lines(spark: SparkSession, roots: list[str], stop: bool = False, only: DataFrame | None = None) -> DataFrame:
    rows = parsed(lines(spark, roots, "*.jsonl", stop, only))
    upto = Window.partitionBy("file").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, -1)
    hint = F.last(text("$.model"), True).over(upto)
    session = F.coalesce(F.last(J.string_value(J.first_present(F.col(V), "$.session_id", "$.sessionId")), True).over(upto), stem(F.col("file")))
    rows = rows.withColumns({"hint": hint, "session": session, "direct": F.coalesce(J.raw_string(at("$.type")) == "gemini", F.lit(False))})
    ok, model, tokens = gemini_fields(F.col(V), F.col("hint"))
    rows = rows.withColumns({"ok": F.col("direct") & ok, "model": model, "key": F.when(F.col("direct"), prefixed("gemini", text("$.id"))), "stats": F.when(~F.col("direct"), gemini_stats(J.first_present(F.col(V), "$.stats", "$.result.stats"), F.col("hint")))})
    rows = rows.withColumns({f"t_{k}": c for k, c in tokens.items()}).withColumn("ts", gemini_ts(F.col(V)))
    # what is out before a line: stats entries, unkeyed messages, and keys seen for the first time
    first = F.row_number().over(Window.partitionBy("file", "key", "ok").orderBy("block", "pos")) == 1
    emitted = F.when(F.col("ok") & (F.col("key").isNull() | first), 1).when(~F.col("direct"), F.size("stats")).otherwise(0)
    rows = rows.withColumn("emitted", emitted).withColumn("out", F.coalesce(F.sum("emitted").over(before), F.lit(0)))
    direct = messages(
        rows.filter("ok"), "gemini", model=F.col("model"), provider=F.lit("google"), ts=F.col("ts"), **{k: F.col(f"t_{k}") for k in tokens}, key=F.col("key"), keep=("file", "session", "out"),
    )
    merged = stateful.replace_in_place(direct)
    merged = merged.withColumn("dedup_key", F.coalesce("dedup_key", prefixed("gemini", F.col("session"), F.col("out")))).drop("file", "session", "out")
    return merged.unionByName(gemini_entries(rows.filter(~F.col("direct"))))


def gemini_entries(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", F.posexplode("stats").alias("i", "e"))
    e = lambda k: F.col(f"e.{k}")
    return messages(rows, "gemini", model=e("model"), provider=F.lit("google"), ts=F.col("mtime_ms"), input=e("input"), output=e("output"), cache_read=e("cache_read"), reasoning=e("reasoning"), index=F.col("i"))


def gemini_documents(spark: SparkSession, roots: list[str], only: DataFrame | None = None) -> DataFrame:
    rows = parsed(documents(spark, roots, "*.json", only))
    many = J.is_array(at("$.messages"))
    many = F.coalesce(many, F.lit(False))
    none = F.lit(None).cast("string")
    each = rows.filter(many).select("*", F.posexplode(F.try_variant_get(V, "$.messages", "array<variant>")).alias("i", "m")).filter(J.raw_string(at("$.type", "m")) == "gemini")
    one_ok, _, _ = gemini_fields(F.col(V), none)
    single = rows.filter(~many & one_ok).withColumns({"i": F.lit(0), "m": F.col(V)})
    found = each.unionByName(single)
    ok, model, tokens = gemini_fields(F.col("m"), none)
    made = messages(found.filter(ok), "gemini", model=model, provider=F.lit("google"), ts=gemini_ts(F.col("m")), **tokens, index=F.col("i"))
    rest = rows.filter(~many & ~one_ok).withColumn("stats", gemini_stats(J.first_present(F.col(V), "$.stats", "$.result.stats"), text("$.model")))
    return made.unionByName(gemini_entries(rest))


def gemini_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("gemini", f"{config.home}/.gemini/tmp")


def gemini(spark: SparkSession, config: Config) -> DataFrame:
    roots = gemini_roots(spark, config)
    return gemini_lines(spark, roots, config.stop_at_bad_line, config.only).unionByName(gemini_documents(spark, roots, config.only))


# --- Copilot, Amp, Droid -------------------------------------------------------------------------


def attribute(*names: str) -> list[str]:
    return [f"$.attributes['{n}']" for n in names]


def copilot_ts(v: Column) -> Column:
    """The first of five keys that holds [seconds, nanoseconds] decides; else plain timestamps."""
    out = F
    for key in ("endTime", "startTime", "hrTime", "_hrTime", "time"):
        pair = J.node(v, f"$.{key}")
        sec, nanos = J.i64_value(J.node(pair, "$[0]")), F.coalesce(J.i64_value(J.node(pair, "$[1]")), F.lit(0).cast("long"))
        out = out.when(F.coalesce(J.is_array(pair), F.lit(False)), J.saturating_multiply(sec, F.lit(1000).cast("long")) + F.call_function("div", nanos, F.lit(1_000_000)))
    unix = J.i64_value(J.node(v, "$.timeUnixNano"))
    return out.otherwise(F.coalesce(times.first_timestamp(v, "$.timestamp", "$.observedTimestamp"), F.when(unix > 0, F.call_function("div", unix, F.lit(1_000_000)))))


def copilot_roots(spark: SparkSession, config: Config) -> list[str]:
    """The usual folder, and the file or folder that an exporter is told to write."""
    return config.of("copilot", f"{config.home}/.copilot/otel") + config.of("copilot_exporter")


def copilot(spark: SparkSession, config: Config) -> DataFrame:
    rows = parsed(numbered(lines(spark, copilot_roots(spark, config), "*.jsonl", config.stop_at_bad_line, config.only))).filter(at("$.attributes").isNotNull())
    zero = F.lit(0).cast("long")
    n = lambda *names: F.coalesce(J.first_i64(F.col(V), *attribute(*names)), zero)
    s = lambda *names: J.first_string(F.col(V), *attribute(*names))
    read, raw = F.greatest(n("gen_ai.usage.cache_read.input_tokens"), zero), F.greatest(n("gen_ai.usage.input_tokens"), zero)
    model = F.coalesce(s("gen_ai.response.model", "gen_ai.request.model"), F.lit("unknown"))
    session = F.coalesce(s("gen_ai.conversation.id", "copilot_chat.session_id", "gen_ai.response.id", "session.id"), F.lit("unknown-session"))
    rows = rows.withColumn("ts", F.coalesce(copilot_ts(F.col(V)), F.col("mtime_ms")))
    trace, span = J.first_string(F.col(V), "$.traceId", "$.spanContext.traceId"), J.first_string(F.col(V), "$.spanId", "$.spanContext.spanId")
    made = messages(
        rows, "copilot", model=model, provider=models.infer_provider(model), ts=F.col("ts"), input=raw - F.least(read, raw), output=F.greatest(n("gen_ai.usage.output_tokens"), zero), cache_read=read,
        cache_write=F.greatest(n("gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens"), zero),
        reasoning=F.greatest(n("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens"), zero),
        key=F.coalesce(prefixed("copilot", trace, span), prefixed("copilot", session, F.col("ts"), F.col("line_no"))),
    )
    return positive(made)


def amp_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("amp", f"{config.data}/amp/threads")


def amp(spark: SparkSession, config: Config) -> DataFrame:
    """A thread's ledger if it gives any message, else its assistant messages."""
    rows = parsed(documents(spark, amp_roots(spark, config), "T-*.json", config.only))
    rows = rows.withColumns({"created": F.coalesce(J.i64_value(at("$.created")), F.col("mtime_ms")), "thread": F.coalesce(text("$.id"), stem(F.col("file")))})
    has_model = lambda e: J.string_value(J.node(e, "$.model")).isNotNull()
    rows = rows.withColumn("events", F.try_variant_get(V, "$.usageLedger.events", "array<variant>"))
    rows = rows.withColumn("ledger", F.coalesce(F.exists("events", has_model), F.lit(False)))
    led = rows.filter("ledger").select("*", F.posexplode("events").alias("i", "e")).filter(has_model(F.col("e")))
    model = text("$.model", "e")
    ledger = messages(
        led, "amp", model=model, provider=models.infer_provider(model), ts=F.coalesce(times.timestamp_ms(at("$.timestamp", "e")), F.col("created")),
        input=count("$.tokens.input", "e"), output=count("$.tokens.output", "e"), cache_read=count("$.tokens.cacheReadInputTokens", "e"), cache_write=count("$.tokens.cacheCreationInputTokens", "e"),
        cost=F.coalesce(J.f64_value(at("$.credits", "e")), F.lit(0.0)), key=prefixed("amp", F.col("thread"), F.lit("ledger"), F.col("i")), index=F.col("i"),
    )
    said = rows.filter(~F.col("ledger")).select("*", F.posexplode(F.try_variant_get(V, "$.messages", "array<variant>")).alias("i", "m"))
    model = text("$.usage.model", "m")
    said = said.filter((J.raw_string(at("$.role", "m")) == "assistant") & model.isNotNull())
    number = F.coalesce(J.i64_value(at("$.messageId", "m")), F.lit(0).cast("long"))
    return ledger.unionByName(messages(
        said, "amp", model=model, provider=models.infer_provider(model), ts=J.saturating_add(F.col("created"), J.saturating_multiply(number, F.lit(1000).cast("long"))),
        input=count("$.usage.inputTokens", "m"), output=count("$.usage.outputTokens", "m"), cache_read=count("$.usage.cacheReadInputTokens", "m"), cache_write=count("$.usage.cacheCreationInputTokens", "m"),
        cost=F.coalesce(J.f64_value(at("$.usage.credits", "m")), F.lit(0.0)), key=prefixed("amp", F.col("thread"), F.lit("message"), number), index=F.col("i"),
    ))


def droid_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("droid", f"{config.home}/.factory/sessions")


def droid(spark: SparkSession, config: Config) -> DataFrame:
    rows = parsed(documents(spark, droid_roots(spark, config), "*.settings.json", config.only)).filter(at("$.tokenUsage").isNotNull())
    provider = F.coalesce(text("$.providerLock"), models.infer_provider(text("$.model")), F.lit("unknown"))
    provider = F.when(text("$.providerLock").isNull() & text("$.model").isNull(), F.lit("unknown")).otherwise(provider)
    model = F.coalesce(models.normalize_settings_model(text("$.model")), models.default_model(provider))
    use = "$.tokenUsage."
    return messages(
        rows, "droid", model=model, provider=provider, ts=F.coalesce(times.timestamp_ms(at("$.providerLockTimestamp")), F.col("mtime_ms")),
        input=count(use + "inputTokens"), output=count(use + "outputTokens"), cache_read=count(use + "cacheReadTokens"), cache_write=count(use + "cacheCreationTokens"), reasoning=count(use + "thinkingTokens"),
        key=prefixed("droid", stem(F.col("file"))),
    )


# --- Hermes, Grok, Omp ---------------------------------------------------------------------------


def hermes_roots(spark: SparkSession, config: Config) -> list[str]:
    return config.of("hermes", f"{config.home}/.hermes")


def hermes(spark: SparkSession, config: Config) -> DataFrame:
    rows = sqlite.hermes_sessions(spark, hermes_roots(spark, config), config.only)
    ts = F.coalesce(times.normalize_epoch_ms_double(F.col("started_at")), times.normalize_epoch_ms_double(F.col("ended_at")), F.col("mtime_ms"))
    cost = F.when(F.col("actual_cost_usd") > 0, F.col("actual_cost_usd")).when(F.col("estimated_cost_usd") > 0, F.col("estimated_cost_usd")).otherwise(0.0)
    n = lambda c: F.greatest(F.col(c), F.lit(0))
    return messages(
        rows, "hermes", model=F.col("model"), provider=models.billing_provider(F.col("billing_provider"), F.col("model")), ts=ts, input=n("input_tokens"), output=n("output_tokens"),
        cache_read=n("cache_read_tokens"), cache_write=n("cache_write_tokens"), reasoning=n("reasoning_tokens"), cost=cost, key=prefixed("hermes", F.col("id")), count=F.greatest("message_count", F.lit(1)),
    )


UNKNOWN_MODEL = "grok-unknown"
GROK_MODEL = ("$.params.update.content._meta.modelId", "$.params.update._meta.modelId", "$.params._meta.modelId", "$.params.modelId", "$.model_id", "$.modelId", "$.model")
GROK_TOTAL = ("$.params._meta.totalTokens", "$.params.update._meta.totalTokens", "$.params.update.totalTokens", "$.params.totalTokens", "$.usage.totalTokens", "$.totalTokens")
GROK_TIME = ("$.params._meta.agentTimestampMs", "$.params.update._meta.agentTimestampMs", "$.params.timestamp", "$.timestamp", "$.ts")


def grok_roots(spark: SparkSession, config: Config) -> list[str]:
    return [f"{h}/sessions" for h in config.of("grok", f"{config.home}/.grok")]


def grok(spark: SparkSession, config: Config) -> DataFrame:
    roots = grok_roots(spark, config)
    rows = parsed(lines(spark, roots, "updates.jsonl", config.stop_at_bad_line, config.only)).withColumn("dir", parent(F.col("file")))
    beside = lambda name: parsed(documents(spark, roots, name, config.only)).withColumn("dir", parent(F.col("file")))
    summary = beside("summary.json").select("dir", J.first_string(F.col(V), "$.current_model_id", "$.model_id").alias("s_model"), times.first_timestamp(F.col(V), "$.updated_at", "$.created_at", "$.last_active_at").alias("s_ms"))
    journal = parsed(numbered(lines(spark, roots, "events.jsonl", config.stop_at_bad_line, config.only))).filter("line_no < 500").withColumn("dir", parent(F.col("file")))
    journal = journal.withColumns({"m": J.first_string(F.col(V), "$.model_id", "$.modelId"), "t": times.first_timestamp(F.col(V), "$.ts", "$.timestamp")})
    # the journal is read up to the line that names a model
    known = F.min(F.when(F.col("m").isNotNull(), F.col("line_no"))).over(Window.partitionBy("dir"))
    journal = journal.withColumn("known", known).filter("known IS NULL OR line_no <= known").groupBy("dir").agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("line_no"))).alias("j_model"), F.max_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("j_ms"))
    first_used = F.when(J.is_array(at("$.modelsUsed")), J.string_value(at("$.modelsUsed[0]")))
    present = at("$.contextTokensUsed").isNotNull()
    signals = beside("signals.json").select("dir", F.coalesce(text("$.primaryModelId"), first_used).alias("g_model"), count("$.totalTokens").alias("total"), count("$.totalTokensBeforeCompaction").alias("before"), F.when(present, count("$.contextTokensUsed")).alias("context"))
    # each line is parsed once: sessions, turns, totals and last models are made of these few fields
    rows = stored(rows.select(
        "dir", "file", "root_ord", "mtime_ms", "block", "pos", F.coalesce(J.raw_string(at("$.params.update.sessionUpdate")) == "user_message_chunk", F.lit(False)).alias("opens"),
        J.first_i64(F.col(V), *GROK_TOTAL).alias("total"), J.first_string(F.col(V), *GROK_MODEL).alias("model"), times.first_timestamp(F.col(V), *GROK_TIME).alias("own_ms"),
    ), "grok-lines").withColumn("path_key", path_key(F.col("file")))
    sessions = rows.groupBy("dir").agg(F.first("file").alias("file"), F.first("root_ord").alias("root_ord"), F.first("path_key").alias("path_key"), F.max("mtime_ms").alias("mtime_ms"))
    sessions = sessions.join(summary, "dir", "left").join(journal, "dir", "left").join(signals.select("dir", "g_model"), "dir", "left")
    sessions = sessions.select(
        "dir", "root_ord", "path_key", F.coalesce("s_model", "j_model", "g_model").alias("known_model"),
        F.coalesce(F.when(F.col("s_model").isNull(), F.col("j_ms")), F.col("s_ms"), F.col("mtime_ms")).alias("session_ms"),
        F.coalesce(F.nullif(F.trim(folder(F.col("file"), 1)), F.lit("")), F.lit("unknown")).alias("session"), F.coalesce(F.nullif(F.trim(folder(F.col("file"), 2)), F.lit("")), F.lit("unknown")).alias("workspace"),
    )
    rows = rows.join(sessions.select("dir", "known_model", "session_ms"), "dir")
    steps = rows.select(
        "dir", F.struct("block", "pos").alias("ord"), "opens", "total", "model",
        F.coalesce("own_ms", "session_ms").alias("timestamp_ms"), F.coalesce("known_model", F.lit(UNKNOWN_MODEL)).alias("fallback_model"),
    )
    turns = stateful.turn_segments(steps, ["dir"])
    last_model = steps.groupBy("dir").agg(F.coalesce(F.max_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))), F.first("fallback_model")).alias("last_model"))
    extra = stateful.signals_remainder(turns, signals.join(sessions.select("dir", "session_ms", "known_model"), "dir").join(last_model, "dir"), ["dir"])
    extra = extra.select("dir", F.lit(None).cast("int").alias("turn"), F.coalesce("g_model", "known_model", "last_model").alias("model"), F.col("extra").alias("delta"), "timestamp_ms")
    every = turns.drop("ord").unionByName(extra).join(sessions, "dir").withColumns({"block": F.lit(0).cast("long"), "pos": F.coalesce(F.col("turn"), F.lit(2**31 - 1)).cast("long")})
    key = prefixed("grok", F.col("workspace"), F.col("session"), F.coalesce(F.col("turn").cast("string"), F.lit("signals")))
    return messages(every, "grok", model=F.col("model"), provider=F.lit("xai"), ts=F.col("timestamp_ms"), input=F.col("delta"), output=F.lit(0), key=key)


def omp_roots(spark: SparkSession, config: Config) -> list[str]:
    return [f"{h}/sessions" for h in config.of("omp", f"{config.home}/.omp/agent")]


def omp(spark: SparkSession, config: Config) -> DataFrame:
    roots = omp_roots(spark, config)
    rows = parsed(lines(spark, roots, "*.jsonl", config.stop_at_bad_line, config.only))
    rows = rows.filter((J.raw_string(at("$.type")) == "message") & (J.raw_string(at("$.message.role")) == "assistant") & at("$.message.usage").isNotNull())
    bucket = folder(F.col("file"), 1)
    scope = F.when(~bucket.startswith("-") & bucket.contains("_"), F.concat(bucket, F.lit("/"), stem(F.col("file")))).otherwise(stem(F.col("file")))
    use = "$.message.usage."
    made = messages(
        rows, "omp", model=F.coalesce(text("$.message.model"), F.lit("unknown")), provider=models.routing_provider(text("$.message.provider")),
        ts=F.coalesce(times.timestamp_ms(at("$.message.timestamp")), times.timestamp_ms(at("$.timestamp")), F.col("mtime_ms")),
        input=count(use + "input"), output=count(use + "output"), cache_read=count(use + "cacheRead"), cache_write=count(use + "cacheWrite"), cost=F.coalesce(J.f64_value(at(use + "cost.total")), F.lit(0.0)),
        key=F.coalesce(prefixed("omp", text("$.message.responseId")), prefixed("omp", scope, text("$.id"))),
    )
    return positive(made)


#: The registry: name to source, in client order. Adding an entry adds a client.
SOURCES = {"claude": claude, "codex": codex, "cursor": cursor, "opencode": opencode, "gemini": gemini, "copilot": copilot, "amp": amp, "droid": droid, "hermes": hermes, "grok": grok, "omp": omp}


def collect(spark: SparkSession, config: Config, clients: list[str] | None = None) -> DataFrame:
    """All messages of the chosen clients, before dedup. Sources that aren't chosen are never read."""
    out = None
    for name, source in SOURCES.items():
        if clients is None or name in clients:
            rows = source(spark, config)
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no such clients: {clients}")
    return out


@dataclass(frozen=True)
class Reads:
    """What a source reads: names under its roots, and the unit whose files are only meaningful together."""

    roots: Callable[[SparkSession, Config], list[str]]
    globs: tuple[str, ...]
    unit: Callable[[Column], Column] = lambda file: file
    recursive: bool = True


#: A database and its write-ahead log, a session's folder, a cache's files are units; elsewhere each file is.
READS = {
    "claude": Reads(claude_roots, ("*.{jsonl,json}",)),
    "codex": Reads(codex_roots, ("*.jsonl",)),
    "cursor": Reads(cursor_roots, ("events.json", "{usage.csv,usage.*.csv}"), lambda file: F.lit("cache")),
    "opencode": Reads(opencode_roots, ("{opencode.db,opencode-*.db,opencode.db-wal,opencode-*.db-wal}", "*.json"), lambda file: F.regexp_replace(file, "-wal$", "")),
    "gemini": Reads(gemini_roots, ("*.{jsonl,json}",)),
    "copilot": Reads(copilot_roots, ("*.jsonl",)),
    "amp": Reads(amp_roots, ("T-*.json",)),
    "droid": Reads(droid_roots, ("*.settings.json",)),
    "hermes": Reads(hermes_roots, ("{state.db,state.db-wal}",), lambda file: F.regexp_replace(file, "-wal$", ""), recursive=False),
    "grok": Reads(grok_roots, ("{updates.jsonl,events.jsonl,summary.json,signals.json}",), parent),
    "omp": Reads(omp_roots, ("*.jsonl",)),
}


def ingest(spark: SparkSession, config: Config, path: str, clients: list[str] | None = None) -> DataFrame:
    """The messages of the chosen clients through a table at ``path``; a later call reads only what changed (see ``ingest.Facts``)."""
    from .ingest import Facts

    facts = Facts(spark, path)
    facts.update(config, clients)
    return facts.read(clients)


__all__ = ["READS", "SOURCES", "Config", "collect", "existing", "ingest"]
