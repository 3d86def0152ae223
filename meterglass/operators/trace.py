"""Live views over usage events: trailing-window totals, rates and traces.

An event has ts_ms, client, agent, model, input, output, cache_read, cache_write and key. The
clock is always an argument. Events after it count, as they do in the window's definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.models import CLIENTS, live_client
from .rollup import long_sum

RETENTION_S = 3600
SHORT_WINDOW_S, LONG_WINDOW_S = 60, 600


def event_tokens() -> Column:
    """Four kinds; reasoning plays no part in live views."""
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")


def in_window(events: DataFrame, now_ms: int | Column, seconds: int) -> DataFrame:
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return events.filter(F.col("ts_ms") >= now - seconds * 1000)


def merged(events: DataFrame) -> DataFrame:
    """Repeats of a key become the first event with the maximum of each token field; events without key stay."""
    keyed = events.filter("key IS NOT NULL").groupBy("key").agg(
        *[F.min_by(c, "ord").alias(c) for c in ("ts_ms", "client", "agent", "model")],
        *[F.max(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        F.min("ord").alias("ord"),
    )
    return events.filter("key IS NULL").unionByName(keyed)


def retained(events: DataFrame, now_ms: int) -> DataFrame:
    return in_window(events, now_ms, RETENTION_S)


def window_tokens(events: DataFrame, now_ms: int, seconds: int) -> DataFrame:
    return in_window(events, now_ms, seconds).agg(F.coalesce(long_sum(event_tokens()), F.lit(0)).alias("tokens"))


def rate(events: DataFrame, now_ms: int, seconds: int = SHORT_WINDOW_S) -> DataFrame:
    """Tokens a minute over the window, as a 32-bit float; 0 for windows of 0 seconds or less."""
    if seconds <= 0:
        return events.sparkSession.createDataFrame([(0.0,)], "tokens_per_min float")
    return window_tokens(events, now_ms, seconds).select((F.col("tokens") / F.lit(seconds / 60)).cast("float").alias("tokens_per_min"))


#: Seconds of a pane.
PANE_S = 5


def panes(events: DataFrame) -> DataFrame:
    """tokens and messages of each client, agent, model and pane of ``PANE_S`` seconds, numbered from the epoch."""
    pane = F.floor(F.col("ts_ms") / (PANE_S * 1000)).cast("long")
    return events.groupBy(pane.alias("pane"), "client", "agent", "model").agg(long_sum(event_tokens()).alias("tokens"), F.count(F.lit(1)).alias("messages"))


def sliding(sums: DataFrame, seconds: int = LONG_WINDOW_S) -> DataFrame:
    """pane, tokens, messages and tokens_per_min of every window of ``seconds`` that ends with a pane, wherever a window's sum changes.

    A pane's sums enter at the pane and leave a window later, so a window is a difference of running
    sums: two rows a pane are shuffled, however long the window is.
    """
    n, keys = seconds // PANE_S, ("client", "agent", "model")
    steps = F.array(F.struct(F.col("pane").alias("pane"), F.lit(1).alias("sign")), F.struct((F.col("pane") + n).alias("pane"), F.lit(-1).alias("sign")))
    moves = sums.select(*keys, "tokens", "messages", F.explode(steps).alias("m")).groupBy(*keys, F.col("m.pane").alias("pane")).agg(*[F.sum(F.col(c) * F.col("m.sign")).alias(c) for c in ("tokens", "messages")])
    upto = Window.partitionBy(*keys).orderBy("pane").rowsBetween(Window.unboundedPreceding, 0)
    found = moves.select(*keys, "pane", *[F.sum(c).over(upto).alias(c) for c in ("tokens", "messages")])
    return found.withColumn("tokens_per_min", (F.col("tokens") / F.lit(seconds / 60)).cast("float"))


def trace(events: DataFrame, now_ms: int, seconds: int = LONG_WINDOW_S) -> DataFrame:
    """A row for each client, agent and model: tokens, messages, tokens a minute."""
    minutes = max(seconds / 60, 1 / 60)
    found = in_window(events, now_ms, seconds).groupBy("client", "agent", "model").agg(long_sum(event_tokens()).alias("tokens"), F.count(F.lit(1)).alias("messages"))
    return found.withColumn("tokens_per_min", (F.col("tokens") / F.lit(minutes)).cast("float"))


def sorted_trace(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("tokens"), "client", "agent", "model")


def collapse(rows: DataFrame) -> DataFrame:
    """A row a client: sums, the agents and models joined; unknown models only where there is no other.

    ``seen`` is the place of its first row in the trace's order, which decides between equal clients.
    """
    models = F.array_sort(F.collect_set("model"))
    rows = rows.withColumn("_seen", F.struct((-F.col("tokens")).alias("less"), "client", "agent", "model"))
    grouped = rows.withColumn("client", live_client(F.col("client"))).groupBy("client").agg(
        F.sum("tokens").alias("tokens"), F.sum("messages").alias("messages"), F.sum(F.col("tokens_per_min").cast("double")).alias("tokens_per_min"),
        F.array_join(F.array_sort(F.collect_set("agent")), ", ").alias("agents"), models.alias("_models"), F.min("_seen").alias("seen"),
    )
    known = F.filter("_models", lambda m: m != "unknown")
    return grouped.withColumn("models", F.array_join(F.when(F.size("_models") > 1, known).otherwise(F.col("_models")), ", ")).drop("_models")


def top(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n largest rows of ``collapse``, with each one's share of the largest (bar percent) and of all tokens."""
    all_tokens = rows.agg(F.sum("tokens").alias("all_tokens"))
    first = rows.orderBy(F.desc("tokens"), "seen").limit(n).drop("seen")
    most = F.max("tokens").over(Window.partitionBy())
    return first.withColumn("bar_percent", F.when(most > 0, F.greatest(F.lit(4.0), F.col("tokens") / most * 100)).otherwise(0.0)).crossJoin(F.broadcast(all_tokens))


def live_clients(rows: DataFrame) -> DataFrame:
    return rows.filter("tokens_per_min > 0").select(live_client(F.col("client")).alias("client")).distinct()


def registry(spark: SparkSession) -> DataFrame:
    """The clients that the dashboard knows: id, place, name and colour. A row for each; the table doesn't grow."""
    known = [*CLIENTS, *(c for c in labels.COLORS if c not in CLIENTS)]
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("client"), F.lit(i).alias("place")) for i, c in enumerate(known)]))
    return spark.range(1).select(rows).select("client", "place", labels.display_name(F.col("client")).alias("name"), labels.client_color(F.col("client")).alias("color"))


def styled(rows: DataFrame) -> DataFrame:
    """Live rows with ``registry_id``, ``place``, ``name`` and ``color`` of their client in the registry.

    A live id is matched by its dashboard id (claude-code and claude are one). A client that the
    registry lacks keeps its id, has no place, a name made of its id and the common colour; a null
    client has neither place nor name.
    """
    known = registry(rows.sparkSession).select(F.col("client").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("place", "name", "color")])
    own = F.col("registry_id")
    joined = rows.withColumn("registry_id", live_client(F.col("client"))).join(F.broadcast(known), own == F.col("_id"), "left")
    return joined.withColumns(
        {"place": F.col("_place"), "name": F.coalesce("_name", labels.display_name(own)), "color": F.coalesce("_color", F.lit(labels.OTHER_COLOR))}
    ).drop("_id", "_place", "_name", "_color")


def idle_clients(rows: DataFrame) -> DataFrame:
    """The registry's clients that no live row has, in its order's places."""
    return registry(rows.sparkSession).join(rows.select(live_client(F.col("client")).alias("client")).distinct(), "client", "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per session and field the growth, never negative; sessions new in ``after`` count in full."""
    fields = ("input", "output", "cache_read", "cache_write")
    old = before.select("session_id", *[F.col(f).alias(f"_{f}") for f in fields])
    grown = after.join(old, "session_id", "left").select("session_id", *[F.greatest(F.col(f) - F.coalesce(F.col(f"_{f}"), F.lit(0)), F.lit(0)).alias(f) for f in fields])
    return grown.filter(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write") > 0)


def high_water_deltas(rows: DataFrame, keys: list[str], order: list[str], total: str) -> DataFrame:
    """Rows whose cumulative total exceeds all before it, with the growth; the first total only seeds."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_mark", F.max(total).over(before))
    return seen.filter(F.col(total) > F.col("_mark")).withColumn("delta", F.col(total) - F.col("_mark")).drop("_mark")
