"""Statistics for views: stats, streaks, calendar grid and trailing bars over the daily client rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import once
from .rollup import long_sum, money_sum


def spine(start: Column, end: Column, name: str = "day") -> DataFrame | Column:
    """Every date from start to end; nothing where the range is inverted (sequence would count down)."""
    return F.explode(F.when(start <= end, F.sequence(start, end)).otherwise(F.expr("cast(array() as array<date>)"))).alias(name)


def day(text: Column) -> Column:
    return text.try_cast("date")


def per_day(daily_client: DataFrame, clients: DataFrame | list[str] | None = None) -> DataFrame:
    """date, tokens, cost of the selected clients; days with neither are skipped."""
    if isinstance(clients, DataFrame):
        daily_client = daily_client.join(clients.select("client").distinct(), "client", "left_semi")
    elif clients is not None:
        daily_client = daily_client.filter(F.col("client").isin(*clients)) if clients else daily_client.limit(0)
    out = daily_client.groupBy("date").agg(long_sum(F.col("tokens")).alias("tokens"), money_sum(F.col("cost")).alias("cost"))
    return out.filter((F.col("tokens") != 0) | (F.col("cost") != 0))


def islands(days: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of consecutive days: keys, first, last, length. ``days``: keys and a distinct date ``day``."""
    order = Window.partitionBy(*keys).orderBy("day")
    anchored = days.withColumn("_anchor", F.date_sub("day", F.row_number().over(order)))
    return anchored.groupBy(*keys, "_anchor").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).cast("int").alias("length")).drop("_anchor")


def streaks(per_day: DataFrame, start: Column, end: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, longest_streak and current_streak: the run that ends on the range's last day, 0 if that day is idle.

    ``start`` and ``end`` are dates (columns of ``per_day`` or literals); an inverted or missing
    range gives 0 and 0.
    """
    active = per_day.select(*keys, day(F.col("date")).alias("day"), F.col("tokens"), start.alias("_from"), end.alias("_to"))
    active = active.filter((F.col("tokens") > 0) & F.col("day").between(F.col("_from"), F.col("_to"))).select(*keys, "day", "_to").distinct()
    runs = islands(active, (*keys, "_to"))
    found = runs.groupBy(*keys).agg(F.max("length").alias("longest_streak"), F.coalesce(F.max(F.when(F.col("last") == F.col("_to"), F.col("length"))), F.lit(0)).alias("current_streak"))
    if keys:
        every = per_day.select(*keys).distinct()
        found = every.join(found, list(keys), "left")
        return found.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("longest_streak", "current_streak")])
    return found.select(F.coalesce("longest_streak", F.lit(0)).alias("longest_streak"), "current_streak")


def stats(daily_client: DataFrame, clients: list[str] | None = None) -> DataFrame:
    """One row: totals, best day (dearest, earliest of equals), average, most tokens, streaks, present clients of all."""
    daily_client = once(daily_client)
    chosen = per_day(daily_client, clients)
    range_ = daily_client.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    totals = chosen.agg(
        F.coalesce(long_sum(F.col("tokens")), F.lit(0)).alias("total_tokens"), F.coalesce(money_sum(F.col("cost")), F.lit(0.0)).alias("total_cost"),
        F.count(F.lit(1)).cast("int").alias("active_days"), F.coalesce(F.max("tokens"), F.lit(0)).alias("max_tokens"),
        F.min_by("date", F.struct(-F.col("cost"), F.col("date"))).alias("best_day"), F.max("cost").alias("best_cost"),
    )
    best = F.col("best_cost") > 0
    totals = totals.withColumns({"best_day": F.when(best, F.col("best_day")), "best_cost": F.when(best, F.col("best_cost"))})
    totals = totals.withColumn("average_per_day", F.when(F.col("active_days") > 0, F.col("total_cost") / F.greatest(F.col("active_days"), F.lit(1))).otherwise(0.0))
    present = daily_client.filter((F.col("tokens") > 0) | (F.col("cost") > 0)).agg(F.array_sort(F.collect_set("client")).alias("present_clients"))
    runs = streaks(chosen.crossJoin(F.broadcast(range_)), day(F.col("start")), day(F.col("end")))
    # every side is one row
    return totals.crossJoin(F.broadcast(range_)).crossJoin(F.broadcast(present)).crossJoin(F.broadcast(runs))


def grid_columns(year: int) -> tuple[str, int]:
    """The Sunday on or before January 1 and the number of week columns (53, or 54 where the year needs it)."""
    from datetime import date, timedelta

    first = date(year, 1, 1)
    start = first - timedelta(days=(first.weekday() + 1) % 7)
    return start.isoformat(), max(53, (date(year, 12, 31) - start).days // 7 + 1)


def calendar_grid(per_day: DataFrame, year: int) -> DataFrame:
    """col, row (0 is Sunday), date, in_year, active, tokens, cost: one row a cell."""
    start, columns = grid_columns(year)
    cells = per_day.sparkSession.range(columns * 7).select(
        F.call_function("div", F.col("id"), F.lit(7)).cast("int").alias("col"), (F.col("id") % 7).cast("int").alias("row"), F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("_day")
    )
    facts = per_day.select(day(F.col("date")).alias("_day"), "tokens", "cost")
    tokens, cost = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("cost", F.lit(0.0))
    in_year = F.year("_day") == year
    return cells.join(facts, "_day", "left").select("col", "row", F.date_format("_day", "yyyy-MM-dd").alias("date"), in_year.alias("in_year"), (in_year & (tokens > 0)).alias("active"), tokens.alias("tokens"), cost.alias("cost"))


def day_bars(daily_client: DataFrame, clients: list[str] | None = None) -> DataFrame:
    """date, total_tokens, total_cost and the segments of each client, sorted; empty parts are dropped first."""
    rows = daily_client.filter((F.col("tokens") > 0) | (F.col("cost") > 0))
    if clients is not None:
        rows = rows.filter(F.col("client").isin(*clients)) if clients else rows.limit(0)
    parts = rows.groupBy("date", "client").agg(long_sum(F.col("tokens")).alias("tokens"), money_sum(F.col("cost")).alias("cost"))
    return parts.groupBy("date").agg(
        long_sum(F.col("tokens")).alias("total_tokens"), money_sum(F.col("cost")).alias("total_cost"), F.array_sort(F.collect_list(F.struct("client", "tokens", "cost"))).alias("segments")
    )


def trailing_bars(bars: DataFrame, end: str, days: int = 30) -> DataFrame:
    """The ``days`` days up to ``end``, idle ones as empty bars; none for days of 0 or less."""
    spark = bars.sparkSession
    if days <= 0:
        return bars.limit(0)
    spine_ = spark.range(days).select(F.date_format(F.date_sub(F.lit(end).cast("date"), (F.lit(days - 1) - F.col("id")).cast("int")), "yyyy-MM-dd").alias("date"))
    empty = F.expr("cast(array() as array<struct<client:string,tokens:bigint,cost:double>>)")
    return spine_.join(bars, "date", "left").select("date", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), F.coalesce("segments", empty).alias("segments"))


def tabs(daily_client: DataFrame, quota_clients: DataFrame) -> DataFrame:
    """Clients of either side, once, sorted."""
    return daily_client.select("client").union(quota_clients.select("client")).distinct().orderBy("client")
