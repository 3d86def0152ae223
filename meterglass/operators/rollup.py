"""Daily, client and year rollups, the summary and the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import once
from .messages import TOKENS, total_tokens

MONEY = "decimal(28,10)"
LONG_MAX = 2**63 - 1


def long_sum(c: Column) -> Column:
    """A sum clamped to 64 bits; null where there is nothing to sum."""
    total = F.sum(c.cast("decimal(38,0)"))
    return F.when(total > LONG_MAX, F.lit(LONG_MAX)).otherwise(total.cast("long"))


def money_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(c.cast(MONEY)).cast("double")


def token_sums() -> list[Column]:
    return [long_sum(F.greatest(F.col(t), F.lit(0))).alias(t) for t in TOKENS]


def daily_client(df: DataFrame) -> DataFrame:
    """The grain of all rollups: day, client, provider, model."""
    return df.groupBy("date", "client", "provider_id", "model_id").agg(
        *token_sums(), long_sum(total_tokens()).alias("tokens"), money_sum(F.col("cost")).alias("cost"), F.sum("messages").cast("long").alias("messages")
    )


def daily_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(
        *token_sums(), long_sum(total_tokens()).alias("tokens"), money_sum(F.col("cost")).alias("cost"), F.sum("messages").cast("long").alias("messages")
    )


def intensity(cost: Column, most: Column) -> Column:
    """0 to 4 by the share of the dearest day."""
    share = F.when(most > 0, cost / F.when(most > 0, most)).otherwise(0.0)
    return F.when(share >= 0.75, 4).when(share >= 0.5, 3).when(share >= 0.25, 2).when(share > 0, 1).otherwise(0)


def with_intensity(daily: DataFrame, cost: str = "cost") -> DataFrame:
    """The dearest day is one row, joined to all: no window over every day."""
    daily = once(daily)
    most = daily.agg(F.max(cost).alias("_most"))
    return daily.crossJoin(F.broadcast(most)).withColumn("intensity", intensity(F.col(cost), F.col("_most"))).drop("_most")


def contributions(df: DataFrame) -> DataFrame:
    """A row a day: totals, intensity, token kinds and the nested clients, sorted."""
    return contributions_of(daily_client(df))


def contributions_of(grain: DataFrame) -> DataFrame:
    """``contributions`` of a ``daily_client`` table."""
    nested = F.array_sort(F.collect_list(F.struct("client", "provider_id", "model_id", F.struct(*TOKENS).alias("tokens"), "cost", "messages")))
    days = grain.groupBy("date").agg(
        F.struct(long_sum(F.col("tokens")).alias("tokens"), money_sum(F.col("cost")).alias("cost"), F.sum("messages").alias("messages")).alias("totals"),
        F.struct(*[long_sum(F.col(t)).alias(t) for t in TOKENS]).alias("token_breakdown"),
        nested.alias("clients"),
    )
    days = once(days)
    most = days.agg(F.max("totals.cost").alias("_most"))
    return days.crossJoin(F.broadcast(most)).select("date", "totals", intensity(F.col("totals.cost"), F.col("_most")).alias("intensity"), "token_breakdown", "clients")


def summary(df: DataFrame) -> DataFrame:
    """One row: totals, days, average of active days, dearest day, clients and models. ``df``: messages or their ``daily_client``."""
    return summary_of(once(daily_client(df)))


def summary_of(grain: DataFrame) -> DataFrame:
    """``summary`` of a ``daily_client`` table, which is read twice."""
    days = daily_totals(grain).agg(
        long_sum(F.col("tokens")).alias("total_tokens"), money_sum(F.col("cost")).alias("total_cost"), F.count(F.lit(1)).cast("int").alias("total_days"),
        F.count_if(F.col("tokens") > 0).cast("int").alias("active_days"), F.coalesce(F.max("cost"), F.lit(0.0)).alias("max_cost_in_single_day"),
        F.coalesce(F.min("date"), F.lit("")).alias("start"), F.coalesce(F.max("date"), F.lit("")).alias("end"),
    )
    names = grain.agg(F.array_sort(F.collect_set("client")).alias("clients"), F.array_sort(F.collect_set("model_id")).alias("models"))
    average = F.when(F.col("active_days") > 0, F.col("total_cost") / F.when(F.col("active_days") > 0, F.col("active_days"))).otherwise(0.0)
    filled = days.withColumns({"total_tokens": F.coalesce("total_tokens", F.lit(0)), "total_cost": F.coalesce("total_cost", F.lit(0.0))})
    return filled.withColumn("average_per_day", average).crossJoin(F.broadcast(names))


def years(df: DataFrame) -> DataFrame:
    year = F.substring("date", 1, 4)
    return df.filter(F.length("date") >= 4).groupBy(year.alias("year")).agg(
        long_sum(total_tokens()).alias("total_tokens"), money_sum(F.col("cost")).alias("total_cost"), F.min("date").alias("start"), F.max("date").alias("end")
    )


def date_range(daily: DataFrame) -> DataFrame:
    return daily.agg(F.coalesce(F.min("date"), F.lit("")).alias("start"), F.coalesce(F.max("date"), F.lit("")).alias("end"))


def narrow(days: DataFrame, year: str | None) -> DataFrame:
    """Contributions of one year; intensities stay relative to all days."""
    from .messages import check_year

    year = check_year(year)
    return days.filter(F.col("date").startswith(f"{year}-")) if year else days


def payload(df: DataFrame, generated_at: str, version: str = "1") -> DataFrame:
    """One row, ``payload``: the whole document as JSON with camelCase names.

    A document for one reader: as many days as a calendar has, whatever the number of messages.
    All parts are made of one ``daily_client`` table.
    """
    grain = once(daily_client(df))

    clients = F.transform(
        "clients",
        lambda c: F.struct(
            c["client"].alias("client"), c["model_id"].alias("modelId"), c["provider_id"].alias("providerId"),
            F.struct(c["tokens"]["input"].alias("input"), c["tokens"]["output"].alias("output"), c["tokens"]["cache_read"].alias("cacheRead"), c["tokens"]["cache_write"].alias("cacheWrite"), c["tokens"]["reasoning"].alias("reasoning")).alias("tokens"),
            c["cost"].alias("cost"), c["messages"].alias("messages"),
        ),
    )
    b = "token_breakdown"
    day = F.struct(
        "date", "totals", "intensity",
        F.struct(F.col(f"{b}.input").alias("input"), F.col(f"{b}.output").alias("output"), F.col(f"{b}.cache_read").alias("cacheRead"), F.col(f"{b}.cache_write").alias("cacheWrite"), F.col(f"{b}.reasoning").alias("reasoning")).alias("tokenBreakdown"),
        clients.alias("clients"),
    )
    days = contributions_of(grain).agg(F.array_sort(F.collect_list(day)).alias("contributions"))
    by_year = years(grain).agg(F.array_sort(F.collect_list(F.struct("year", F.col("total_tokens").alias("totalTokens"), F.col("total_cost").alias("totalCost"), F.struct("start", "end").alias("range")))).alias("years"))
    one = summary_of(grain).select(
        F.struct(
            F.col("total_tokens").alias("totalTokens"), F.col("total_cost").alias("totalCost"), F.col("total_days").alias("totalDays"), F.col("active_days").alias("activeDays"),
            F.col("average_per_day").alias("averagePerDay"), F.col("max_cost_in_single_day").alias("maxCostInSingleDay"), "clients", "models",
        ).alias("summary"),
        F.struct(F.lit(generated_at).alias("generatedAt"), F.lit(version).alias("version"), F.struct("start", "end").alias("dateRange")).alias("meta"),
    )
    return one.crossJoin(F.broadcast(by_year)).crossJoin(F.broadcast(days)).select(F.to_json(F.struct("meta", "summary", "years", "contributions")).alias("payload"))
