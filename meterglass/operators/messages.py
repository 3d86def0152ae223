"""The fact table: first-wins dedup, validity, provider and cost.

A message row has client, model_id, provider_id, timestamp_ms, date, input, output, cache_read,
cache_write, reasoning, cost, messages, dedup_key and ``ord``, an array of longs or strings
whose order is the input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models, pricing

TOKENS = ("input", "output", "cache_read", "cache_write", "reasoning")
KEY = ("client", "model_id", "provider_id", "timestamp_ms", "input", "output", "cache_read", "cache_write")


def total_tokens() -> Column:
    """All five kinds, as a decimal so that no sum overflows, clamped to 64 bits."""
    total = sum((F.greatest(F.col(t), F.lit(0)).cast("decimal(20,0)") for t in TOKENS[1:]), F.greatest(F.col(TOKENS[0]), F.lit(0)).cast("decimal(20,0)"))
    return F.least(total, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def content_key() -> Column:
    return F.coalesce("dedup_key", F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY]))


def first_wins(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key. min_by keeps one row a key and task, so a hot key shuffles little."""
    columns = df.columns
    packed = F.struct(*[F.col(c) for c in columns])
    first = df.groupBy(key.alias("_key")).agg(F.min_by(packed, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def dedup(df: DataFrame) -> DataFrame:
    return first_wins(df, content_key(), ["ord"])


def valid(df: DataFrame) -> DataFrame:
    """Only after dedup: a row without tokens may win its key and take the group with it."""
    return df.filter((F.col("timestamp_ms") > 0) & (total_tokens() > 0))


def with_provider(df: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("provider_id", F.lit(""))) == ""
    return df.withColumn("provider_id", F.when(blank, models.infer_provider(F.col("model_id"))).otherwise(F.col("provider_id")))


def with_cost(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fills costs that logs lack. ``keep``: price columns to keep."""
    cost = F.when(F.col("cost") <= 0, pricing.estimated_cost(*[F.col(t) for t in TOKENS])).otherwise(F.col("cost"))
    return pricing.with_prices(df).withColumn("cost", cost).select(*df.columns, *keep)


def enriched(df: DataFrame, year: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Dedup, then validity, then provider, cost and the year filter, in this order: one shuffle."""
    out = with_cost(with_provider(valid(dedup(df))), keep)
    return by_year(out, year)


def check_year(year: str | None) -> str | None:
    """'' and None are all years; else four digits."""
    plain = (year or "").strip()
    if not plain:
        return None
    if len(plain) != 4 or not (plain.isascii() and plain.isdigit()):
        raise ValueError(f"invalid year filter: {year}")
    return plain


def by_year(df: DataFrame, year: str | None) -> DataFrame:
    year = check_year(year)
    return df.filter(F.col("date").startswith(f"{year}-")) if year else df
