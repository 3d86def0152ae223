"""Timestamps: epoch milliseconds everywhere, dates in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import json as J

#: Date, separator, time to the second, optional fraction, zone.
RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}):(\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

#: What most logs write, and Spark casts as it stands.
COMMON = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:[0-5]\d(\.\d{1,6})?Z$"


def rfc3339_ms(text: Column) -> Column:
    """Strict RFC 3339 (zone required) to milliseconds, fractions truncated, second 60 the next second; else null."""
    part = [F.regexp_extract(text, RFC3339, k) for k in range(1, 6)]
    leap = part[2] == "60"
    zone = F.upper(part[4])
    plain = F.concat(part[0], F.lit(" "), part[1], F.lit(":"), F.when(leap, "59").otherwise(part[2]), F.when(zone == "Z", "+00:00").otherwise(zone))
    whole = F.unix_seconds(plain.try_cast("timestamp")) * 1000 + F.when(leap, 1000).otherwise(0)
    fraction = F.rpad(F.substring(part[3], 2, 3), 3, "0").try_cast("long")
    parted = F.when(text.rlike(RFC3339) & (zone.rlike(r"^(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$")), whole + F.when(part[3] == "", 0).otherwise(fraction))
    return F.when(text.rlike(COMMON), F.unix_millis(text.try_cast("timestamp"))).otherwise(parted)


def normalize_epoch_ms(n: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds by magnitude, to milliseconds, truncated towards zero."""
    size = F.abs(n.cast("decimal(20,0)"))

    def truncated(k: int) -> Column:
        return F.call_function("div", n, F.lit(k))

    return F.when(size >= 10**17, truncated(1_000_000)).when(size >= 10**14, truncated(1000)).when(size >= 10**11, n).otherwise(n * 1000)


def normalize_epoch_ms_double(d: Column) -> Column:
    """As above for a positive finite double, rounded half away from zero; else null."""
    scaled = F.when(d >= 1e17, d / 1e6).when(d >= 1e14, d / 1e3).when(d >= 1e11, d).otherwise(d * 1e3)
    return F.when((d > 0) & (d < float("inf")) & ~F.isnan(d), F.floor(scaled + 0.5).cast("long"))


def timestamp_ms(v: Column) -> Column:
    """A VARIANT as milliseconds: RFC 3339 or untrimmed integer strings, integers, or truncated numbers."""

    def read(v: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        whole = F.when(J.is_string(v), F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))).when(J.is_number(v), J.i64_value(v))
        return F.coalesce(F.when(J.is_string(v), J.let(text, rfc3339_ms)), J.let(whole, normalize_epoch_ms))

    return J.let(v, read)


def first_timestamp(v: Column, *paths: str) -> Column:
    return F.coalesce(*[timestamp_ms(J.node(v, p)) for p in paths])


def date_or_zero_ms(text: Column) -> Column:
    """RFC 3339, or a plain date at noon UTC, else 0."""
    noon = F.concat(text, F.lit(" 12:00:00+00:00")).try_cast("timestamp")
    return F.coalesce(rfc3339_ms(text), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_millis(noon)), F.lit(0).cast("long"))


def local_date(ms: Column) -> Column:
    """yyyy-MM-dd in the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def diff_days(a: Column, b: Column) -> Column:
    """Days from timestamp b to timestamp a, to the nearest whole one, so that an hour of summer time counts for nothing."""
    return F.floor((F.unix_millis(a) - F.unix_millis(b)) / 86_400_000 + 0.5).cast("long")


def reset_text(now_ms: Column, then_ms: Column) -> Column:
    """Resets now / in Nm / in Nh Mm (to 47 h) / in Nd Hh, minutes rounded up, zero parts left out."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    seconds = div(then_ms - now_ms, 1000)
    minutes = div(seconds + 59, 60)
    hours, days = div(minutes, 60), div(minutes, 1440)

    def parts(big: Column, unit: str, small: Column, of: str) -> Column:
        return F.concat(F.lit("Resets in "), big.cast("string"), F.lit(unit), F.when(small > 0, F.concat(F.lit(" "), small.cast("string"), F.lit(of))).otherwise(""))

    return (
        F.when(then_ms.isNull(), F.lit(None).cast("string"))
        .when(seconds <= 0, F.lit("Resets now"))
        .when(minutes < 60, F.concat(F.lit("Resets in "), minutes.cast("string"), F.lit("m")))
        .when(hours < 48, parts(hours, "h", minutes % 60, "m"))
        .otherwise(parts(days, "d", hours % 24, "h"))
    )


def rfc3339_text(ms: Column) -> Column:
    """2023-11-14T22:13:20.000Z, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
