"""Lenient field access over VARIANT: each log line is parsed once, each field coerced on its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX, INT_MIN = 9223372036854775807, -9223372036854775808


def let(value: Column, f) -> Column:
    """f(value) with the value evaluated once: coercions name it often, and plans would grow with every copy."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parse(text: Column) -> Column:
    """The line as VARIANT, or null if it isn't JSON."""
    return F.try_parse_json(F.trim(text))


def node(v: Column, path: str) -> Column:
    """The value at ``path`` ($.a.b or $['a.b']) as VARIANT; null where it is missing."""
    return F.try_variant_get(v, path, "variant")


def written(v: Column) -> Column:
    """A scalar as JSON text: strings start with a quote, numbers with a digit or a minus."""
    return F.to_json(v)


def is_string(v: Column) -> Column:
    return written(v).startswith('"')


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_number(v: Column) -> Column:
    return written(v).rlike("^-?[0-9]")


def is_integer(v: Column) -> Column:
    return written(v).rlike("^-?[0-9]+$")


def raw_string(v: Column) -> Column:
    """Strings as they stand; anything else is null."""
    return let(v, lambda v: F.when(is_string(v), F.try_variant_get(v, "$", "string")))


def string_value(v: Column) -> Column:
    """A trimmed non-empty string, or a number written out; else null."""
    return let(v, lambda v: F.when(written(v).rlike('^["0-9-]'), F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit(""))))


def saturating_long(d: Column) -> Column:
    """Truncates towards zero and clamps to 64 bits."""
    return F.when(d >= 9.223372036854775e18, F.lit(INT_MAX)).when(d <= -9.223372036854775e18, F.lit(INT_MIN)).otherwise(d.cast("long"))


def beyond(text: Column) -> Column:
    """Numbers that are no 64-bit integer: up to 2^64 they wrap, others are truncated and clamped."""
    big = text.try_cast("decimal(20,0)")
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    wraps = text.rlike("^[0-9]+$") & (big < two64)
    return F.when(wraps, (big - two64).cast("long")).otherwise(saturating_long(text.try_cast("double")))


def i64_value(v: Column) -> Column:
    """Integers as they are (beyond 63 bits they wrap), other numbers truncated and clamped, numeric strings; else null."""
    return let(written(v), lambda j: F.coalesce(F.trim(F.translate(j, '"', "")).try_cast("bigint"), F.when(j.rlike("^-?[0-9]"), beyond(j))))


def f64_value(v: Column) -> Column:
    """Any number, or a numeric string; else null."""
    return F.trim(F.translate(written(v), '"', "")).try_cast("double")


def non_negative(v: Column) -> Column:
    return F.greatest(F.coalesce(i64_value(v), F.lit(0).cast("long")), F.lit(0).cast("long"))


def first_i64(v: Column, *paths: str) -> Column:
    """The first path whose value is a number."""
    return F.coalesce(*[i64_value(node(v, p)) for p in paths])


def first_string(v: Column, *paths: str) -> Column:
    return F.coalesce(*[string_value(node(v, p)) for p in paths])


def first_present(v: Column, *paths: str) -> Column:
    """The first path that is there at all, JSON null included: a null blocks those after it."""
    return F.coalesce(*[node(v, p) for p in paths])


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.when(b > 0, F.lit(INT_MAX)).otherwise(F.lit(INT_MIN)))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), F.when(b < 0, F.lit(INT_MAX)).otherwise(F.lit(INT_MIN)))


def saturating_multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.when((a > 0) == (b > 0), F.lit(INT_MAX)).otherwise(F.lit(INT_MIN)))
