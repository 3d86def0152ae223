"""Numbers and dates as views show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K"))
WIDE = "decimal(38,0)"


def one_decimal(n: Column, unit: int) -> Column:
    """n / unit to one place, ties by the exact binary value of the quotient (upwards if it is exact)."""
    step = unit // 10
    tenths = F.call_function("div", n, F.lit(step))
    rest = n % step
    quotient = n.cast("double") / F.lit(float(unit))
    whole = F.floor(quotient).cast("double")
    # the quotient times 2^52, exactly: whole and fraction each fit a long
    scaled = whole.cast(WIDE) * F.lit(2**52).cast(WIDE) + ((quotient - whole) * F.lit(float(2**52))).cast("long").cast(WIDE)
    not_below = scaled * F.lit(unit).cast(WIDE) >= n.cast(WIDE) * F.lit(2**52).cast(WIDE)
    up = F.when(rest * 2 == step, not_below).otherwise(rest * 2 > step)
    rounded = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.call_function("div", rounded, F.lit(10)).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def humanize_tokens(n: Column) -> Column:
    """999, 1.0K, 1.9M, 43.7B, 1.5T."""
    n = n.cast("long")
    out = n.cast("string")
    for unit, name in reversed(UNITS):
        out = F.when(n >= unit, F.concat(one_decimal(n, unit), F.lit(name))).otherwise(out)
    return out


def format_cost(usd: Column) -> Column:
    """$1,234.57, half away from zero on the shortest decimal form."""
    return F.concat(F.lit("$"), F.format_number(F.round(usd.cast("decimal(28,10)"), 2), 2))


def clamp_percent(p: Column) -> Column:
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), p)) + 0.5).cast("long")


def short_date(d: Column) -> Column:
    """Jan 5."""
    return F.date_format(d, "MMM d")


def month_day(d: Column) -> Column:
    """01/05."""
    return F.date_format(d, "MM/dd")


def animation_load(rate: Column) -> Column:
    """Percent of a full load of a million tokens a minute."""
    return F.least(F.lit(100.0), rate / 10000)


def animation_interval_ms(load: Column) -> Column:
    return (F.lit(500.0) / F.greatest(F.lit(1.0), load / 5)).cast("long")


def share_of(tokens: Column, most: Column) -> Column:
    """Where all is idle the most counts as 1."""
    return tokens / F.greatest(most, F.lit(1))


def tile_height(tokens: Column, most: Column) -> Column:
    return F.lit(0.05) + F.pow(share_of(tokens, most), F.lit(0.6)) * 4.0


def color_ratio(tokens: Column, most: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(share_of(tokens, most), F.lit(0.5))))


def bar_percent(value: Column, most: Column) -> Column:
    """A bar's width: at least 4 percent, 0 where nothing is."""
    return F.when(most > 0, F.greatest(F.lit(4.0), value / most * 100)).otherwise(0.0)
