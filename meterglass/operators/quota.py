"""Limit windows from captured provider responses, and what views pick from them.

A response is a VARIANT ``v``; ``now_ms`` is the clock. Windows are arrays of structs: label,
used_percent, remaining_percent, resets_at (RFC 3339) and reset_text. Fetching responses and
holding credentials is not part of this library.
"""

from __future__ import annotations

import json
import math
import struct
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json as J
from ..functions import labels
from ..functions import time as times
from ..functions.format import clamp_percent

WINDOW = "struct<label:string,used_percent:double,remaining_percent:double,resets_at:string,reset_text:string>"
NONE = f"cast(array() as array<{WINDOW}>)"
STALE_CARRY_S = 24 * 3600
WARN_PERCENT = 80
WEEK_S = 604_800
#: Providers whose windows a plan title may show, in order.
PLAN_PROVIDERS = ("codex", "claude", "grok", "cursor")
ALWAYS_SHOWN = ("codex", "claude", "gemini", "grok")


def number(v: Column, path: str) -> Column:
    return J.f64_value(J.node(v, path))


def window(label: Column, used: Column, reset_ms: Column, now_ms: Column, note: Column | None = None) -> Column:
    """A window, or null without a finite percentage."""
    finite = used.isNotNull() & ~F.isnan(used) & (F.abs(used) < float("inf"))
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), used))
    made = F.struct(
        label.alias("label"), clamped.alias("used_percent"), F.greatest(F.lit(0.0), F.lit(100.0) - (used if note is not None else clamped)).alias("remaining_percent"),
        times.rfc3339_text(reset_ms).alias("resets_at"), (times.reset_text(now_ms, reset_ms) if note is None else note).alias("reset_text"),
    )
    return F.when(finite, made.cast(WINDOW))


def present(*windows: Column) -> Column:
    return F.filter(F.array(*windows), lambda w: w.isNotNull())


def codex_window(label: Column, v: Column, now_ms: Column) -> Column:
    reset = J.i64_value(J.node(v, "$.reset_at"))
    return F.when(v.isNotNull(), window(label, F.coalesce(number(v, "$.used_percent"), F.lit(0.0)), F.when(reset > 0, reset * 1000), now_ms))


def codex_windows(v: Column, now_ms: Column) -> Column:
    """Session and weekly (swapped if the first is the weekly one), extra limits by new labels, monthly spend."""
    first, second = J.node(v, "$.rate_limit.primary_window"), J.node(v, "$.rate_limit.secondary_window")
    weekly = lambda w: F.coalesce(J.i64_value(J.node(w, "$.limit_window_seconds")) == WEEK_S, F.lit(False))
    swap = weekly(first) & ~weekly(second)
    base = present(codex_window(F.lit("Session"), F.when(swap, second).otherwise(first), now_ms), codex_window(F.lit("Weekly"), F.when(swap, first).otherwise(second), now_ms))
    extras = F.try_variant_get(v, "$.additional_rate_limits", "array<variant>")

    def extra(x: Column) -> Column:
        label = labels.extra_limit_label(J.raw_string(J.node(x, "$.limit_name")), J.raw_string(J.node(x, "$.metered_feature")))
        return codex_window(label, J.first_present(x, "$.rate_limit.primary_window", "$.rate_limit.secondary_window"), now_ms)

    found = F.filter(F.transform(extras, extra), lambda w: w.isNotNull())
    names = F.transform(found, lambda w: w["label"])
    fresh = F.filter(found, lambda w, i: (F.array_position(names, w["label"]) == i + 1) & ~w["label"].isin("Session", "Weekly"))
    spend = "$.spend_control.individual_limit"
    used, total = number(v, f"{spend}.used"), number(v, f"{spend}.limit")
    percent = F.coalesce(number(v, f"{spend}.used_percent"), F.lit(100.0) - number(v, f"{spend}.remaining_percent"), F.when(total > 0, used / F.when(total > 0, total) * 100))
    reset = J.i64_value(J.node(v, f"{spend}.reset_at"))
    return F.concat(base, F.coalesce(fresh, F.expr(NONE)), present(window(F.lit("Monthly spend"), percent, F.when(reset > 0, reset * 1000), now_ms)))


#: Labels in order, with the names under which responses hold them.
CLAUDE_LIMITS = (
    ("Session", ("five_hour",)),
    ("Weekly", ("seven_day",)),
    ("OAuth Apps", ("seven_day_oauth_apps",)),
    ("Sonnet", ("seven_day_sonnet",)),
    ("Opus", ("seven_day_opus",)),
    ("Designs", ("seven_day_design", "seven_day_claude_design", "claude_design", "design", "seven_day_omelette", "omelette", "omelette_promotional")),
    ("Daily Routines", ("seven_day_routines", "seven_day_claude_routines", "claude_routines", "routines", "routine", "seven_day_cowork", "cowork")),
)


def solid(v: Column) -> Column:
    """A node that is there and no JSON null."""
    return F.when(J.written(v) != "null", v)


def claude_windows(v: Column, now_ms: Column) -> Column:
    named = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(*[solid(J.node(v, f"$.{n}")) for n in names]).alias("limit")) for label, names in CLAUDE_LIMITS])

    def of(limit: Column) -> Column:
        reset = J.let(J.raw_string(J.node(limit["limit"], "$.resets_at")), times.rfc3339_ms)
        return J.let(reset, lambda at: window(limit["label"], number(limit["limit"], "$.utilization"), at, now_ms))

    limits = F.filter(F.transform(named, of), lambda w: w.isNotNull())
    extra = "$.extra_usage"
    used, cap = number(v, f"{extra}.used_credits"), number(v, f"{extra}.monthly_limit")
    money = J.raw_string(J.node(v, f"{extra}.currency"))
    note = F.concat(F.lit("Monthly cap: "), labels.minor_units(used, money), F.lit(" / "), labels.minor_units(cap, money))
    percent = F.coalesce(number(v, f"{extra}.utilization"), F.when(cap > 0, used / F.when(cap > 0, cap) * 100))
    spent = F.when(F.try_variant_get(v, f"{extra}.is_enabled", "boolean"), window(F.lit("Extra usage"), percent, F.lit(None).cast("long"), now_ms, note))
    return F.concat(limits, present(spent))


def claude_credits(v: Column) -> Column:
    left = (number(v, "$.extra_usage.monthly_limit") - number(v, "$.extra_usage.used_credits")) / 100
    return F.when(F.try_variant_get(v, "$.extra_usage.is_enabled", "boolean"), F.greatest(left, F.lit(0.0)))


def cursor_windows(v: Column, now_ms: Column, plan: str = "$.planUsage", end: str = "$.billingCycleEnd") -> Column:
    """One window a model pool; a combined one only where no pool is reported."""
    text = F.trim(J.raw_string(J.node(v, end)))
    reset = F.coalesce(times.rfc3339_ms(text), text.try_cast("bigint"))
    pools = present(window(F.lit("Cursor Models"), number(v, f"{plan}.autoPercentUsed"), reset, now_ms), window(F.lit("Other Models"), number(v, f"{plan}.apiPercentUsed"), reset, now_ms))
    limit = number(v, f"{plan}.limit")
    used = F.coalesce(number(v, f"{plan}.used"), limit - number(v, f"{plan}.remaining"))
    total = F.coalesce(number(v, f"{plan}.totalPercentUsed"), F.when(limit > 0, used / F.when(limit > 0, limit) * 100))
    return F.when(F.size(pools) > 0, pools).otherwise(present(window(F.lit("Monthly"), total, reset, now_ms)))


def cursor_credits(v: Column, plan: str = "$.planUsage") -> Column:
    """Dollars left; a missing or zero limit reports nothing."""
    limit = number(v, f"{plan}.limit")
    left = F.coalesce(number(v, f"{plan}.remaining"), limit - number(v, f"{plan}.used"))
    return F.when(limit > 0, F.greatest(left / 100, F.lit(0.0)))


def grok_plan(v: Column) -> Column:
    """The tier of the first active subscription."""
    active = F.filter(F.try_variant_get(v, "$.subscriptions", "array<variant>"), lambda s: F.coalesce(labels.is_active(J.raw_string(J.node(s, "$.status"))), F.lit(False)))
    return labels.tier_label(J.raw_string(J.node(F.get(active, F.lit(0)), "$.tier")))


# --- responses without a fixed shape: small parsers behind Pandas UDFs ---------------------------

METRIC = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("used_percent", T.DoubleType()), T.StructField("remaining_percent", T.DoubleType()), T.StructField("remaining_label", T.StringType()), T.StructField("resets_at", T.StringType())]))


def _number(x):
    if isinstance(x, bool):
        return None
    if isinstance(x, (int, float, str)):
        try:
            return n if math.isfinite(n := float(x)) else None
        except (ValueError, OverflowError):
            return None
    if isinstance(x, dict):
        return _number(x["val"] if "val" in x else x.get("value"))
    return None


def _reach(x, *path):
    for p in path:
        x = x.get(p) if isinstance(x, dict) else None
    return x


def _first(values):
    return next((x for x in values if x is not None), None)


def _moment(seconds) -> str | None:
    """Epoch seconds as text; None beyond the calendar."""
    try:
        return datetime.fromtimestamp(int(seconds), timezone.utc).isoformat()
    except (OverflowError, ValueError, OSError):
        return None


def _when(x):
    """A period bound: text as it is, or epoch seconds."""
    if isinstance(x, str):
        return x
    n = _number(x)
    return None if n is None else _moment(n)


def _cycle(start, end) -> str:
    try:
        days = int((datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds() // 86400)
    except (TypeError, ValueError):
        return "Credits"
    return "Weekly" if 6 <= days <= 8 else "Monthly" if 27 <= days <= 33 else "Credits"


def _objects(doc):
    """Every object of a document, parents before children, in order; a stack, as documents may be deep."""
    waiting = [doc]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            yield x
            waiting.extend(reversed(x.values()))
        elif isinstance(x, list):
            waiting.extend(reversed(x))


#: Where a limit, what was used of it, a share of it and the period stand.
LIMIT = (("monthlyLimit",), ("config", "monthlyLimit"))
USED = (("usage", "totalUsed"), ("totalUsed",), ("config", "usage", "totalUsed"))
SHARE = (("usedPercent",), ("usagePercent",), ("creditUsagePercent",))
PERIOD_START = (("billingCycle", "billingPeriodStart"), ("billingPeriodStart",))
PERIOD_END = (("billingCycle", "billingPeriodEnd"), ("billingPeriodEnd",))
TASKS = (("Tasks", "usage", "limit"), ("Frequent", "frequentUsage", "frequentLimit"), ("Occasional", "occasionalUsage", "occasionalLimit"))
RESETS = ("resetTime", "resetsAt", "resetAt")


def _number_at(x, paths):
    return _first(_number(_reach(x, *p)) for p in paths)


def _bill(x):
    """The metric of an object that states a used share of its budget, else None."""
    limit, used = _number_at(x, LIMIT), _number_at(x, USED)
    priced = limit is not None and used is not None
    percent = (used / limit * 100 if limit > 0 else None) if priced else _number_at(x, SHARE)
    if percent is None:
        return None
    start, end = (_when(_first(_reach(x, *p) for p in paths)) for paths in (PERIOD_START, PERIOD_END))
    percent = min(100.0, max(0.0, percent))
    left = f"${max(0.0, limit - used) / 100:.2f}/${limit / 100:.2f} left" if priced else None
    return _cycle(start, end), percent, 100 - percent, left, end


def _counts(x):
    """The metrics of an object's task limits."""
    reset = _first(x[k] for k in RESETS if isinstance(x.get(k), str))
    for label, used, limit in TASKS:
        most = _number(x.get(limit))
        if most is not None and most > 0:
            n = min(most, max(0.0, _number(x.get(used)) or 0.0))
            percent = min(100.0, n / most * 100)
            yield label, percent, 100 - percent, f"{most - n:.0f}/{most:.0f} left", reset


def _metrics(text: str | None):
    """The first bill, then every task limit at any depth; what is the same to four decimals counts once."""
    try:
        doc = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return []
    bill = _first(_bill(x) for x in _objects(doc))
    found = []
    for m in (m for x in _objects(doc) for m in _counts(x)):
        if not any(m[0] == o[0] and abs(m[1] - o[1]) < 1e-4 and m[3] == o[3] for o in found):
            found.append(m)
    return ([bill] if bill else []) + found


@F.pandas_udf(METRIC)
def grok_metrics(text: pd.Series) -> pd.Series:
    """Billing and task metrics of a JSON response of any shape."""
    return text.map(lambda t: [dict(zip(METRIC.elementType.names, m)) for m in _metrics(t)])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value & (1 << 64) - 1, at
        shift += 7
        if shift > 63:
            raise ValueError("varint")


def _fields(data: bytes):
    """(number, wire type, value) of each protobuf field."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("wire type")
        if at > len(data):
            raise ValueError("short")
        yield key >> 3, wire, value


def _seconds(data: bytes) -> str | None:
    return _first(_moment(v) for n, w, v in _fields(data) if n == 1 and w == 0)


def _config(data: bytes):
    """A billing config: field 1 the percentage (absent: 0 if a period is there), 4 and 5 the period."""
    percent = start = end = None
    for n, wire, v in _fields(data):
        if n == 1 and wire == 5:
            p = struct.unpack("<f", v)[0]
            percent = min(100.0, max(0.0, p)) if math.isfinite(p) else percent
        elif n == 4 and wire == 2:
            start = _seconds(v)
        elif n == 5 and wire == 2:
            end = _seconds(v)
    if percent is None and start is None and end is None:
        return None
    return (_cycle(start, end), percent or 0.0, 100 - (percent or 0.0), None, end)


def _framed(body: bytes | None):
    """The first billing config in length-prefixed frames; trailers (flag 0x80) are skipped."""
    at = 0
    try:
        while body and at + 5 <= len(body):
            flag, size = body[at], int.from_bytes(body[at + 1 : at + 5], "big")
            at += 5 + size
            if at > len(body):
                return None
            if not flag & 0x80:
                for n, wire, v in _fields(body[at - size : at]):
                    if n == 1 and wire == 2 and (found := _config(v)):
                        return found
    except (ValueError, IndexError):
        return None
    return None


@F.pandas_udf(METRIC)
def grok_frame_metrics(body: pd.Series) -> pd.Series:
    """The billing metric of a framed protobuf response."""
    return body.map(lambda b: [dict(zip(METRIC.elementType.names, m))] if (m := _framed(b)) else [])


def metric_windows(metrics: Column, now_ms: Column) -> Column:
    return F.transform(metrics, lambda m: F.struct(
        m["label"].alias("label"), m["used_percent"].alias("used_percent"), m["remaining_percent"].alias("remaining_percent"), m["resets_at"].alias("resets_at"),
        F.coalesce(m["remaining_label"], times.reset_text(now_ms, times.rfc3339_ms(m["resets_at"]))).alias("reset_text"),
    ))


# --- snapshots -----------------------------------------------------------------------------------


def checked(snapshots: DataFrame) -> DataFrame:
    """Fills ``error`` where a provider that must report windows reports none.

    ``snapshots``: client_id, source, updated_at, windows, credits, plan, error, stale.
    """
    empty = F.size("windows") == 0
    lacks = F.when(F.col("client_id").isin("claude", "cursor"), empty).when(F.col("client_id") == "codex", empty & F.col("credits").isNull()).when(F.col("client_id") == "grok", empty & F.col("plan").isNull()).otherwise(False)
    return snapshots.withColumn("error", F.coalesce("error", F.when(lacks, F.lit("no limit data"))))


def carry_stale(now: DataFrame, before: DataFrame, now_ms: int) -> DataFrame:
    """Failed snapshots without windows take the last good ones of under a day, flagged and with the new error."""
    age = F.lit(now_ms) - times.rfc3339_ms(F.col("updated_at"))
    good = before.filter((F.size("windows") > 0) & (age < STALE_CARRY_S * 1000))
    old = good.select("client_id", *[F.col(c).alias(f"_{c}") for c in good.columns if c != "client_id"])
    take = F.col("error").isNotNull() & (F.size("windows") == 0) & F.col("_windows").isNotNull()
    joined = now.join(old, "client_id", "left")
    columns = {c: F.when(take, F.col(f"_{c}")).otherwise(F.col(c)) for c in now.columns if c not in ("client_id", "error", "stale")}
    return joined.withColumns({**columns, "stale": F.when(take, F.lit(True)).otherwise(F.col("stale"))}).select(*now.columns)


def opted_in(snapshots: DataFrame, cursor: bool) -> DataFrame:
    """Without the opt-in to read its usage, Cursor's snapshots are not shown at all."""
    return snapshots if cursor else snapshots.filter(~F.col("client_id").eqNullSafe("cursor"))


def latest_payload(payloads: DataFrame) -> DataFrame:
    """Of payloads (generated_at, payload) the newest; older ones never replace it."""
    return payloads.agg(F.max_by("payload", times.rfc3339_ms(F.col("generated_at"))).alias("payload"))


def exploded(snapshots: DataFrame) -> DataFrame:
    """client_id, agent_ord, window_ord and the window's fields."""
    order = F.coalesce(*[F.when(F.col("client_id") == c, F.lit(i)) for i, c in enumerate(PLAN_PROVIDERS)], F.lit(len(PLAN_PROVIDERS)))
    return snapshots.select("client_id", order.alias("agent_ord"), F.posexplode("windows").alias("window_ord", "w")).select("client_id", "agent_ord", "window_ord", "w.*")


def most_constrained(windows: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Of each key the window nearest its cap, the earliest of equals."""
    row = F.struct(*[F.col(c) for c in windows.columns if c not in keys])
    best = windows.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col("used_percent"), F.col("agent_ord"), F.col("window_ord"))).alias("_w"))
    return best.select(*keys, "_w.*")


def first_by_label(windows: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Windows of one label count once, the first."""
    w = Window.partitionBy(*keys, "label").orderBy("window_ord")
    return windows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pick_window(snapshots: DataFrame, provider: str = "auto", label: str = "") -> DataFrame:
    """The window a plan title shows, at most one row."""
    rows = exploded(snapshots).filter(F.col("client_id").isin(*PLAN_PROVIDERS)).withColumn("_all", F.lit(1))
    if provider != "auto":
        rows = rows.filter(F.col("client_id") == provider)
        pinned = F.min(F.when(F.col("label") == label, F.col("window_ord"))).over(Window.partitionBy("_all"))
        rows = rows.withColumn("_pin", pinned).filter("_pin IS NULL OR window_ord = _pin").drop("_pin")
    return most_constrained(rows, ("_all",)).drop("_all")


def plan_title(picked: DataFrame, mode: str = "used") -> DataFrame:
    """One row, ``title``: Claude 42%, a warning from 80 on, a dash if nothing was picked."""
    used = clamp_percent(F.col("used_percent"))
    head = F.concat(F.when(used >= WARN_PERCENT, "⚠ ").otherwise(""), labels.display_name(F.col("client_id")), F.lit(" "))
    share = F.concat(clamp_percent(F.col("remaining_percent")).cast("string"), F.lit("% left")) if mode == "left" else F.concat(used.cast("string"), F.lit("%"))
    return picked.agg(F.coalesce(F.max(F.concat(head, share)), F.lit("—")).alias("title"))


def tile_status(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """client_id and status: Stale, Error, the source, Live or No quota."""
    joined = snapshots.join(live.select(F.col("client").alias("client_id"), F.lit(True).alias("_live")).distinct(), "client_id", "left")
    status = (
        F.when(F.coalesce("stale", F.lit(False)), F.lit("Stale")).when(F.col("error").isNotNull(), F.lit("Error"))
        .when(F.size("windows") > 0, F.upper("source")).when(F.col("_live"), F.lit("Live")).otherwise("No quota")
    )
    return joined.select("client_id", status.alias("status"))


def visible_clients(listed: DataFrame, snapshots: DataFrame, unlisted: bool = True) -> DataFrame:
    """client_id and place: listed clients (client, ord) that have a tile, once, then other agents."""
    known = snapshots.select(F.col("client_id").alias("client"), F.lit(True).alias("_known")).distinct()
    first = listed.groupBy("client").agg(F.min("ord").alias("ord")).join(known, "client", "left").filter(F.col("_known") | F.col("client").isin(*ALWAYS_SHOWN)).select("client", F.lit(0).alias("_part"), "ord")
    rest = exploded_order(snapshots).join(first, "client", "left_anti").select("client", F.lit(1).alias("_part"), "ord")
    rows = first.unionByName(rest) if unlisted else first
    return rows.select(F.col("client").alias("client_id"), (F.row_number().over(Window.orderBy("_part", "ord")) - 1).alias("place"))


def exploded_order(snapshots: DataFrame) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("client_id") == c, F.lit(i)) for i, c in enumerate(PLAN_PROVIDERS)], F.lit(len(PLAN_PROVIDERS)))
    return snapshots.groupBy(F.col("client_id").alias("client")).agg(F.min(order).alias("ord"))


def tray_title(mode: str, stats: dict | None = None, today: dict | None = None, tokens_per_min: str | None = None, plan: str | None = None) -> str:
    """What the tray shows, from values that one-row queries gave: formatted strings by name."""
    if mode == "hidden":
        return ""
    if mode == "plan_percent":
        return plan or "—"
    if stats is None:
        return ""
    if mode == "tokens_per_min":
        return f"{tokens_per_min or '—'}/m"
    which, field = mode.split("_", 1)
    empty = {"tokens": "0", "cost": "$0.00"}
    return ((today or {}) if which == "today" else stats).get(field, empty[field])
