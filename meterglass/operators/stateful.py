"""Folds over one log file's rows in line order: merges, replacements, counters and turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUR = ("input", "output", "cache_read", "cache_write")


def max_merge(rows: DataFrame, file: str = "file", key: str = "dedup_key", order: str = "ord", fields=FOUR) -> DataFrame:
    """Rows of one key in a file become the first of them with each field's maximum; rows without key stay."""
    rest = [c for c in rows.columns if c not in (file, key, *fields)]
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(file, key).agg(
        *[F.min_by(c, order).alias(c) if c != order else F.min(c).alias(c) for c in rest], *[F.max(c).alias(c) for c in fields]
    )
    return rows.filter(F.col(key).isNull()).unionByName(keyed)


def replace_in_place(rows: DataFrame, file: str = "file", key: str = "dedup_key", order: str = "ord") -> DataFrame:
    """Of rows of one key in a file the last stays, at the first one's place; rows without key stay."""
    rest = [c for c in rows.columns if c not in (file, key, order)]
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(file, key).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias(order))
    return rows.filter(F.col(key).isNull()).unionByName(keyed.select(file, key, order, "_last.*"))


def forward_fill(value: Column, keys: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


# --- cumulative counters ---------------------------------------------------------------------

COUNTERS = ("input", "output", "cached", "reasoning")
#: A regressed total is taken for a late report, not a reset, if it is this close to the one before.
STALE_PERCENT = 98


class CounterFold:
    """State of one file: model, provider, last totals and what a fork inherited.

    Events are dicts with type (meta, turn, count), model, provider, forked, reported, total and
    last (tuples of COUNTERS, or None). ``step`` returns the tokens of a message, or None. A
    forked file starts with its parent's history: up to its first turn only totals are taken
    over, and a first count that repeats them is no message.
    """

    def __init__(self):
        self.model, self.provider = None, "openai"
        self.previous = None
        self.replaying = False
        self.inherited = (None, None)  # totals, and the total as reported

    def step(self, e: dict):
        kind = e["type"]
        if kind == "meta":
            self.provider = e["provider"] or self.provider
            if e["forked"]:
                self.replaying, self.inherited = True, (None, None)
        if self.replaying and kind == "count" and e["total"]:
            self.previous = e["total"]
            self.inherited = e["total"], e.get("reported")
        if kind == "turn":
            self.replaying = False
            self.model = e["model"] or self.model
        if self.replaying or kind != "count":
            return None
        if e["model"] and e["model"] != "unknown":
            self.model = e["model"]
        totals, reported = self.inherited
        self.inherited = (None, None)
        if e["total"] and (e["total"] == totals or reported is not None and e.get("reported") == reported):
            self.previous = e["total"]
            return None
        out, previous = self.increment(e["total"], e["last"])
        if out is None or out[0] + out[1] + out[3] <= 0:  # cached tokens are part of input
            return None
        self.previous = previous
        return out

    def increment(self, total, last):
        """Tokens to emit and the totals after them; None emits nothing."""
        before = self.previous
        if total and last and before:
            if total == before or (any(t < b for t, b in zip(total, before)) and self.late(total, last, before)):
                return None, before
            return last, total
        if total and last:
            return last, total
        if total and before:
            if total == before:
                return None, before
            if all(t >= b for t, b in zip(total, before)):
                return tuple(t - b for t, b in zip(total, before)), total
            self.previous = total
            return None, total
        if total:
            return total, total
        if last:
            return last, tuple(a + b for a, b in zip(before, last)) if before else None
        return None, before

    @staticmethod
    def late(total, last, before) -> bool:
        t, n, b = sum(total), sum(last), sum(before)
        return t > 0 and n > 0 and b > 0 and (t * 100 >= b * STALE_PERCENT or t + 2 * n >= b)


FOLD_SCHEMA = "file string, ord long, model string, provider string, input long, output long, cache_read long, reasoning long, timestamp_ms long"
FOLD_ARROW = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("model", pa.string()), ("provider", pa.string()), *[(c, pa.int64()) for c in ("input", "output", "cache_read", "reasoning", "timestamp_ms")]])


def counter_deltas(events: DataFrame) -> DataFrame:
    """Messages of cumulative counter logs: a true fold, streamed in line order within each file.

    ``events``: file, ord, type, model, provider, forked, timestamp_ms, total and last (structs of
    COUNTERS, null if absent), reported (the total as the log states it). Memory holds one state,
    however long a file is.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if state is None or e["file"] != file:
                    file, state = e["file"], CounterFold()
                for c in ("total", "last"):
                    e[c] = tuple(max(0, e[c][k] or 0) for k in COUNTERS) if e[c] else None
                got = state.step(e)
                if got:
                    cached = min(got[2], got[0])
                    out.append((file, e["ord"], e["model"] or state.model or "unknown", state.provider, got[0] - cached, got[1], cached, got[3], e["timestamp_ms"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOLD_ARROW.types)] if out else [pa.array([], t) for t in FOLD_ARROW.types], schema=FOLD_ARROW)

    return events.repartition("file").sortWithinPartitions("file", "ord").mapInArrow(fold, FOLD_SCHEMA)


# --- turns of a cumulative total -------------------------------------------------------------


def turn_segments(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Turns of a cumulative total by windows: keys, turn, model, delta, timestamp_ms, ord.

    ``rows``: keys, order, opens (a user message), total, model (null if the line names none),
    timestamp_ms, and ``fallback_model``. A total below the high-water mark is ignored. Growth
    before the first user message forms an implicit turn; a turn's model is the one known as it
    opens, or, if that is unknown, the first named while it is open or by the line that closes it. Files without any turn that
    grew give their last total as one row.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.when(F.col("total") >= 0, F.col("total"))
    known = F.coalesce(F.last("model", True).over(upto), F.col("fallback_model"))
    seen = rows.withColumns({
        "_known": known, "_mark": F.max(total).over(before), "_opened": F.sum(F.col("opens").cast("int")).over(upto),
    })
    # a line may open a turn and extend it
    seen = seen.withColumns({"_high": F.when(total >= F.coalesce(F.col("_mark"), F.lit(0)), total), "_grows": F.col("_mark").isNotNull() & (total > F.col("_mark")), "_first": F.col("_mark").isNull() & total.isNotNull()})
    # before the first user message a turn opens with the first growth, never with the seed
    implicit = (F.col("_opened") == 0) & (F.sum(F.col("_grows").cast("int")).over(upto) > 0)
    seen = seen.withColumn("_turn", F.when(F.col("_opened") > 0, F.col("_opened")).when(implicit, F.lit(0)))
    own = seen.filter("_turn IS NOT NULL")
    turns = own.groupBy(*keys, "_turn").agg(
        F.min(order).alias("ord"),
        F.coalesce(F.min_by(F.coalesce(F.col("_mark"), F.lit(0)), order), F.lit(0)).alias("_base"),
        F.max(F.when(F.col("_grows") | F.col("_first"), F.col("_high"))).alias("_max"),
        F.max_by("timestamp_ms", F.when((F.col("_grows") | F.col("_first")) & (F.col("_high") > 0), F.col(order))).alias("_at"),
        F.min_by("_known", order).alias("_opened_with"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col(order))).alias("_named"),
        F.min_by("model", order).alias("_head"),
    )
    # a line that closes a turn and names a model names it for that turn, too
    following = F.lead("_head").over(Window.partitionBy(*keys).orderBy("_turn"))
    turns = turns.withColumn("_named", F.coalesce(F.col("_named"), following))
    model = F.when(F.col("_opened_with") == "grok-unknown", F.coalesce("_named", "_opened_with")).otherwise(F.col("_opened_with"))
    first_implicit = F.max(F.when(F.col("_turn") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys))
    turns = turns.select(*keys, (F.col("_turn") - 1 + first_implicit).cast("int").alias("turn"), model.alias("model"), (F.col("_max") - F.col("_base")).alias("delta"), F.col("_at").alias("timestamp_ms"), "ord")
    turns = turns.filter("delta > 0")
    whole = seen.groupBy(*keys).agg(
        F.max("_high").alias("delta"), F.max_by("timestamp_ms", F.when(F.col("_high").isNotNull(), F.col(order))).alias("timestamp_ms"), F.max_by("_known", order).alias("model"), F.min(order).alias("ord")
    ).filter("delta > 0")
    whole = whole.join(turns.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(0).alias("turn"), "model", "delta", "timestamp_ms", "ord")
    return turns.unionByName(whole)


def signals_remainder(turns: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """What signals report beyond the turns: keys, extra, timestamp_ms (the latest turn's, else the session's).

    ``signals``: keys, total, before, context (null if absent), session_ms.
    """
    effective = F.when(F.col("context").isNull(), F.col("before") + F.col("total")).otherwise(F.greatest(F.col("total"), F.col("before") + F.col("context")))
    sums = turns.groupBy(*keys).agg(F.sum("delta").alias("_sum"), F.max("timestamp_ms").alias("_at"))
    found = signals.withColumn("_total", effective).join(sums, keys, "left")
    found = found.withColumn("extra", F.col("_total") - F.coalesce("_sum", F.lit(0)))
    return found.filter("_total > 0 AND extra > 0").select(*signals.columns, "extra", F.coalesce("_at", "session_ms").alias("timestamp_ms"))
