"""Mixing sources to target weights along a time-varying curriculum.

A source's weight schedule is piecewise linear over training time 0..1 (knots). Its integral,
scaled to the source's target, is its cumulative token demand D(t). The source's documents,
in a fixed pseudo-random order and repeated as often as the target asks, supply tokens at
cumulative offsets c; a document's training position is the t with D(t) = c. Documents are
range-sorted by position.

Offsets are prefix sums in three levels (shelves of hash bins, bins of a shelf, rows of a bin),
so no task holds a source, however hot; the order hashes doc_id and text, so rows without a
doc_id are spread, too. Sources are ranked by ranges, and their shares found by rounds of one
aggregate, so their number doesn't matter either.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its
own, last in order; rows that agree in doc_id, source and text are counted before anything is
sorted, stand together in the order and share what is taken of them evenly, rounded down, at
the position of the first; an empty table gives an empty result; sources of size 0 have target
0; other columns play no part in ``mix``; in ``mixed_documents`` columns named like those it
adds are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Rows of a bin and bins of a shelf, about; both only bound the rows that one task sorts.
BIN_ROWS, SHELF_BINS = 256, 4096
#: Weight over training time by the source's place in order, repeating: rising, falling, peaking.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.6), (1.0, 0.4)), ((0.0, 0.6), (0.5, 1.4), (1.0, 0.6)))


def size(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds place: a source's number, from 0, in code point order, null last.

    Ranges of sources are numbered each for itself and shifted by the sizes of the ranges before,
    of which there are as many as partitions.
    """
    order = F.col("source").asc_nulls_last()
    ranged = cut(sizes.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    place, shifts = 0, []
    for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect():
        shifts.append((r["_range"], place))
        place += r["n"]
    shift = sizes.sparkSession.createDataFrame(shifts, "_range int, _shift long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_within", within).join(shift, "_range").select("source", "source_size", (F.col("_within") + F.col("_shift")).alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> also place, weight and target.

    Each round shares what the full sources leave among the others by weight; those that reach
    ``most`` times their size are full in the next. Full sources only grow in number, and when they
    don't, the shares stand.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sizes = cut(ranked(sizes).withColumn("weight", weight))
    whole, level, known = F.col("source_size") * most, 0.0, -1
    full = F.lit(False)
    while True:
        r = sizes.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.count_if(full).alias("n"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            level = float("inf")
            break
        level = (r["all"] * budget - (r["full"] or 0) * most) / r["open"]
        if r["n"] == known:
            break
        known, full = r["n"], F.col("weight") * F.lit(float(level)) >= whole
    return sizes.withColumn("target", F.least(whole.cast("double"), F.col("weight") * F.lit(float(level))))


def demand_inverse(offset: Column, target: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's integrated schedule has asked for ``offset`` of its ``target``."""
    share = F.when(target > 0, offset / F.when(target > 0, target)).otherwise(F.lit(0.0))
    out = None
    for k, knots in enumerate(schedules):
        total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        done, time = 0.0, F.lit(1.0)
        pieces = []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area = (t1 - t0) * (w0 + w1) / 2
            x, slope = share * total - done, (w1 - w0) / (t1 - t0)
            # w0 u + slope u^2 / 2 = x
            u = x / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + x * (2 * slope))) - w0) / slope
            pieces.append((done + area, F.lit(t0) + u))
            done += area
        for end, value in reversed(pieces):
            time = F.when(share * total <= end, value).otherwise(time)
        out = F.when(place % len(schedules) == k, time) if out is None else out.when(place % len(schedules) == k, time)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def before(value: str, *keys: str, order: str) -> Column:
    """The sum of ``value`` over the rows of the same keys that come earlier."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def order_hash(doc_id: Column, text: Column) -> Column:
    """A row's place in its source's order: rows of other ids or texts are spread evenly."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def placed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """One row for all rows that agree in doc_id, source and text (rows: their number), with what is taken of each and where."""
    rows = docs.select("doc_id", "source", size(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("_order"))
    # wide texts are read and counted once
    rows = cut(rows.groupBy("doc_id", F.col("source").alias("_source"), "size", "_order").agg(F.count(F.lit(1)).alias("rows")))
    bins = max(16, rows.count() // BIN_ROWS)
    rows = rows.withColumn("_bin", (F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * bins).cast("long"))
    rows = rows.withColumn("_words", F.col("size") * F.col("rows"))
    by_bin = rows.groupBy("_source", "_bin").agg(F.sum("_words").alias("_bin_size"))
    by_bin = by_bin.withColumn("_shelf", F.floor(F.col("_bin") / SHELF_BINS))
    shelves = by_bin.groupBy(F.col("_source").alias("_s"), F.col("_shelf").alias("_k")).agg(F.sum("_bin_size").alias("_shelf_size"))
    shelves = shelves.withColumn("_below", before("_shelf_size", "_s", order="_k"))
    by_bin = by_bin.join(shelves, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shelf") == F.col("_k"))).drop("_s", "_k")
    by_bin = by_bin.withColumn("_before", F.col("_below") + before("_bin_size", "_source", "_shelf", order="_bin"))
    sizes = targets(by_bin.groupBy(F.col("_source").alias("source")).agg(F.sum("_bin_size").alias("source_size")), weights, budget, most)
    by_bin = by_bin.join(sizes, F.col("_source").eqNullSafe(F.col("source"))).select(
        F.col("_source").alias("_s"), F.col("_bin").alias("_b"), "_before", "source_size", "place", "target"
    )
    rows = rows.join(by_bin, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b")))
    within = Window.partitionBy("_source", "_bin").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_words").over(within), F.lit(0)))
    whole = F.floor("target")
    starts = [F.col("_from") + F.col("source_size") * k for k in range(most)]
    taken = [F.greatest(F.lit(0), F.least(s + F.col("_words"), whole) - s) for s in starts]
    positions = F.filter(
        F.array(*[F.when(t > 0, demand_inverse(s.cast("double"), F.col("target"), F.col("place"), schedules)) for s, t in zip(starts, taken)]),
        lambda x: x.isNotNull(),
    )
    share = F.call_function("div", sum(taken[1:], taken[0]), F.col("rows")).cast("long")
    return rows.select("doc_id", F.col("_source").alias("source"), "_order", "rows", "size", "source_size", "target", share.alias("taken"), positions.alias("positions"))


def repeated(rows: DataFrame, n: str = "rows", at_once: int = 1 << 16) -> DataFrame:
    """Each row as often as its column ``n`` says, in two steps, so that no array is long."""
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / at_once))))
    return parts.withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(at_once).cast("long"), F.col(n) - F.col("_part") * at_once)))).drop("_part", n)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken and positions.

    ``taken`` is the words of the document that fall under its source's target over the epochs;
    the last document of a source is taken in part, so a source's taken words equal its target
    rounded down. ``positions`` has the training position of each copy.
    """
    return repeated(placed(docs, **options)).select("doc_id", "size", "source_size", "target", "taken", "positions")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """``mix``, range-sorted by training position; rows that aren't taken come last."""
    rows = mix(docs, **options).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The curriculum: the documents that the mix takes, range-sorted by training position.

    Adds size, source_size, target, taken, ``position`` (the first copy's) and ``positions``
    (of all copies); columns of these names are replaced. Rows are met by doc_id, source and text.
    """
    added = ("size", "source_size", "target", "taken", "position", "positions")

    def key(order: Column) -> Column:
        return F.concat(order, F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))

    places = placed(docs, **options).filter("taken > 0").withColumn("position", F.element_at("positions", 1)).select(key(F.col("_order")).alias("__mg_key"), *added)
    docs = docs.drop(*added).withColumn("__mg_key", key(order_hash(F.col("doc_id"), F.col("text"))))
    return docs.join(places, "__mg_key").drop("__mg_key").orderBy("position", "doc_id")
