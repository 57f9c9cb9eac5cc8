"""Joins over time: the last earlier row of a key, and points in intervals, as equality joins on slices of time.

Neither compares all rows of a key with each other. Rows of a key are cut into slices of time; what a slice needs of
earlier ones is one row (:func:`asof_join`), and an interval goes to at most two bins of its own length class
(:func:`interval_join`), so a frequent key is spread over many tasks and copies of rows are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that one slice of time should hold.
SLICE_ROWS = 200_000
#: Slices beyond rows / SLICE_ROWS, as rows aren't even over time.
SPARE = 4


def _micros(time: Column) -> Column:
    """Microseconds; a timestamp without a zone counts as UTC."""
    return F.unix_micros(time.cast("timestamp"))


def _sliced(both: DataFrame, slice_rows: int) -> DataFrame:
    """Adds __slice: 0 for a key of few rows, else the number of an even part of the key's time."""
    spans = both.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("t0"), F.max("__t").alias("t1"))
    # Only frequent keys have a row here: at most one for slice_rows rows of input.
    frequent = spans.filter(F.col("n") > slice_rows).select(F.col("__key").alias("__of"), "t0", F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0") + 1) / F.ceil(F.col("n") / slice_rows * SPARE))).alias("width"))
    out = both.join(frequent, F.col("__key") == F.col("__of"), "left")
    return out.withColumn("__slice", F.when(F.col("width").isNull(), F.lit(0)).otherwise(F.floor((F.col("__t") - F.col("t0")) / F.col("width"))).cast("long")).drop("__of", "t0", "width")


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: list[str], tie: str, strict: bool = True, within: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``left`` with the columns ``take`` of the key's last row of ``right`` before each row, null where there is none.

    Before means earlier if ``strict``, else not later; of several rows at that time the one with the greatest ``tie`` counts. ``within``, an
    interval such as "1 hour", makes older rows count as none. Every row of ``left`` stays once; rows without key or time match nothing.

    Both tables are shuffled once, together, by key and slice. A slice sees its own rows in order; the last row of all earlier slices of
    its key comes by a join with one row for each key and slice.
    """
    given = left.columns
    clashing = {f"__{c}" for c in ("key", "t", "side", "tie", "row", "slice", "found", "got")} & {*given, *right.columns}
    if clashing or set(take) & set(given):
        raise ValueError(f"rename these columns: {sorted(clashing | (set(take) & set(given)))}")
    # Rows of the right side at the same time come first unless they must be earlier.
    found = F.struct(F.col("__t").alias("__t"), F.col(tie).alias("__tie"), *take)
    timed_right = right.withColumn("__t", _micros(F.col(right_time))).filter(F.col("__t").isNotNull() & F.col(on).isNotNull())
    timed_left = left.withColumn("__t", _micros(F.col(left_time)))
    whole = timed_left.filter(F.col("__t").isNotNull() & F.col(on).isNotNull())
    rest = timed_left.filter(F.col("__t").isNull() | F.col(on).isNull()).select(*given, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take))
    ours = whole.select(F.col(on).alias("__key"), "__t", F.lit(0 if strict else 1).alias("__side"), F.struct(*given).alias("__row"))
    theirs = timed_right.select(F.col(on).alias("__key"), "__t", F.lit(1 if strict else 0).alias("__side"), found.alias("__found"))
    both = _sliced(ours.unionByName(theirs, allowMissingColumns=True), slice_rows)
    slices = both.groupBy("__key", "__slice").agg(F.max(F.struct("__found.__t", "__found.__tie", F.col("__found").alias("f"))).alias("m"))
    earlier = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(F.col("__key").alias("__k"), F.col("__slice").alias("__s"), F.last(F.when(F.col("m.f").isNotNull(), F.col("m.f")), ignorenulls=True).over(earlier).alias("__carried"))
    so_far = Window.partitionBy("__key", "__slice").orderBy("__t", "__side", F.col("__found.__tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("__got", F.last("__found", ignorenulls=True).over(so_far)).filter("__row IS NOT NULL")
    out = own.join(carried, (F.col("__key") == F.col("__k")) & (F.col("__slice") == F.col("__s")), "left").withColumn("__got", F.coalesce("__got", "__carried"))
    fresh = F.col("__got").isNotNull()
    if within:
        fresh = fresh & (F.timestamp_micros("__t") - F.expr(f"INTERVAL {within}") <= F.timestamp_micros("__got.__t"))
    return out.select("__row.*", *(F.when(fresh, F.col(f"__got.{c}")).alias(c) for c in take)).unionByName(rest)


def length_classes(intervals: DataFrame, start: str, end: str) -> list[int]:
    """The powers of two that cover the lengths of the intervals, in microseconds as exponents: at most 63 numbers."""
    spans = _micros(F.col(end)) - _micros(F.col(start))
    return sorted(r[0] for r in intervals.filter(spans > 0).select(_length_class(spans)).distinct().collect())


def _length_class(span: Column) -> Column:
    """The least k with 2**k at or above the span."""
    return F.length(F.regexp_replace(F.bin(span - 1), "^0+$", ""))


def interval_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """Pairs of a point and an interval, of equal ``on`` columns if given, with start <= time < end; columns of both sides, which must not clash.

    An interval of length at most 2**k goes to the one or two bins of width 2**k that it meets; a point goes to its bin of each length that
    occurs. The pair meets in exactly one bin. Intervals that are empty, end before they start or lack an end match nothing.

    Both sides are shuffled and sorted: sizes are guessed from files and don't count the copies, so a broadcast may exceed the driver's memory.
    """
    on = on or []
    if set(points.columns) & (set(intervals.columns) - set(on)):
        raise ValueError(f"rename these columns: {sorted(set(points.columns) & (set(intervals.columns) - set(on)))}")
    classes = length_classes(intervals, start, end)
    span, t = _micros(F.col(end)) - _micros(F.col(start)), _micros(F.col(time))
    keys = [f"__{c}" for c in on]
    right = intervals.filter(span > 0).withColumn("__class", _length_class(span))
    first, last = (F.call_function("shiftright", x, F.col("__class")) for x in (_micros(F.col(start)), _micros(F.col(end)) - 1))
    right = right.withColumn("__bin", F.explode(F.sequence(first, last))).withColumnsRenamed(dict(zip(on, keys, strict=True)))
    left = points.filter(t.isNotNull()).withColumn("__point_class", F.explode(F.array(*map(F.lit, classes)) if classes else F.expr("cast(array() as array<int>)")))
    left = left.withColumn("__point_bin", F.call_function("shiftright", t, F.col("__point_class")))
    same = (F.col("__point_class") == F.col("__class")) & (F.col("__point_bin") == F.col("__bin"))
    for c, k in zip(on, keys, strict=True):
        same = same & (F.col(c) == F.col(k))
    met = left.join(right.hint("merge"), same & (F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))
    return met.drop("__class", "__bin", "__point_class", "__point_bin", *keys)
