"""Joins along time: the last row at or before a moment, and the intervals that a moment falls in.

Both cut each key's time into slices, so that a key with very many rows is dealt to many tasks: a slice of a key is what
a task sees, and what it needs from the slices before it is one row (`as_of`), or comes to it as a copy of the
intervals that reach into it (`within`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 6 * 3600


def slice_of(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: str, values: list[str], tolerance: int | None = None, width: int = SLICE) -> DataFrame:
    """left, with `values` of the last right row of its key at or before its time, null where there is none.

    Of right rows at one moment the one of greatest `order` counts. With a tolerance, rows more than so many seconds
    older count as none. Rows of left without key or time get nulls, rows of right without them are left out; repeated
    rows of left stay. One exchange by key and slice for the rows; the slices' last rows, an aggregate with partial
    sums, are handed from slice to slice.
    """
    at = F.col(time).cast("timestamp")
    asked = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_key"), at.alias("_at"), F.lit(None).alias("_order"), F.lit(1).alias("_kind"))
    given = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    given = given.select(F.col(key).alias("_key"), at.alias("_at"), F.col(order).alias("_order"), F.struct(at.alias("_at"), *values).alias("_value"), F.lit(0).alias("_kind"))
    rows = asked.unionByName(given, allowMissingColumns=True).withColumn("_slice", slice_of(F.col("_at"), width))
    last = rows.groupBy("_key", "_slice").agg(F.max_by("_value", F.when(F.col("_kind") == 0, F.struct("_at", "_order"))).alias("_value"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_value", F.last("_value", ignorenulls=True).over(before)).where("_value is not null")
    rows = rows.unionByName(carried.withColumn("_kind", F.lit(-1)), allowMissingColumns=True)
    by = Window.partitionBy("_key", "_slice").orderBy(F.col("_kind") >= 0, "_at", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_value", F.last("_value", ignorenulls=True).over(by)).where("_kind = 1")
    young = F.lit(True) if tolerance is None else F.unix_micros("_at") - F.unix_micros("_value._at") <= tolerance * 1_000_000
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull() & young
    return found.select("_row.*", *[F.when(known, F.col(f"_value.{v}")).alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, key: str, time: str, start: str, end: str, width: int = SLICE) -> DataFrame:
    """Pairs of a left row and a right interval of its key with start <= time < end: all columns of both but right's key.

    An interval is copied to each slice that it reaches into, where it meets the rows of that slice alone. Intervals that
    are empty, or lack key, start or end, meet nothing. Names of the other columns must differ.
    """
    held = right.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    held = held.withColumn("_slice", F.explode_outer(F.sequence(slice_of(F.col(start), width), slice_of(F.col(end) - F.expr("interval 1 microsecond"), width))))
    rows = left.where(F.col(time).isNotNull()).withColumn("_slice", slice_of(F.col(time), width))
    met = rows.join(held, [key, "_slice"]).where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))
    return met.drop("_slice")
