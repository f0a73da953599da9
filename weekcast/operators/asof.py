"""As-of joins: to every row the latest earlier, or the next later, row of another table.

The distinct times of both sides are laid one above the other and ordered; the newest row of the right side so far is
carried along. Nothing is compared pairwise. Time is cut into ranges, more of them the more times there are, so that
neither a key that holds most times nor a join without keys ends in one task: within a range rows are carried as above,
and what comes from earlier ranges is one row per key and range. What is found is attached to the rows by key and time,
so rows of one time are never sorted, and not sent where the times are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekcast.plans.scale import attach, materialize

# Ranges of time at least, and the times that one should hold.
RANGES, RANGE_TIMES = 64, 100_000


def _seconds(time: Column, kind: str) -> Column:
    """A time as a number, in seconds for times and dates."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(time.cast("timestamp")) / 1_000_000
    return time.cast("double")


def asof_join(
    left: DataFrame, right: DataFrame, time: str, right_time: str | None = None, by: Sequence[str] = (),
    direction: str = "backward", tolerance: float | None = None, ranges: int = RANGES,
) -> DataFrame:
    """The rows of ``left`` with the columns of the matching row of ``right``, null where there is none.

    ``direction``: "backward" for the latest row of the same keys that is not later, "forward" for the next that is not
    earlier; of several at one time that with the largest values. ``tolerance``: the largest distance, in seconds for
    dates and times. Rows of either side without a time or with a null key match nothing; those of ``left`` stay. The
    columns of ``right``, but for its keys, must not be columns of ``left``.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    right_time, by = right_time or time, list(by)
    given = [c for c in right.columns if c not in by]
    clash = sorted(set(given) & set(left.columns))
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    sign = 1 if direction == "backward" else -1
    keys = [f"_k{i}" for i in range(len(by))]

    def side(frame: DataFrame, at: str, name: str) -> DataFrame:
        known = F.col(f"`{at}`").isNotNull()
        for c in by:
            known = known & F.col(f"`{c}`").isNotNull()
        number = F.when(known, _seconds(F.col(f"`{at}`"), frame.schema[at].dataType.simpleString()) * sign)
        return frame.select(number.alias("_t"), *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)],
                            F.struct(*[F.col(f"`{c}`") for c in (left.columns if name == "_l" else given)]).alias(name))

    a = materialize(side(left, time, "_l"), "asof-rows")
    b = side(right, right_time, "_r").where(F.col("_t").isNotNull()).groupBy(*keys, "_t").agg(F.max("_r").alias("_r"))
    wanted = a.where(F.col("_t").isNotNull()).select(*keys, "_t").distinct()
    kind = b.schema["_r"].dataType
    both = wanted.withColumn("_r", F.lit(None).cast(kind)).withColumn("_row", F.lit(True)).unionByName(b.withColumn("_row", F.lit(False)))
    both = materialize(both, "asof")
    given_time = F.when(~F.col("_row"), F.col("_t"))
    ends = both.agg(F.min(given_time).alias("low"), F.max(given_time).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        part = F.lit(0)
    else:
        ranges = max(ranges, ends["n"] // RANGE_TIMES)
        width = (ends["high"] - ends["low"]) / ranges
        # Times before all of the right side have range -1.
        part = F.least(F.greatest(F.floor((F.col("_t") - ends["low"]) / width), F.lit(-1)), F.lit(ranges)).cast("int")
    both = both.withColumn("_part", part)
    last = both.where(~F.col("_row")).groupBy(*keys, "_part").agg(F.max(F.struct("_t", "_r")).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if keys else (
        Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row per key and range, for every range that the key has on either side.
    places = both.select(*keys, "_part").distinct()
    carried = places.join(last, [*keys, "_part"], "left").withColumn("_before", F.last("_last", True).over(earlier))
    carried = carried.select(*keys, "_part", "_before")
    inside = Window.partitionBy(*keys, "_part").orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(~F.col("_row"), F.struct("_t", "_r"))
    found = both.withColumn("_found", F.last(mine, True).over(inside)).where("_row")
    found = attach(found, carried, [*keys, "_part"], counted=both)
    found = found.select(*keys, "_t", F.coalesce("_found", "_before").alias("_match"))
    out = attach(a, found, [*keys, "_t"])
    if tolerance is not None:
        out = out.withColumn("_match", F.when(F.col("_t") - F.col("_match._t") <= tolerance, F.col("_match")))
    return out.select("_l.*", *[F.col(f"_match._r.`{c}`").alias(c) for c in given])
