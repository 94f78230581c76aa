"""As-of joins.

Neither direction compares times in a join condition, which would pair every
row of a series with every other.  Keyed series are put into one frame and filled
with a window; a series without a key, one value per day, becomes one row per
calendar day and is matched by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import BY, START, TIME


def _stacked(left: DataFrame, right: DataFrame, cols: Sequence[str], by, time: str) -> DataFrame:
    """Both sides in one frame; on equal times the right side comes first."""
    lhs = left.select(
        *by,
        time,
        F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("_right"),
    )
    rhs = right.select(
        *by,
        time,
        F.lit(0).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"),
        F.struct(*cols).alias("_right"),
    )
    return lhs.unionByName(rhs)


def asof_backward(left, right, cols: Sequence[str], by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Each left row with the newest right row at or before its time."""
    both = _stacked(left, right, cols, by, time)
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(START, 0)
    both = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    return both.filter("_left is not null").select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in cols])


def asof_forward(left, right, cols: Sequence[str], by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Each left row with the oldest right row strictly after its time.

    Walks the series backwards, so the frame grows by one row at a time; a frame
    that ends at the last row would be evaluated anew for every row.
    """
    both = _stacked(left, right, cols, by, time)
    w = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col("_side").desc()).rowsBetween(START, -1)
    both = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    return both.filter("_left is not null").select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in cols])


def one_per_day(daily: DataFrame, time: str = TIME) -> DataFrame:
    """One row per day.  Of several, the largest row by column order is kept, so reruns agree."""
    rest = [c for c in daily.columns if c != time]
    top = daily.groupBy(time).agg(F.max(F.struct(*rest)).alias("_r"))
    return top.select(time, "_r.*")


def expand_intervals(daily: DataFrame, time: str = TIME, last_day=None) -> DataFrame:
    """A day-labelled series without a key, filled forward to every calendar day.

    The unpartitioned window sees one row per calendar day, about 36,500 a
    century, whatever the size of the panel it is joined to.
    """
    daily = one_per_day(daily, time)
    w = Window.orderBy(time)
    until = F.coalesce(F.date_sub(F.lead(time).over(w), 1), F.lit(last_day).cast("date"), F.col(time))
    rest = [c for c in daily.columns if c != time]
    return daily.withColumn("_until", F.greatest(until, F.col(time))).select(
        F.explode(F.sequence(time, "_until")).alias(time), *rest
    )


def asof_calendar(
    panel: DataFrame, daily: DataFrame, cols: Sequence[str], time: str = TIME, day: str = TIME
) -> DataFrame:
    """Panel rows with the newest value of a keyless daily series at or before their day.

    ``time`` is the day of a panel row, ``day`` that of the series.

    Days after the end of the series take its last row, which a scalar subquery
    supplies.  The filled series has one row per calendar day, so its size is
    bounded by the calendar and it is broadcast.
    """
    daily = daily.select(F.col(day).alias(time), *cols)
    last = one_per_day(daily, time).agg(F.max(F.struct(time, *cols)).alias("s")).scalar()
    filled = expand_intervals(daily, time).select(time, F.struct(*cols).alias("_hit"))
    joined = panel.join(F.broadcast(filled), time, "left").withColumn("_last", last)
    hit = F.when(F.col(time) > F.col("_last")[time], F.struct(*[F.col("_last")[c].alias(c) for c in cols])).otherwise(
        F.col("_hit")
    )
    return joined.withColumn("_h", hit).select(
        *[F.col(c) for c in panel.columns], *[F.col("_h")[c].alias(c) for c in cols]
    )
