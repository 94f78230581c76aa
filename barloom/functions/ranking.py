"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import START


def running_position(df: DataFrame, day: str, order: str, tie: str) -> DataFrame:
    """Add ``position``: the 1-based place in the order (day, order, hash of tie, tie).

    A window without a key would sort everything in one task.  Here the rows are
    counted in cells (day, order value, hash prefix of the tie column), the counts
    are added up within each day and then over the days, and only rows of one cell
    are numbered together.  Days are bounded by the calendar, and a moment shared
    by any number of rows is spread over 4096 cells.
    """
    cell = ["_day", "_at", "_bucket"]
    df = df.withColumns(
        {
            "_day": F.col(day),
            "_at": F.coalesce(F.col(order).cast("string"), F.lit("")),
            "_bucket": F.substring(F.md5(F.col(tie).cast("string")), 1, 3),
        }
    )
    cells = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    in_day = Window.partitionBy("_day").orderBy("_at", "_bucket").rowsBetween(START, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(in_day), F.lit(0)))
    days = cells.groupBy("_day").agg(F.sum("_n").alias("_n"))
    over_days = Window.orderBy("_day").rowsBetween(START, -1)
    days = days.select("_day", F.coalesce(F.sum("_n").over(over_days), F.lit(0)).alias("_base"))
    # One row per calendar day.
    offsets = cells.join(F.broadcast(days), "_day").select(*cell, (F.col("_before") + F.col("_base")).alias("_offset"))
    in_cell = Window.partitionBy(*cell).orderBy(tie)
    numbered = df.join(offsets, cell).withColumn("position", F.row_number().over(in_cell) + F.col("_offset"))
    return numbered.drop(*cell, "_offset")
