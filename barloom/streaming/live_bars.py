"""Bars that stay current while trades arrive.

The batch operators re-read their input to see new data; this is the same bar
aggregate over a stream, closed by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bars(
    trades: DataFrame,
    width: str = "1 day",
    late: str = "1 hour",
    time: str = "ts",
    price: str = "price",
    size: str = "size",
    order: tuple[str, ...] = ("ts",),
) -> DataFrame:
    """Open, high, low, close, volume per symbol and window; state is one row per open window."""
    key = F.struct(*order)
    p = F.col(price).cast("double")
    return (
        trades.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("_w"), "symbol")
        .agg(
            F.min_by(p, key).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, key).alias("close"),
            F.sum(F.col(size).cast("double")).alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("dt"), "open", "high", "low", "close", "volume")
    )
