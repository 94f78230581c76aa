"""Bars: building, cleaning, resampling, date ranges, calendar returns.

A panel has one row per (symbol, dt) with open, high, low, close, volume as
doubles.  Building bars is an ordinary grouped aggregate, so a symbol that holds
a third of all trades is combined on the map side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import BY, TIME, ratio, row_index, series, whole

PRICES = ["open", "high", "low", "close"]
VALUES = [*PRICES, "volume"]
MONTHS = list(range(1, 13))


def normalize_names(df: DataFrame) -> DataFrame:
    """Trim and lower-case column names."""
    return df.select([F.col(f"`{c}`").alias(c.strip().lower()) for c in df.columns])


def without_nan(df: DataFrame, cols: Sequence[str] = VALUES) -> DataFrame:
    """NaN and infinite values to null: a comparison with a missing value must not be true, nor a sum be lost for ever."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: F.when(F.abs(F.nanvl(F.col(c), F.lit(float("inf")))) < float("inf"), F.col(c)).cast("double")
            for c in cols
            if types.get(c) in ("double", "float")
        }
    )


def drop_missing_close(df: DataFrame) -> DataFrame:
    return without_nan(df, ["close"]).dropna(subset=["close"])


def drop_empty_rows(df: DataFrame, cols: Sequence[str] = VALUES) -> DataFrame:
    return without_nan(df, cols).dropna("all", subset=list(cols))


def naive_day(c: Column) -> Column:
    """Calendar day of a timestamp in the session time zone."""
    return F.to_date(c.cast("timestamp_ntz"))


def trades_to_bars(
    trades: DataFrame,
    bucket: Column,
    *,
    price: str = "price",
    size: str = "size",
    order: Sequence[str] = ("ts",),
    by: Sequence[str] = BY,
    time: str = TIME,
) -> DataFrame:
    """First / highest / lowest / last price and total size per key and bucket.

    ``order`` must be unique within a bucket.  Every aggregate has a fixed-size
    partial state, so no group is ever held in one place; with one number or time as ``order`` it is a hash
    aggregate, with several columns trades are sorted before they are combined.
    Buckets below a day make long series: windows over them hold one series in one task.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    p = F.col(price).cast("double")
    return (
        trades.withColumn(time, bucket)
        .groupBy(*by, time)
        .agg(
            F.min_by(p, key).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, key).alias("close"),
            F.sum(F.col(size).cast("double")).alias("volume"),
        )
    )


def week_end(day: Column) -> Column:
    """The Sunday that ends the week of ``day``; a Sunday belongs to itself."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def weekly_bars(panel: DataFrame, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Daily to weekly bars labelled with the Sunday; weeks with a missing value are left out.

    On a panel that is already partitioned by its key this adds no shuffle.
    """
    t = F.col(time)
    return (
        panel.withColumn("_week", week_end(t))
        .groupBy(*by, "_week")
        .agg(
            F.min_by("open", t).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", t).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .dropna(subset=VALUES)
        .withColumnRenamed("_week", time)
    )


def monthly_returns(curve: DataFrame, value: str = "equity", by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Percent change of the last value of each month."""
    months = curve.groupBy(*by, F.last_day(time).alias("month_end")).agg(F.max_by(value, time).alias("_v"))
    w = series(by, "month_end")
    ret = (ratio(F.col("_v"), F.lag("_v").over(w)) - 1) * 100
    return months.withColumn("return_pct", ret).dropna(subset=["return_pct"]).drop("_v")


def monthly_pivot(curve: DataFrame, value: str = "equity", by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Year by month table of monthly returns, for keys with at least three months."""
    m = monthly_returns(curve, value, by, time)
    m = m.withColumn("_n", F.count("*").over(whole(by))).filter("_n >= 3")
    cells = [
        F.sum(F.when(F.month("month_end") == k, F.col("return_pct"))).alias(f"m{k:02d}") for k in MONTHS
    ]
    return m.groupBy(*by, F.year("month_end").alias("year")).agg(*cells)


def with_history(panel: DataFrame, min_bars: int, by: Sequence[str] = BY) -> DataFrame:
    """Only keys with at least ``min_bars`` rows."""
    return panel.withColumn("_n", F.count("*").over(whole(by))).filter(F.col("_n") >= min_bars).drop("_n")


def last_rows(panel: DataFrame, n: int = 1, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """The newest n rows of every key."""
    w = series(by, time)
    return (
        panel.withColumns({"_i": row_index(w), "_n": F.count("*").over(whole(by))})
        .filter(F.col("_i") >= F.col("_n") - n)
        .drop("_i", "_n")
    )


def between(panel: DataFrame, start=None, end=None, time: str = TIME) -> DataFrame:
    """Rows in a date range.

    Apply it after the indicators, which need the bars before the range, and
    before positions, which must not see them.
    """
    if start is not None:
        panel = panel.filter(F.col(time) >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.filter(F.col(time) <= F.lit(end).cast("date"))
    return panel


_MONTHS_BACK = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "2Y": 24, "3Y": 36, "5Y": 60}


def period_bounds(panel: DataFrame, period: str, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Start and end day of a period label per key, not earlier than its first bar."""
    ends = panel.groupBy(*by).agg(F.min(time).alias("_first"), F.max(time).alias("end_dt"))
    last = F.col("end_dt")
    if period == "1W":
        start = F.date_sub(last, 7)
    elif period == "YTD":
        start = F.trunc(last, "year")
    elif period in _MONTHS_BACK:
        start = F.add_months(last, -_MONTHS_BACK[period])
    else:
        start = F.col("_first")
    return ends.select(*by, F.greatest(start, F.col("_first")).alias("start_dt"), "end_dt")


def in_period(panel: DataFrame, period: str, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Bars of the period: the bounds are window values, so there is no join."""
    w = whole(by)
    last, first = F.max(time).over(w), F.min(time).over(w)
    marked = panel.withColumns({"_last": last, "_first": first})
    bound = {
        "1W": F.date_sub(F.col("_last"), 7),
        "YTD": F.trunc(F.col("_last"), "year"),
    }.get(period)
    if bound is None:
        back = _MONTHS_BACK.get(period)
        bound = F.add_months(F.col("_last"), -back) if back else F.col("_first")
    return marked.filter(F.col(time) >= F.greatest(bound, F.col("_first"))).drop("_last", "_first")
