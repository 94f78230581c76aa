"""Market structure: pivots, fractal dimension, weekly trend, anchor days, volume profile, containment."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import BY, START, TIME, holds, ratio, roll_std, row_index, running, series, shifted, whole
from .bars import week_end, weekly_bars
from .indicators import add_atr


def add_pivots(panel, period: int = K.PIVOT_PERIOD, by=BY, time=TIME) -> DataFrame:
    """Bars strictly above (below) ``period`` bars on either side.

    A pivot is known only ``period`` bars later; readers must lag it.
    """
    w = series(by, time)
    h, lo = F.col("high"), F.col("low")
    top = (h > shifted(F.max, "high", -period, -1, w)) & (h > shifted(F.max, "high", 1, period, w))
    bottom = (lo < shifted(F.min, "low", -period, -1, w)) & (lo < shifted(F.min, "low", 1, period, w))
    return panel.withColumns({"pivot_high": F.when(top, h), "pivot_low": F.when(bottom, lo)})


def pivot_levels(panel, n: int = 5, period: int = K.PIVOT_PERIOD, by=BY, time=TIME) -> DataFrame:
    """The newest n pivot levels of each side, newest first: key, side, rank, time, price."""
    if "pivot_high" not in panel.columns:
        panel = add_pivots(panel, period, by, time)
    sides = F.array(
        F.struct(F.lit("resistance").alias("side"), F.col("pivot_high").alias("price")),
        F.struct(F.lit("support").alias("side"), F.col("pivot_low").alias("price")),
    )
    long = (
        panel.filter("pivot_high is not null or pivot_low is not null")
        .select(*by, time, F.inline(sides))
        .filter("price is not null")
    )
    w = Window.partitionBy(*by, "side").orderBy(F.col(time).desc())
    return long.withColumn("level_rank", F.row_number().over(w)).filter(F.col("level_rank") <= n)


def level_arrays(panel, n: int = 5, period: int = K.PIVOT_PERIOD, by=BY, time=TIME) -> DataFrame:
    """One row per key with ``supports`` and ``resistances``: arrays of at most n (time, price), newest first."""
    levels = pivot_levels(panel, n, period, by, time)
    entry = F.struct(F.col(time).alias("time"), "price")
    pick = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, entry)), asc=False)
    return levels.groupBy(*by).agg(pick("support").alias("supports"), pick("resistance").alias("resistances"))


def add_fractal_dimension(panel, window: int = K.FD_WINDOW, out: str = "fd", by=BY, time=TIME, only: str | None = None) -> DataFrame:
    """Rescaled-range dimension of the ``window`` closes before the current bar: 1 trend, 2 noise.

    With ``only``, a condition, the other bars have none.

    The range of the running deviations from the mean needs an ordered pass over
    the window, so the closes travel as one short array; nothing else does.
    """
    frame = series(by, time).rowsBetween(-window, -1)
    panel = panel.withColumns(
        {
            "_seg": F.collect_list("close").over(frame),
            "_mean": F.avg("close").over(frame),
            "_sd": F.stddev_samp("close").over(frame),
        }
    )
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("cum"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo")
    )

    def step(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + (x - F.col("_mean"))
        return F.struct(
            cum.alias("cum"), F.greatest(acc["hi"], cum).alias("hi"), F.least(acc["lo"], cum).alias("lo")
        )

    reach = F.aggregate("_seg", start, step, lambda acc: acc["hi"] - acc["lo"])
    asked = F.lit(True) if only is None else F.expr(only)
    panel = panel.withColumn("_reach", F.when(asked & (F.size("_seg") == window), reach))
    hurst = F.log(F.col("_reach") / F.col("_sd")) / math.log(window)
    value = F.when(
        (F.col("_reach") > 0) & (F.col("_sd") > 0),
        2 - F.least(F.greatest(hurst, zero), F.lit(1.0)),
    ).otherwise(F.lit(1.5))
    return panel.withColumn(out, F.when(F.col("_reach").isNotNull(), value)).drop("_seg", "_mean", "_sd", "_reach")


def market_regime(fd: Column, low: float = K.FD_TRENDING, high: float = K.FD_CHOPPY) -> Column:
    return (
        F.when(fd.isNull(), "unknown").when(fd < low, "trending").when(fd > high, "choppy").otherwise("transitional")
    )


def weekly_pivots(panel, period: int = K.WEEKLY_PIVOT_PERIOD, trend: str = "final", by=BY, time=TIME) -> DataFrame:
    """Weekly pivots and weekly trend, one row per key and week label.

    The trend is the direction of the last two pivot lows.  ``final`` takes the
    last two of the whole series for every week, which looks ahead; ``asof``
    takes the last two that were confirmed by each week.
    """
    weeks = add_pivots(weekly_bars(panel, by, time), period, by, time)
    w, all_weeks = series(by, time), whole(by)
    low = F.col("pivot_low")
    if trend == "final":
        weeks = weeks.withColumn("_before", F.last(low, ignorenulls=True).over(w.rowsBetween(START, -1)))
        newest = F.max(F.when(low.isNotNull(), F.struct(time, low.alias("cur"), F.col("_before").alias("old"))))
        weeks = weeks.withColumn("_two", newest.over(all_weeks))
        cur, old = F.col("_two.cur"), F.col("_two.old")
    elif trend == "asof":
        weeks = weeks.withColumn("_known", F.lag(low, period).over(w))
        weeks = weeks.withColumn("_before", F.last("_known", ignorenulls=True).over(w.rowsBetween(START, -1)))
        pair = F.when(F.col("_known").isNotNull(), F.struct(F.col("_known").alias("cur"), F.col("_before").alias("old")))
        weeks = weeks.withColumn("_two", F.last(pair, ignorenulls=True).over(running(w)))
        cur, old = F.col("_two.cur"), F.col("_two.old")
    else:
        raise ValueError(f"trend must be 'final' or 'asof', not {trend!r}")
    enough = F.count("*").over(all_weeks) >= 2 * period + 3
    weeks = weeks.withColumn("_enough", enough)
    sign = F.coalesce(F.signum(cur - old).cast("int"), F.lit(0))
    return weeks.select(
        *by,
        time,
        F.when(F.col("_enough"), F.col("pivot_high")).alias("weekly_pivot_high"),
        F.when(F.col("_enough"), low).alias("weekly_pivot_low"),
        F.when(F.col("_enough"), sign).otherwise(F.lit(0)).alias("weekly_trend"),
    )


def add_weekly_pivots(
    panel, period: int = K.WEEKLY_PIVOT_PERIOD, trend: str = "asof", by: Sequence[str] = BY, time: str = TIME
) -> DataFrame:
    """Daily rows with the values of the newest week label not after them.

    A week label is the Sunday that ends the week, so a day that is no Sunday sees the week before.  Weeks are never made rows of
    their own: every day carries its week's values and the number of its week, and RANGE frames over that number reach
    the neighbouring weeks.  So all of it happens in the partitions of the key, without a join.  Weeks that ``weekly_bars`` would
    leave out have no number; their days see the newest week before.
    """
    if trend not in ("asof", "final"):
        raise ValueError(f"trend must be 'final' or 'asof', not {trend!r}")
    kept = panel.columns
    week = Window.partitionBy(*by, "_week").orderBy(time).rowsBetween(START, Window.unboundedFollowing)
    df = panel.withColumn("_week", week_end(F.col(time)))
    df = df.withColumns({"_high": F.max("high").over(week), "_low": F.min("low").over(week)})
    whole_week = F.col("_high").isNotNull() & F.col("_low").isNotNull() & F.sum("volume").over(week).isNotNull()
    whole_week &= F.first("open").over(week).isNotNull() & F.last("close").over(week).isNotNull()
    df = df.withColumn("_whole", whole_week)
    days = series(by, time)
    starts = F.col("_whole") & (~F.lag("_week").over(days).eqNullSafe(F.col("_week")))
    df = df.withColumn("_starts", starts.cast("int"))
    df = df.withColumns({"_no": F.sum("_starts").over(running(days)), "_weeks": F.sum("_starts").over(whole(by))})
    df = df.withColumns({c: F.when(F.col("_whole"), F.col(c)) for c in ("_high", "_low")})

    number = Window.partitionBy(*by).orderBy("_no")
    behind, ahead = number.rangeBetween(-period, -1), number.rangeBetween(1, period)
    inner = (F.col("_no") > period) & (F.col("_no") + period <= F.col("_weeks"))
    top = inner & (F.col("_high") > F.max("_high").over(behind)) & (F.col("_high") > F.max("_high").over(ahead))
    bottom = inner & (F.col("_low") < F.min("_low").over(behind)) & (F.col("_low") < F.min("_low").over(ahead))
    df = df.withColumns({"_ph": F.when(top, F.col("_high")), "_pl": F.when(bottom, F.col("_low"))})
    # The pivot low before each pivot low; then the newest such pair, of the whole series or known by each week.
    df = df.withColumn("_before", F.last("_pl", ignorenulls=True).over(number.rangeBetween(START, -1)))
    pair = F.when(F.col("_pl").isNotNull(), F.struct("_no", F.col("_pl").alias("cur"), F.col("_before").alias("old")))
    two = F.max(pair).over(whole(by)) if trend == "final" else F.last(pair, ignorenulls=True).over(number.rangeBetween(START, -period))
    df = df.withColumn("_two", two)
    sign = F.coalesce(F.signum(F.col("_two.cur") - F.col("_two.old")).cast("int"), F.lit(0))
    enough = F.col("_weeks") >= 2 * period + 3
    own = F.when(F.col("_whole"), F.struct(*[F.when(enough, F.col(c)).alias(c) for c in ("_ph", "_pl")], F.when(enough, sign).otherwise(0).alias("_trend")))
    df = df.withColumn("_own", own)
    newest = F.last("_own", ignorenulls=True)
    df = df.withColumns({"_same": newest.over(number.rangeBetween(START, 0)), "_prev": newest.over(number.rangeBetween(START, -1))})
    seen = F.when(~F.col("_whole"), F.col("_same")).when(F.col("_week") == F.col(time), F.col("_own")).otherwise(F.col("_prev"))
    df = df.withColumn("_v", seen)
    return df.select(
        *[F.col(c) for c in kept],
        F.col("_v._ph").alias("weekly_pivot_high"),
        F.col("_v._pl").alias("weekly_pivot_low"),
        F.coalesce(F.col("_v._trend"), F.lit(0)).alias("weekly_trend"),
    )


def anchor_events(panel, gap_mult: float = 2.0, lookback: int = 252, n: int = 5, by=BY, time=TIME) -> DataFrame:
    """Latest n of: 52-week high day, 52-week low day, gap days (open far from the previous close)."""
    w, all_rows = series(by, time), whole(by)
    panel = add_atr(panel, 14, "_atr", by, time).withColumns(
        {"_i": row_index(w), "_n": F.count("*").over(all_rows), "_pc": F.lag("close").over(w)}
    )
    recent = F.col("_i") >= F.col("_n") - lookback
    day = F.unix_date(time)
    panel = panel.withColumns(
        {
            "_top": F.max(F.when(recent, F.struct("high", (-day).alias("d")))).over(all_rows),
            "_low": F.min(F.when(recent, F.struct("low", day.alias("d")))).over(all_rows),
        }
    )
    gap = holds((F.col("_atr") > 0) & (F.abs(F.col("open") - F.col("_pc")) > gap_mult * F.col("_atr")))
    event = (
        F.when(F.col("_top.d") == -day, F.struct(F.lit("52W High").alias("event"), F.col("high").alias("price")))
        .when(F.col("_low.d") == day, F.struct(F.lit("52W Low").alias("event"), F.col("low").alias("price")))
        .when(gap, F.struct(F.lit("Gap").alias("event"), F.col("open").alias("price")))
    )
    found = panel.filter("_n >= 20").select(*by, time, event.alias("_e")).filter("_e is not null")
    newest = Window.partitionBy(*by).orderBy(F.col(time).desc())
    return (
        found.withColumn("event_rank", F.row_number().over(newest))
        .filter(F.col("event_rank") <= n)
        .select(*by, time, F.col("_e.event").alias("event"), F.col("_e.price").alias("price"), "event_rank")
    )


def volume_histogram(panel, bins: int = 50, by=BY) -> DataFrame:
    """Volume per price bin of each key: range, bin number, volume."""
    all_rows = whole(by)
    panel = panel.withColumns(
        {
            "price_min": F.min("low").over(all_rows),
            "price_max": F.max("high").over(all_rows),
            "bars": F.count("*").over(all_rows),
        }
    )
    at = F.floor((F.col("close") - F.col("price_min")) / (F.col("price_max") - F.col("price_min")) * bins)
    return (
        panel.filter("bars >= 5 and price_max > price_min")
        .withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int"))
        .groupBy(*by, "price_min", "price_max", "bin")
        .agg(F.sum("volume").alias("volume"))
    )


def volume_profile(panel, bins: int = 50, share: float = 0.70, by=BY) -> DataFrame:
    """Point of control and value area of each key.

    The area grows from the fullest bin to whichever neighbour holds more (the
    lower one on ties) until it covers ``share`` of the volume: at most ``bins``
    steps over an array of ``bins`` numbers.
    """
    hist = volume_histogram(panel, bins, by)
    keyed = hist.groupBy(*by, "price_min", "price_max").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "volume"))).alias("_m"),
        F.sum("volume").alias("total_volume"),
    )
    spine = F.sequence(F.lit(0), F.lit(bins - 1))
    keyed = keyed.withColumn("volumes", F.transform(spine, lambda b: F.coalesce(F.col("_m")[b], F.lit(0.0))))
    keyed = keyed.withColumn(
        "_poc", (F.array_position("volumes", F.array_max("volumes")) - 1).cast("int")
    )
    vols = F.col("volumes")

    def at(i: Column) -> Column:
        return F.coalesce(F.try_element_at(vols, i + 1), F.lit(0.0))

    start = F.struct(
        F.col("_poc").alias("lo"), F.col("_poc").alias("hi"), at(F.col("_poc")).alias("vol")
    )

    def step(acc: Column, _: Column) -> Column:
        lo, hi, vol = acc["lo"], acc["hi"], acc["vol"]
        below = F.when(lo > 0, at(lo - 1)).otherwise(F.lit(0.0))
        above = F.when(hi < bins - 1, at(hi + 1)).otherwise(F.lit(0.0))
        down = (lo > 0) & ((below >= above) | (hi >= bins - 1))
        grow = (vol < F.col("total_volume") * share) & ((lo > 0) | (hi < bins - 1))
        return (
            F.when(~grow, acc)
            .when(down, F.struct((lo - 1).alias("lo"), hi.alias("hi"), (vol + below).alias("vol")))
            .otherwise(F.struct(lo.alias("lo"), (hi + 1).alias("hi"), (vol + above).alias("vol")))
        )

    keyed = keyed.withColumn("_va", F.aggregate(spine, start, step))
    keyed = keyed.withColumn("_w", (F.col("price_max") - F.col("price_min")) / bins)
    empty = F.col("total_volume") == 0
    return keyed.select(
        *by,
        "volumes",
        "total_volume",
        (F.col("price_min") + (F.col("_poc") + 0.5) * F.col("_w")).alias("poc"),
        F.when(empty, F.col("price_max"))
        .otherwise(F.col("price_min") + (F.col("_va.hi") + 1) * F.col("_w"))
        .alias("value_area_high"),
        F.when(empty, F.col("price_min"))
        .otherwise(F.col("price_min") + F.col("_va.lo") * F.col("_w"))
        .alias("value_area_low"),
    )


def containment_days(panel, window: int = 60, vol_window: int = 20, by=BY, time=TIME) -> DataFrame:
    """For each of the last days: did the next close fall within one and two sigmas of realised volatility?"""
    w = series(by, time)
    panel = panel.withColumn("_lr", F.log(ratio(F.col("close"), F.lag("close").over(w))))
    panel = panel.withColumns(
        {
            "rv": roll_std("_lr", vol_window, w) * math.sqrt(K.TRADING_DAYS),
            "next_close": F.lead("close").over(w),
            "_i": row_index(w),
            "_n": F.count("*").over(whole(by)),
        }
    )
    first = F.greatest(F.lit(vol_window + 1), F.col("_n") - window)
    days = panel.filter((F.col("_i") >= first) & (F.col("_i") < F.col("_n") - 1) & (F.col("rv") > 0))
    move = F.col("close") * F.col("rv") * math.sqrt(1 / K.TRADING_DAYS)
    c = F.col("close")
    days = days.withColumns(
        {
            "range_low_1s": c - move,
            "range_high_1s": c + move,
            "range_low_2s": c - 2 * move,
            "range_high_2s": c + 2 * move,
        }
    )
    return days.select(
        *by,
        time,
        "close",
        "next_close",
        "rv",
        "range_low_1s",
        "range_high_1s",
        "range_low_2s",
        "range_high_2s",
        F.col("next_close").between(F.col("range_low_1s"), F.col("range_high_1s")).alias("in_1sigma"),
        F.col("next_close").between(F.col("range_low_2s"), F.col("range_high_2s")).alias("in_2sigma"),
    )


def containment(panel, window: int = 60, vol_window: int = 20, by=BY, time=TIME) -> DataFrame:
    """Containment rates per key and a calibration grade by distance from 68.3 and 95.4 percent."""
    days = containment_days(panel, window, vol_window, by, time)
    res = days.groupBy(*by).agg(
        F.count("*").alias("days_tested"),
        F.round(F.sum(F.col("in_1sigma").cast("int")) / F.count("*") * 100, 1).alias("containment_1sigma_pct"),
        F.round(F.sum(F.col("in_2sigma").cast("int")) / F.count("*") * 100, 1).alias("containment_2sigma_pct"),
    )
    off = F.abs(F.col("containment_1sigma_pct") - 68.3) + F.abs(F.col("containment_2sigma_pct") - 95.4)
    return res.withColumn("grade", F.when(off < 5, "A").when(off < 10, "B").when(off < 20, "C").otherwise("D"))
