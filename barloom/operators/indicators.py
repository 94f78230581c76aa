"""Trend, volatility and volume indicators.

Each ``add_*`` function adds columns to a panel.  All of them use the same window
(key, time), so a chain of them costs one shuffle and, apart from exponential
means, one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ewm import Ewm, add_ewm, span
from ..functions.windows import (
    BY,
    TIME,
    add_extremes,
    add_means,
    holds,
    ratio,
    roll_avg,
    roll_min,
    roll_std,
    roll_sum,
    running,
    series,
)


def nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def add_lags(panel: DataFrame, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Previous close, change, relative change, log return."""
    panel = panel.withColumn("prev_close", F.lag("close").over(series(by, time)))
    c, p = F.col("close"), F.col("prev_close")
    return panel.withColumns({"change": c - p, "ret": ratio(c, p) - 1, "log_ret": F.log(ratio(c, p))})


def add_sma(panel: DataFrame, windows: Sequence[int] = (K.MA_SHORT, K.MA_LONG), by=BY, time=TIME) -> DataFrame:
    return add_means(panel, {f"sma_{n}": n for n in windows}, by=by, time=time)


def add_bollinger(panel, period: int = K.BB_PERIOD, width: float = K.BB_STD, by=BY, time=TIME) -> DataFrame:
    w = series(by, time)
    panel = panel.withColumns({"bb_mid": roll_avg("close", period, w), "_sd": roll_std("close", period, w)})
    return panel.withColumns(
        {
            "bb_upper": F.col("bb_mid") + width * F.col("_sd"),
            "bb_lower": F.col("bb_mid") - width * F.col("_sd"),
            "bandwidth": ratio(F.col("_sd") * 4, F.col("bb_mid")),
        }
    ).drop("_sd")


def add_bandwidth_floor(panel, period: int = K.BB_PERIOD, by=BY, time=TIME) -> DataFrame:
    """Lowest bandwidth of the last bars; the bandwidth itself while there are too few."""
    if "bandwidth" not in panel.columns:
        panel = add_bollinger(panel, period, by=by, time=time)
    low = roll_min("bandwidth", 20, series(by, time))
    return panel.withColumn("bandwidth_min", F.coalesce(low, F.col("bandwidth")))


def add_true_range(panel, by=BY, time=TIME) -> DataFrame:
    """Largest of the day's range and the moves from the previous close; the first bar has its range only."""
    panel = panel.withColumn("_pc", F.lag("close").over(series(by, time)))
    h, lo, pc = F.col("high"), F.col("low"), F.col("_pc")
    return panel.withColumn("true_range", F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc))).drop("_pc")


def add_atr(panel, period: int = K.ATR_PERIOD, out: str = "atr", by=BY, time=TIME) -> DataFrame:
    """Average true range as a simple mean."""
    if "true_range" not in panel.columns:
        panel = add_true_range(panel, by, time)
    return panel.withColumn(out, roll_avg("true_range", period, series(by, time)))


def add_atr_ema(panel, period: int = 20, out: str = "atr_ema", by=BY, time=TIME) -> DataFrame:
    """Average true range as an exponential mean."""
    if "true_range" not in panel.columns:
        panel = add_true_range(panel, by, time)
    return add_ewm(panel, [Ewm(out, "true_range", span(period))], by, time)


def add_ema(panel, spans: Sequence[int] = (12, 26), source: str = "close", by=BY, time=TIME) -> DataFrame:
    return add_ewm(panel, [Ewm(f"ema_{n}", source, span(n)) for n in spans], by, time)


def add_gain_loss(panel, by=BY, time=TIME) -> DataFrame:
    panel = panel.withColumn("_d", F.col("close") - F.lag("close").over(series(by, time)))
    d = F.col("_d")
    return panel.withColumns(
        {
            "_gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
            "_loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
        }
    ).drop("_d")


def rsi_specs(period: int) -> list[Ewm]:
    a = 1.0 / period
    return [
        Ewm("_avg_gain", "_gain", a, period, centered=False),
        Ewm("_avg_loss", "_loss", a, period, centered=False),
    ]


def rsi_value() -> Column:
    """Null where there has been no loss at all."""
    return 100 - 100 / (1 + F.col("_avg_gain") / nonzero(F.col("_avg_loss")))


def add_rsi(panel, period: int = K.RSI_PERIOD, out: str = "rsi", by=BY, time=TIME) -> DataFrame:
    panel = add_ewm(add_gain_loss(panel, by, time), rsi_specs(period), by, time)
    return panel.withColumn(out, rsi_value()).drop("_gain", "_loss", "_avg_gain", "_avg_loss")


def add_macd(panel, fast: int = 12, slow: int = 26, signal: int = 9, by=BY, time=TIME) -> DataFrame:
    panel = add_ewm(
        panel,
        [Ewm("_fast", "close", span(fast)), Ewm("_slow", "close", span(slow))],
        by,
        time,
        derive={"macd": F.col("_fast") - F.col("_slow")},
        then=[Ewm("macd_signal", "macd", span(signal))],
    )
    return panel.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def add_oscillators(panel, by=BY, time=TIME) -> DataFrame:
    """MACD, RSI and the exponential Keltner channel at their defaults, from one pass of exponential means."""
    panel = add_gain_loss(panel, by, time)
    if "true_range" not in panel.columns:
        panel = add_true_range(panel, by, time)
    panel = add_ewm(
        panel,
        [
            Ewm("_fast", "close", span(12)),
            Ewm("_slow", "close", span(26)),
            Ewm("keltner_mid", "close", span(20)),
            Ewm("atr_ema", "true_range", span(20)),
            *rsi_specs(K.RSI_PERIOD),
        ],
        by,
        time,
        derive={"macd": F.col("_fast") - F.col("_slow")},
        then=[Ewm("macd_signal", "macd", span(9))],
    )
    return panel.withColumn("rsi", rsi_value()).drop("_fast", "_slow", "_gain", "_loss", "_avg_gain", "_avg_loss")


def add_keltner(
    panel, ema: int = K.KELTNER_EMA, atr: int = K.KELTNER_ATR, mult: float = K.KELTNER_MULT, by=BY, time=TIME
) -> DataFrame:
    panel = add_ewm(panel, [Ewm("keltner_mid", "close", span(ema))], by, time)
    panel = add_atr(panel, atr, "_katr", by, time)
    return panel.withColumns(
        {
            "keltner_upper": F.col("keltner_mid") + mult * F.col("_katr"),
            "keltner_lower": F.col("keltner_mid") - mult * F.col("_katr"),
        }
    ).drop("_katr")


def add_squeeze(
    panel, bb_period: int = 20, bb_std: float = 2.0, kc_period: int = 20, kc_mult: float = 1.5, by=BY, time=TIME
) -> DataFrame:
    """Bollinger bands inside the exponential Keltner channel, and the bar on which that ends."""
    if "true_range" not in panel.columns:
        panel = add_true_range(panel, by, time)
    means = [Ewm("_kmid", "close", span(kc_period)), Ewm("_katr", "true_range", span(kc_period))]
    panel = add_ewm(panel, means, by, time)
    return squeeze_from(panel, "_kmid", "_katr", bb_period, bb_std, kc_mult, by, time).drop("_kmid", "_katr")


def squeeze_from(
    panel, mid: str, atr: str, bb_period: int = 20, bb_std: float = 2.0, kc_mult: float = 1.5, by=BY, time=TIME
) -> DataFrame:
    """The squeeze of bands around given Keltner columns."""
    w = series(by, time)
    panel = panel.withColumns({"sq_mid": roll_avg("close", bb_period, w), "_sd": roll_std("close", bb_period, w)})
    panel = panel.withColumns(
        {
            "sq_upper": F.col("sq_mid") + bb_std * F.col("_sd"),
            "sq_lower": F.col("sq_mid") - bb_std * F.col("_sd"),
            "kc_upper": F.col(mid) + kc_mult * F.col(atr),
            "kc_lower": F.col(mid) - kc_mult * F.col(atr),
        }
    ).drop("_sd")
    on = holds((F.col("sq_upper") < F.col("kc_upper")) & (F.col("sq_lower") > F.col("kc_lower")))
    panel = panel.withColumn("squeeze_on", on)
    before = F.lag("squeeze_on", 1, False).over(w)
    return panel.withColumn("squeeze_release", before & ~F.col("squeeze_on"))


def price_total() -> Column:
    """Three times the typical price; the division is left to the end, where it is done once."""
    return F.col("high") + F.col("low") + F.col("close")


def add_vwap(panel, window: int = K.VWAP_WINDOW, by=BY, time=TIME) -> DataFrame:
    w = series(by, time)
    panel = panel.withColumn("_tv", price_total() * F.col("volume"))
    vwap = roll_sum("_tv", window, w) / nonzero(roll_sum("volume", window, w) * 3)
    return panel.withColumn("vwap", vwap).drop("_tv")


def anchored_vwap(panel: DataFrame, anchors: DataFrame, by=BY, time=TIME) -> DataFrame:
    """VWAP from every anchor day on; ``anchors`` has the key and ``anchor_dt``.

    A symbol has a handful of anchors (five from the event finder), so this is a
    key join with a small multiple of the panel as output.
    """
    pairs = panel.join(anchors.select(*by, "anchor_dt"), list(by)).filter(F.col(time) >= F.col("anchor_dt"))
    w = running(series([*by, "anchor_dt"], time))
    value = F.sum(price_total() * F.col("volume")).over(w) / nonzero(F.sum("volume").over(w) * 3)
    return pairs.withColumn("anchored_vwap", value)


def add_zscore(panel, window: int = K.ZSCORE_WINDOW, by=BY, time=TIME) -> DataFrame:
    w = series(by, time)
    z = (F.col("close") - roll_avg("close", window, w)) / nonzero(roll_std("close", window, w))
    return panel.withColumn("zscore", z)


def add_atr_stop(panel, period: int = K.ATR_PERIOD, mult: float = K.ATR_STOP_MULT, by=BY, time=TIME) -> DataFrame:
    panel = add_atr(panel, period, "_satr", by, time)
    return panel.withColumn("atr_stop", F.col("close") - F.col("_satr") * mult).drop("_satr")


def add_donchian(panel, entry: int = 55, leave: int = 20, by=BY, time=TIME) -> DataFrame:
    """Highest high and lowest low of the bars before the current one."""
    return add_extremes(panel, {"donchian_high": (F.max, "high", entry), "donchian_low": (F.min, "low", leave)}, by, time)


def add_realized_vol(
    panel, window: int = 20, log: bool = True, target: float = 0.15, by=BY, time=TIME
) -> DataFrame:
    """Annualised volatility of returns, and the exposure that would bring it to ``target`` (at most 3)."""
    p = F.lag("close").over(series(by, time))
    ret = F.log(ratio(F.col("close"), p)) if log else ratio(F.col("close"), p) - 1
    panel = panel.withColumn("_r", ret)
    panel = panel.withColumn("realized_vol", roll_std("_r", window, series(by, time)) * math.sqrt(K.TRADING_DAYS))
    rv = nonzero(F.col("realized_vol"))
    return panel.withColumn("vol_scale", F.when(rv.isNotNull(), F.least(F.lit(3.0), target / rv))).drop("_r")


def parkinson(mean_sq: Column) -> Column:
    """Annualised volatility from the mean squared log of high / low."""
    return F.sqrt(mean_sq / (4 * math.log(2)) * K.TRADING_DAYS)


def add_parkinson(panel, window: int = K.PARKINSON_WINDOW, by=BY, time=TIME) -> DataFrame:
    panel = panel.withColumn("_hl", F.pow(F.log(ratio(F.col("high"), F.col("low"))), 2))
    return panel.withColumn("parkinson_vol", parkinson(roll_avg("_hl", window, series(by, time)))).drop("_hl")


def add_volume_ratio(panel, window: int = 20, surge: float = 1.5, by=BY, time=TIME) -> DataFrame:
    mean = roll_avg("volume", window, series(by, time))
    panel = panel.withColumn("volume_ratio", F.col("volume") / nonzero(mean))
    return panel.withColumn("volume_surge", holds(F.col("volume_ratio") > surge))


def add_atr_ratio(panel, period: int = K.ATR_PERIOD, window: int = 60, by=BY, time=TIME) -> DataFrame:
    """ATR against its own 60-bar mean; against itself while that mean is not there yet."""
    if "atr" not in panel.columns:
        panel = add_atr(panel, period, by=by, time=time)
    mean = F.coalesce(roll_avg("atr", window, series(by, time)), F.col("atr"))
    ratio = F.when(mean > 0, F.col("atr") / mean).otherwise(F.lit(1.0))
    return panel.withColumn("atr_ratio", ratio)


def add_drawdown(curve, value: str = "equity", by=BY, time=TIME) -> DataFrame:
    curve = curve.withColumn("peak", F.max(value).over(running(series(by, time))))
    return curve.withColumn("drawdown", ratio(F.col(value) - F.col("peak"), F.col("peak")))


def add_rolling_sharpe(curve, value: str = "equity", window: int = 63, by=BY, time=TIME) -> DataFrame:
    w = series(by, time)
    curve = curve.withColumn("_r", ratio(F.col(value), F.lag(value).over(w)) - 1)
    sharpe = roll_avg("_r", window, w) / nonzero(roll_std("_r", window, w)) * math.sqrt(K.TRADING_DAYS)
    return curve.withColumn("rolling_sharpe", sharpe).drop("_r")
