"""Per-symbol scores of the newest bar, and the confluence score of every bar.

``snapshot`` makes one pass over the panel and keeps the last row of every key
with all the indicators the scores read; the scores themselves are column
arithmetic on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import BY, TIME, add_means, holds, ratio, row_index, series, whole
from .indicators import (
    add_atr,
    add_atr_ratio,
    add_bandwidth_floor,
    add_bollinger,
    add_ema,
    add_keltner,
    add_oscillators,
    add_rsi,
    add_volume_ratio,
    add_zscore,
    squeeze_from,
)
from .signals import ma_crossover, macd_rsi_rule, squeeze_rule, tsmom, turtle
from .structure import add_fractal_dimension, level_arrays, market_regime

MIN_BARS = 60


def add_touches(panel, lookback: int = K.BB_WICK_LOOKBACK, by=BY, time=TIME) -> DataFrame:
    """How many of the last bars reached the lower band, and when."""
    frame = series(by, time).rowsBetween(-(lookback - 1), 0)
    panel = panel.withColumn("_hit", holds(F.col("low") <= F.col("bb_lower")))
    return panel.withColumns(
        {
            "touches": F.count(F.when(F.col("_hit"), 1)).over(frame),
            "touch_dates": F.collect_list(F.when(F.col("_hit"), F.col(time))).over(frame),
        }
    ).drop("_hit")


def newest(panel, by=BY, time=TIME) -> DataFrame:
    """Last row of every key, with the number of bars."""
    panel = panel.withColumns({"_i": row_index(series(by, time)), "bars": F.count("*").over(whole(by))})
    return panel.filter(F.col("_i") == F.col("bars") - 1).drop("_i")


#: Bars that the newest one's values look back on: the 60-bar mean of the average true range goes back furthest but for
#: the long mean and the momentum over a year that ended a month ago.
REACH = max(60 + K.ATR_PERIOD, K.ZSCORE_WINDOW, 2 * K.BB_PERIOD, K.BB_PERIOD + K.BB_WICK_LOOKBACK, 55, K.FD_WINDOW) + 10
LONG_REACH = max(K.MA_LONG, 13 * 21) + 10

ALL_PARTS = ("buy", "sell", "factors", "setups", "votes", "cross")


def snapshot(panel, parts=ALL_PARTS, by=BY, time=TIME) -> DataFrame:
    """Newest bar of every key with the indicators that ``parts`` need."""
    need = set(parts)
    w = series(by, time)
    panel = panel.withColumn("prev_close", F.lag("close").over(w))
    # What depends on the whole series comes first: exponential means and the newest crossover.
    if "votes" in need:
        panel = add_oscillators(panel, by, time)
    elif need & {"buy", "sell", "factors", "setups"}:
        panel = add_rsi(panel, by=by, time=time)
    if "sell" in need and "keltner_mid" not in panel.columns:
        panel = add_ema(panel, (K.KELTNER_EMA,), by=by, time=time).withColumnRenamed(f"ema_{K.KELTNER_EMA}", "keltner_mid")
    if "cross" in need:
        panel = ma_crossover(panel, by=by, time=time)
        event = F.struct(
            F.col(time).alias("cross_dt"),
            F.when(F.col("signal") == 1, "golden_cross").otherwise("death_cross").alias("cross_type"),
            F.col("close").alias("cross_price"),
        )
        panel = panel.withColumn("cross", F.max(F.when(F.col("signal") != 0, event)).over(whole(by))).drop("signal")
    # The rest looks back so many bars at most, so only those that the newest bar's values reach are gone through.
    panel = panel.withColumn("bars", F.count("*").over(whole(by)))
    panel = panel.withColumn("_age", F.col("bars") - 1 - row_index(w)).filter(F.col("_age") < LONG_REACH)
    if need & {"setups", "votes", "cross"}:
        panel = add_means(panel, {"sma_50": K.MA_SHORT, "sma_200": K.MA_LONG}, by=by, time=time)
    if "votes" in need:
        panel = tsmom(panel, by=by, time=time).withColumnRenamed("signal", "s_tsmom")
    panel = panel.filter(F.col("_age") < REACH)
    if need & {"buy", "sell", "setups", "votes"}:
        panel = add_bollinger(panel, by=by, time=time)
    if need & {"buy", "votes"}:
        panel = add_touches(panel, by=by, time=time)
    if "setups" in need:
        panel = add_bandwidth_floor(panel, by=by, time=time)
    if need & {"sell", "factors", "setups"}:
        panel = add_zscore(panel, by=by, time=time)
    if "sell" in need:
        panel = add_atr(panel, K.KELTNER_ATR, "_katr", by, time)
        upper = F.col("keltner_mid") + K.KELTNER_MULT * F.col("_katr")
        panel = panel.withColumn("keltner_upper", upper).drop("_katr")
    if need & {"factors", "setups"}:
        panel = add_volume_ratio(add_atr_ratio(panel, by=by, time=time), by=by, time=time)
        panel = add_fractal_dimension(panel, by=by, time=time)
    if "votes" in need:
        panel = macd_rsi_rule(panel, by=by, time=time).withColumnRenamed("signal", "s_macd_rsi")
        panel = squeeze_from(panel, "keltner_mid", "atr_ema", by=by, time=time)
        panel = squeeze_rule(panel).withColumnRenamed("signal", "s_squeeze")
        panel = turtle(panel, by=by, time=time).withColumnRenamed("signal", "s_turtle")
    return panel.filter(F.col("_age") == 0).drop("_age")


# ---- buy --------------------------------------------------------------------------


def buy_columns(
    threshold: float = K.RSI_OVERSOLD, lookback: int = K.BB_WICK_LOOKBACK, min_touches: int = 1
) -> dict[str, Column]:
    """Oversold with a touch of the lower band; strength 0-100 from depth and touches."""
    oversold = holds(F.col("rsi") < threshold)
    touched = F.col("touches") >= min_touches
    depth = F.coalesce(F.greatest(F.lit(0.0), threshold - F.col("rsi")), F.lit(0.0)) / threshold * 50
    often = F.least(F.col("touches") / lookback, F.lit(1.0)) * 50
    return {
        "buy_signal": oversold & touched,
        "strength": F.round(F.when(F.col("rsi").isNull(), 0.0).otherwise(depth) + often, 1),
        "rsi_oversold": oversold,
        "touched_band": touched,
    }


def buy_signal(
    panel,
    threshold: float = K.RSI_OVERSOLD,
    lookback: int = K.BB_WICK_LOOKBACK,
    min_touches: int = 1,
    by=BY,
    time=TIME,
) -> DataFrame:
    panel = add_bollinger(add_rsi(panel, by=by, time=time), by=by, time=time)
    snap = newest(add_touches(panel, lookback, by, time), by, time)
    cols = buy_columns(threshold, lookback, min_touches)
    prices = ["close", "bb_lower", "bb_mid", "bb_upper"]
    return snap.withColumns(cols).select(
        *by, time, *cols, F.round("rsi", 2).alias("rsi"), *[F.round(c, 2).alias(c) for c in prices], "touches", "touch_dates"
    )


# ---- sell -------------------------------------------------------------------------


def sell_columns() -> dict[str, Column]:
    """Overbought conditions of the newest bar; two of four make a signal."""
    enough = F.col("bars") >= MIN_BARS
    z = F.coalesce(F.col("zscore"), F.lit(0.0))
    hot = enough & holds(F.col("rsi") > 70)
    far = enough & (z > 2.0)
    over_k = enough & holds(F.col("close") >= F.col("keltner_upper"))
    over_b = enough & holds(F.col("close") >= F.col("bb_upper"))
    active = sum((c.cast("int") for c in (hot, far, over_k, over_b)), F.lit(0))
    points = (
        F.when(hot, F.least(F.lit(30.0), F.col("rsi") - 70)).otherwise(0.0)
        + F.when(far, F.least(F.lit(30.0), (z - 2.0) * 15)).otherwise(0.0)
        + F.when(over_k, 20.0).otherwise(0.0)
        + F.when(over_b, 20.0).otherwise(0.0)
    )
    return {
        "rsi_overbought": hot,
        "zscore_extended": far,
        "above_keltner": over_k,
        "above_bb_upper": over_b,
        "active_count": active.cast("int"),
        "sell_signal": active >= 2,
        "sell_strength": F.round(F.least(F.lit(100.0), points), 1),
    }


def sell_signals(panel, by=BY, time=TIME) -> DataFrame:
    cols = sell_columns()
    return snapshot(panel, ("sell",), by, time).withColumns(cols).select(
        *by, time, *cols, "rsi", "zscore", "bb_upper", "keltner_upper"
    )


# ---- factors ----------------------------------------------------------------------


def _capped(points: Column, top: float, when: Column) -> Column:
    return F.when(holds(when), F.greatest(F.lit(0.0), F.least(F.lit(top), points))).otherwise(F.lit(0.0))


def current_fd() -> Column:
    return F.coalesce(F.col("fd"), F.lit(1.5))


def factor_columns() -> dict[str, Column]:
    """Five factors and their weighted sum, 0-100; zero for keys with too few bars."""
    enough = F.col("bars") >= MIN_BARS
    rsi, z = F.col("rsi"), F.coalesce(F.col("zscore"), F.lit(0.0))
    vol, atr = F.coalesce(F.col("volume_ratio"), F.lit(1.0)), F.col("atr_ratio")
    regime = F.when(enough, market_regime(current_fd())).otherwise("unknown")
    regime_points = F.lit(5.0)
    for name, points in K.REGIME_POINTS.items():
        regime_points = F.when(regime == name, F.lit(points)).otherwise(regime_points)
    scores = {
        "rsi": (_capped((30 - rsi) * 25 / 30, 25.0, enough & (rsi < 30)), 25),
        "zscore": (_capped(F.abs(z) * 12.5, 25.0, enough & (z < -1)), 25),
        "volume": (_capped((vol - 1) * 15, 15.0, enough & (vol > 1)), 15),
        "regime": (F.when(enough, regime_points).otherwise(F.lit(0.0)), 20),
        "atr": (_capped((1 - atr) * 30, 15.0, enough & (atr < 1)), 15),
    }
    raw = sum((s / top * K.SCAN_WEIGHTS[k] for k, (s, top) in scores.items()), F.lit(0.0))
    state = (
        F.when(enough & holds(atr < 0.7), "contracted").when(enough & holds(atr > 1.3), "expanded").otherwise("normal")
    )
    return {
        "composite_score": F.round(raw * 100, 1),
        **{f"{k}_score": F.round(s, 1) for k, (s, _) in scores.items()},
        "volume_surge": enough & (vol > 1.5),
        "regime": regime,
        "atr_state": state,
    }


def multi_factor_score(panel, by=BY, time=TIME) -> DataFrame:
    cols = factor_columns()
    snap = snapshot(panel, ("factors",), by, time)
    # The ratio already has this name as a per-bar flag; the score's flag also asks for enough bars.
    return snap.drop("volume_surge").withColumns(cols).select(*by, time, *cols, F.round("zscore", 2).alias("zscore"))


# ---- setups -----------------------------------------------------------------------


def _setup(order: int, when: Column, name, direction, tier: int, confidence, reason) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.when(
        holds(when),
        F.struct(
            F.lit(tier).alias("tier"),
            (-F.round(conf, 0)).cast("int").alias("_rank"),
            F.lit(order).alias("_order"),
            lit(name).alias("setup"),
            lit(direction).alias("direction"),
            F.round(conf, 0).cast("int").alias("confidence"),
            lit(reason).alias("reason"),
        ),
    )


def setup_array() -> Column:
    """Tradeable setups of the newest bar, by tier and falling confidence."""
    enough = F.col("bars") >= MIN_BARS
    z, rsi, c = F.coalesce(F.col("zscore"), F.lit(0.0)), F.col("rsi"), F.col("close")
    fd = current_fd()
    regime = market_regime(fd)
    vol, atr = F.coalesce(F.col("volume_ratio"), F.lit(1.0)), F.col("atr_ratio")
    bw = F.coalesce(F.col("bandwidth"), F.lit(0.0))
    s50, s200 = F.coalesce(F.col("sma_50"), c), F.coalesce(F.col("sma_200"), c)
    pct = ratio(c - F.col("prev_close"), F.col("prev_close")) * 100
    lean = F.when(z < 0, "long").otherwise("short")
    z_conf = F.least(F.lit(90.0), 50 + F.abs(z) * 20)
    v_conf = 55 + F.least(F.lit(20.0), vol * 5)
    z_text = F.format_string("z-score %.2f", z)
    rsi_text = F.format_string("RSI %.1f", rsi)
    fd_text = F.format_string("%s market, dimension %.2f", regime, fd)
    vol_text = F.format_string("%.1f%% on %.1f times the usual volume", pct, vol)
    golden = s50 > s200
    rows = [
        (z <= -1.5, "Z-Score Mean Reversion", "long", 1, z_conf, z_text),
        (z >= 1.5, "Z-Score Mean Reversion", "short", 1, z_conf, z_text),
        (rsi.between(30, 35), "RSI Approaching Oversold", "long", 1, 60 + (35 - rsi) * 6, rsi_text),
        (rsi.between(65, 70), "RSI Approaching Overbought", "short", 1, 60 + (rsi - 65) * 6, rsi_text),
        (
            (bw > 0) & (bw <= F.coalesce(F.col("bandwidth_min"), bw) * 1.05),
            "Bollinger Squeeze",
            lean,
            1,
            65,
            "bandwidth near its 20-bar low",
        ),
        ((regime == "trending") & (c > s50) & (s50 > s200), "Trend Continuation", "long", 2, 70, fd_text),
        ((regime == "trending") & (c < s50) & (s50 < s200), "Trend Continuation", "short", 2, 70, fd_text),
        ((vol > 1.5) & (pct > 0.5), "Volume Breakout", "long", 2, v_conf, vol_text),
        ((vol > 1.5) & (pct < -0.5), "Volume Breakdown", "short", 2, v_conf, vol_text),
        (
            atr < 0.7,
            "ATR Contraction (Coiled Spring)",
            lean,
            2,
            60,
            F.format_string("ATR at %.0f%% of its 60-bar mean", atr * 100),
        ),
        ((regime == "choppy") & (F.abs(z) > 1), "Regime Mean Reversion", lean, 2, 65, fd_text),
        (
            (s50 > 0) & (s200 > 0) & (F.abs((s50 - s200) / s200) < 0.01),
            F.when(golden, "Golden Cross Imminent").otherwise("Death Cross Imminent"),
            F.when(golden, "long").otherwise("short"),
            3,
            45,
            "averages within 1%",
        ),
    ]
    built = [_setup(k, enough & row[0], *row[1:]) for k, row in enumerate(rows)]
    return F.array_sort(F.filter(F.array(*built), lambda s: s.isNotNull()))


def opportunities(panel, by=BY, time=TIME) -> DataFrame:
    """One row per key and setup, with its place among the key's setups."""
    snap = snapshot(panel, ("setups",), by, time).select(*by, time, "close", setup_array().alias("_s"))
    return setups_of(snap, "_s", [*by, time, "close"])


def setups_of(rows: DataFrame, column: str, keep) -> DataFrame:
    out = rows.select(*keep, F.posexplode(column).alias("setup_rank", "_o"))
    return out.select(
        *keep,
        (F.col("setup_rank") + 1).alias("setup_rank"),
        "_o.setup",
        "_o.direction",
        "_o.tier",
        "_o.confidence",
        "_o.reason",
    )


def conflicts(setups, by=BY) -> DataFrame:
    """Keys whose setups point both ways."""
    both = F.min("direction") != F.max("direction")
    return setups.groupBy(*by).agg(both.alias("conflicted"), F.count("*").alias("setups"))


# ---- consensus --------------------------------------------------------------------



def vote_columns() -> dict[str, Column]:
    """Newest signal of six strategies; the moving averages vote with their trend and are never neutral."""
    trend = F.when(holds(F.col("sma_50") > F.col("sma_200")), 1).otherwise(-1)
    buy = buy_columns()["buy_signal"]
    reversal = F.when(buy, 1).when(holds(F.round("rsi", 2) > 70), -1).otherwise(0)
    signals = [trend, reversal, F.col("s_macd_rsi"), F.col("s_squeeze"), F.col("s_tsmom"), F.col("s_turtle")]
    names = ["vote_ma", "vote_rsi_bb", "vote_macd_rsi", "vote_squeeze", "vote_tsmom", "vote_turtle"]
    return dict(zip(names, [s.cast("int") for s in signals]))


def consensus_columns() -> dict[str, Column]:
    """Counts and verdict from the vote columns; bullish is tested first."""
    votes = [F.col(c) for c in vote_columns()]
    bull = sum(((v > 0).cast("int") for v in votes), F.lit(0))
    bear = sum(((v < 0).cast("int") for v in votes), F.lit(0))
    return {
        "bullish_count": bull.cast("int"),
        "bearish_count": bear.cast("int"),
        "neutral_count": (len(votes) - bull - bear).cast("int"),
        "consensus": F.when(bull >= 3, "bullish").when(bear >= 3, "bearish").otherwise("mixed"),
    }


def strategy_consensus(panel, by=BY, time=TIME) -> DataFrame:
    votes, verdict = vote_columns(), consensus_columns()
    snap = snapshot(panel, ("votes",), by, time).withColumns(votes).withColumns(verdict)
    return snap.select(*by, time, *votes, *verdict)


# ---- confluence -------------------------------------------------------------------


def confluence(panel, levels: int = 5, by=BY, time=TIME) -> DataFrame:
    """Score -5..5 of every bar from RSI, z-score, Keltner channel, pivot levels and volume.

    The levels are the newest of the whole series, so only the last bar's score
    is free of lookahead.
    """
    near = level_arrays(panel, levels, by=by, time=time)
    panel = add_zscore(add_keltner(add_rsi(panel, by=by, time=time), by=by, time=time), by=by, time=time)
    panel = add_volume_ratio(panel, by=by, time=time).join(near, list(by), "left")
    c = F.col("close")

    def close_to(levels_col: str) -> Column:
        return holds(F.exists(levels_col, lambda v: ratio(F.abs(c - v["price"]), c) < 0.01))

    flags = {
        "rsi_buy": holds(F.col("rsi") < 30),
        "rsi_sell": holds(F.col("rsi") > 70),
        "zscore_buy": holds(F.col("zscore") <= -2),
        "zscore_sell": holds(F.col("zscore") >= 2),
        "keltner_buy": holds(c <= F.col("keltner_lower")),
        "keltner_sell": holds(c >= F.col("keltner_upper")),
        "fractal_buy": close_to("supports"),
        "fractal_sell": close_to("resistances"),
    }
    panel = panel.withColumns(flags)
    score = F.lit(0)
    for kind in ("rsi", "zscore", "keltner", "fractal"):
        score = score + F.col(f"{kind}_buy").cast("int") - F.col(f"{kind}_sell").cast("int")
    surge = F.col("volume_surge").cast("int") * F.coalesce(F.signum(c - F.col("open")), F.lit(0.0)).cast("int")
    panel = panel.withColumn("signal_score", (score + surge).cast("int"))
    s = F.col("signal_score")
    label = (
        F.when(s >= 2, "strong_buy").when(s == 1, "buy").when(s == 0, "neutral").when(s == -1, "sell")
    ).otherwise("strong_sell")
    return panel.withColumn("signal_label", label).select(
        *by, time, *flags, "volume_surge", "signal_score", "signal_label"
    )
