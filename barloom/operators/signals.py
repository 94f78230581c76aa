"""Strategy signals: -1 leave, 0 hold, +1 enter.

A strategy is a function from a panel to the same panel with an integer column
``signal``.  ``compute_signals`` runs any number of them in one pass over the
panel (one shuffle) and returns one row per key, strategy and bar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import BY, START, TIME, add_means, holds, latest, ratio, row_index, series, two_state, whole
from .indicators import (
    add_atr_ema,
    add_donchian,
    add_macd,
    add_oscillators,
    add_rsi,
    add_squeeze,
    squeeze_from,
)
from .joins import asof_calendar
from .structure import add_fractal_dimension, add_pivots, add_weekly_pivots


def leave_first(leave: Column, enter: Column) -> Column:
    """Leaving wins when both conditions hold."""
    return F.when(holds(leave), -1).when(holds(enter), 1).otherwise(0).cast("int")


def ma_crossover(panel, short: int = K.MA_SHORT, long: int = K.MA_LONG, by=BY, time=TIME) -> DataFrame:
    """+1 when the short average rises above the long one, -1 when it falls below.

    A missing average counts as not above, so the first bar with both averages
    enters if the short one is already higher.
    """
    w = series(by, time)
    panel = add_means(panel, {"_short": short, "_long": long}, by=by, time=time)
    panel = panel.withColumn("_above", holds(F.col("_short") > F.col("_long")).cast("int"))
    change = F.col("_above") - F.lag("_above").over(w)
    return panel.withColumn("signal", F.coalesce(change, F.lit(0)).cast("int")).drop("_above", "_short", "_long")


def macd_rsi(
    panel,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    rsi_period: int = 14,
    rsi_entry: float = 45.0,
    rsi_exit: float = 65.0,
    by=BY,
    time=TIME,
) -> DataFrame:
    kept = panel.columns
    panel = add_rsi(add_macd(panel, fast, slow, signal, by, time), rsi_period, "_rsi", by, time)
    return macd_rsi_rule(panel, "_rsi", rsi_entry, rsi_exit, by, time).select(*kept, "signal")


def macd_rsi_rule(panel, rsi: str = "rsi", entry: float = 45.0, leave: float = 65.0, by=BY, time=TIME) -> DataFrame:
    """Cross up while not yet strong enters; cross down or overbought leaves."""
    w = series(by, time)
    m, s = F.col("macd"), F.col("macd_signal")
    pm, ps = F.lag("macd").over(w), F.lag("macd_signal").over(w)
    up = (m > s) & (pm <= ps) & (F.col(rsi) < entry)
    down = holds((m < s) & (pm >= ps)) | holds(F.col(rsi) > leave)
    return panel.withColumn("signal", leave_first(down, up))


def bb_squeeze(
    panel, bb_period: int = 20, bb_std: float = 2.0, kc_period: int = 20, kc_mult: float = 1.5, by=BY, time=TIME
) -> DataFrame:
    kept = panel.columns
    panel = add_squeeze(panel, bb_period, bb_std, kc_period, kc_mult, by, time)
    return squeeze_rule(panel).select(*kept, "signal")


def squeeze_rule(panel) -> DataFrame:
    c = F.col("close")
    enter = F.col("squeeze_release") & (c > F.col("sq_upper"))
    return panel.withColumn("signal", leave_first(c < F.col("sq_mid"), enter))


def tsmom(
    panel,
    lookback_months: int = 12,
    skip_months: int = 1,
    multi_speed: bool = True,
    by=BY,
    time=TIME,
) -> DataFrame:
    """Sign of past returns that end ``skip_months`` ago, blended over 1, 3, 6 and 12 months.

    With a skip of one month the one-month leg is always -1 once it exists,
    because it compares a close with itself.
    """
    w = series(by, time)
    end = F.lag("close", skip_months * 21).over(w)

    def leg(months: int) -> Column:
        r = ratio(end, F.lag("close", months * 21).over(w)) - 1
        return F.when(r.isNull(), 0).when(r > 0, 1).otherwise(-1)

    if multi_speed:
        raw = F.signum(leg(1) + leg(3) + leg(6) + leg(lookback_months))
    else:
        raw = leg(lookback_months)
    return panel.withColumn("signal", raw.cast("int"))


def turtle(panel, entry_n: int = 55, exit_n: int = 20, by=BY, time=TIME) -> DataFrame:
    panel = add_donchian(panel, entry_n, exit_n, by, time)
    enter = F.col("high") > F.col("donchian_high")
    leave = F.col("low") < F.col("donchian_low")
    return panel.withColumn("signal", leave_first(leave, enter)).drop("donchian_high", "donchian_low")


def turtle_atr(panel, period: int = 20, by=BY, time=TIME) -> DataFrame:
    """The exponential true range that goes with the breakout rule, for sizing."""
    return add_atr_ema(panel, period, "turtle_atr", by, time)


def fractal_base(
    panel,
    fractal_period: int = K.PIVOT_PERIOD,
    lookbacks: Sequence[int] = (5,),
    sma_filters: Sequence[int] = (50,),
    by=BY,
    time=TIME,
    every_fd: bool = True,
) -> DataFrame:
    """Everything the fractal rule reads that no threshold changes.

    ``pivot_floor``/``pivot_ceiling`` are the newest pivots confirmed by the bar,
    without ``every_fd``, ``fd`` is there only on the bars on which it can matter to the rule (or on all, if the panel has it),
    ``recent_<n>`` tells whether a pivot low was confirmed in the last n bars,
    ``rejected`` whether a pivot high was confirmed on this very bar with the
    close below it.
    """
    p = fractal_period
    w = series(by, time)
    panel = add_pivots(panel, p, by, time)
    cols = {
        "_i": row_index(w),
        "pivot_floor": latest("pivot_low", w, -p),
        "pivot_ceiling": latest("pivot_high", w, -p),
        "_top_now": F.lag("pivot_high", p).over(w),
    }
    for n in lookbacks:
        cols[f"recent_{n}"] = F.count("pivot_low").over(w.rowsBetween(-p - n, -p)) > 0
    panel = add_means(panel, {f"_mean_{n}": n for n in sma_filters}, by=by, time=time)
    for n in sma_filters:
        cols[f"above_sma_{n}"] = holds(F.col("close") > F.col(f"_mean_{n}"))
    panel = panel.withColumns(cols).drop(*[f"_mean_{n}" for n in sma_filters])
    c = F.col("close")
    panel = panel.withColumns(
        {
            "active": F.col("_i") >= 2 * p + K.FD_WINDOW,
            "bounced": holds(c > F.col("pivot_floor")),
            "broken": holds(c < F.col("pivot_floor")),
            "rejected": F.col("_top_now").isNotNull() & holds(c < F.col("pivot_ceiling")),
        }
    ).drop("_i", "_top_now", "pivot_high", "pivot_low")
    if "fd" in panel.columns:
        return panel
    if every_fd:
        return add_fractal_dimension(panel, by=by, time=time)
    # The dimension can turn the rule only where an entry is otherwise possible, or after such a bar until one that leaves anyway.
    some = lambda prefix, ns: reduce(or_, [F.col(f"{prefix}_{n}") for n in ns], F.lit(False))
    may_enter = F.col("active") & F.col("bounced") & some("recent", lookbacks) & some("above_sma", sma_filters)
    leaves = F.col("active") & (F.col("broken") | F.col("rejected"))
    panel = panel.withColumns({"_may": may_enter, "_in": F.when(may_enter, True).when(leaves, False)})
    may_be_in = holds(F.last("_in", ignorenulls=True).over(w.rowsBetween(START, -1)))
    panel = panel.withColumn("_asked", F.col("_may") | may_be_in)
    return add_fractal_dimension(panel, by=by, time=time, only="_asked").drop("_may", "_in", "_asked")


def changes(panel, state: str, by=BY, time=TIME) -> DataFrame:
    """``signal`` as the change of a 0/1 state that starts at 0; the state column is dropped."""
    change = F.col(state) - F.lag(state, 1, 0).over(series(by, time))
    return panel.withColumn("signal", change.cast("int")).drop(state)


def fractal_rules(trending: Column, choppy: Column, recent: Column, above_sma: Column, trend_ok: Column, at=F.col) -> tuple[Column, Column]:
    """Whether the fractal rule may enter and must leave; ``at`` gives the column of a ``fractal_base`` name."""
    enter = at("active") & recent & holds(at("fd") < trending) & at("bounced") & trend_ok & above_sma
    leave = at("active") & (at("broken") | holds(at("fd") > choppy) | at("rejected"))
    return enter, leave


def fractal_state(
    panel, trending: Column, choppy: Column, recent: Column, above_sma: Column, trend_ok: Column, by=BY, time=TIME
) -> DataFrame:
    """Run the in/out automaton of the fractal rule over ``fractal_base`` columns: ``state`` 0/1."""
    enter, leave = fractal_rules(trending, choppy, recent, above_sma, trend_ok)
    panel = panel.withColumns({"_enter": enter, "_leave": leave})
    return panel.withColumn("state", two_state("_enter", "_leave", series(by, time))).drop("_enter", "_leave")


def fractal_signal(panel, *conditions: Column, by=BY, time=TIME) -> DataFrame:
    return changes(fractal_state(panel, *conditions, by=by, time=time), "state", by, time)


def fractal(
    panel,
    fractal_period: int = K.PIVOT_PERIOD,
    fd_trending_threshold: float = 1.40,
    fd_choppy_threshold: float = 1.55,
    lookback: int = 5,
    sma_filter: int = 50,
    weekly_trend: str = "asof",
    by=BY,
    time=TIME,
) -> DataFrame:
    """Enter on a bounce from a fresh pivot low in a trending market, leave on a break, regime shift or rejection.

    ``weekly_trend="final"`` uses the last weekly pivots of the whole series for
    all of its history, which looks ahead; ``"asof"`` does not.
    """
    kept = panel.columns
    panel = add_weekly_pivots(panel, trend=weekly_trend, by=by, time=time)
    panel = fractal_base(panel, fractal_period, (lookback,), (sma_filter,), by, time, every_fd=False)
    panel = fractal_signal(
        panel,
        F.lit(fd_trending_threshold),
        F.lit(fd_choppy_threshold),
        F.col(f"recent_{lookback}"),
        F.col(f"above_sma_{sma_filter}"),
        F.col("weekly_trend") >= 0,
        by=by,
        time=time,
    )
    return panel.select(*kept, "signal")


def held(signal: str | Column, w, end: int = 0) -> Column:
    """1 while in: the last decisive signal was +1.  Repeated signals change nothing.  ``end`` -1: whether the bar before was in."""
    s = F.col(signal) if isinstance(signal, str) else signal
    last = F.last(F.nullif(s, F.lit(0)), ignorenulls=True).over(w.rowsBetween(START, end))
    return holds(last == 1).cast("int")


VOTERS = ["MA Crossover", "MACD + RSI", "BB Squeeze", "TSMOM", "Turtle", "Fractal"]


def ensemble_votes(
    panel, strategies: Sequence[str] | None = None, weekly_trend: str = "asof", by=BY, time=TIME
) -> DataFrame:
    """``votes_buy``: how many strategies are in at each bar, with the rest and the share in favour."""
    names = [n for n in VOTERS if strategies is None or n in strategies]
    kept = panel.columns
    wide = _with_votes(_signals_wide(panel, names, by, time, weekly_trend), len(names), by, time)
    return wide.select(
        *kept,
        "votes_buy",
        (F.lit(len(names)) - F.col("votes_buy")).cast("int").alias("votes_sell"),
        (F.col("votes_buy") / F.lit(max(len(names), 1))).alias("confidence"),
    )


def _vote(threshold: int | Column) -> Column:
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    v = F.col("votes_buy")
    return F.when(v >= t, 1).when(v < F.greatest(F.lit(1), t - 1), -1).otherwise(0)


def ensemble_state(panel, threshold: int | Column, by=BY, time=TIME) -> DataFrame:
    """In at ``threshold`` votes, out below max(1, threshold - 1): ``state`` 0/1."""
    panel = panel.withColumn("_d", _vote(threshold))
    return panel.withColumn("state", held("_d", series(by, time))).drop("_d")


def ensemble_signal(panel, threshold: int | Column, by=BY, time=TIME) -> DataFrame:
    """``signal`` as the change of ``ensemble_state``, from one pass."""
    w = series(by, time)
    panel = panel.withColumn("_d", _vote(threshold))
    return panel.withColumn("signal", (held("_d", w) - held("_d", w, -1)).cast("int")).drop("_d")


def ensemble(
    panel, threshold: int = 3, strategies=None, weekly_trend: str = "asof", by=BY, time=TIME
) -> DataFrame:
    kept = panel.columns
    panel = ensemble_votes(panel, strategies, weekly_trend, by, time)
    return ensemble_signal(panel, threshold, by, time).select(*kept, "signal")


@dataclass(frozen=True)
class Strategy:
    """``min_bars`` is counted before any date filter."""

    name: str
    run: Callable[..., DataFrame]
    min_bars: int = 60


STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, run: Callable[..., DataFrame], min_bars: int = 60) -> None:
    """Add a strategy: ``run(panel, by=..., time=..., **params)`` adds an int column ``signal``."""
    STRATEGIES[name] = Strategy(name, run, min_bars)


register_strategy("MA Crossover", ma_crossover, 252)
register_strategy("MACD + RSI", macd_rsi)
register_strategy("BB Squeeze", bb_squeeze)
register_strategy("TSMOM", tsmom, 252)
register_strategy("Turtle", turtle)
register_strategy("Fractal", fractal)
register_strategy("Ensemble", ensemble)


_SHARED = ("MACD + RSI", "BB Squeeze")
_BUILT_IN = dict(STRATEGIES)


def _signals_wide(panel, names: Sequence[str], by, time, weekly_trend: str, params: dict | None = None) -> DataFrame:
    """One column ``_s<k>`` per strategy, all from the same partitions.

    The two strategies built on exponential means share one pass of them when
    both run with default parameters.
    """
    params = params or {}
    shared = all(n in names and not params.get(n) and STRATEGIES[n] is _BUILT_IN[n] for n in _SHARED)
    if shared:
        kept = panel.columns
        panel = add_oscillators(panel, by, time)
        panel = squeeze_from(panel, "keltner_mid", "atr_ema", by=by, time=time)
        panel = macd_rsi_rule(panel, by=by, time=time).withColumnRenamed("signal", f"_s{names.index(_SHARED[0])}")
        panel = squeeze_rule(panel).withColumnRenamed("signal", f"_s{names.index(_SHARED[1])}")
        panel = panel.select(*kept, *[f"_s{names.index(n)}" for n in _SHARED])
    for k, name in enumerate(names):
        if shared and name in _SHARED:
            continue
        kwargs = dict(params.get(name, {}))
        if STRATEGIES[name] in (_BUILT_IN["Fractal"], _BUILT_IN["Ensemble"]):
            kwargs.setdefault("weekly_trend", weekly_trend)
        panel = STRATEGIES[name].run(panel, by=by, time=time, **kwargs).withColumnRenamed("signal", f"_s{k}")
    return panel


def compute_signals(
    panel: DataFrame,
    names: Sequence[str] | None = None,
    params: dict[str, dict] | None = None,
    by: Sequence[str] = BY,
    time: str = TIME,
    keep: Sequence[str] = ("close",),
    weekly_trend: str = "asof",
) -> DataFrame:
    """Signals of several strategies in long form: key, strategy, time, ``keep``, signal.

    Keys with fewer bars than a strategy needs have no rows for it.
    """
    names = list(STRATEGIES) if names is None else list(names)
    params = dict(params or {})
    panel = panel.withColumn("_bars", F.count("*").over(whole(by)))
    # The ensemble votes with the six strategies at their defaults: run those once for both uses.
    reuse = (
        "Ensemble" in names
        and set(params.get("Ensemble", {})) <= {"threshold"}
        and not any(params.get(n) for n in VOTERS)
    )
    if not reuse:
        return _long(_signals_wide(panel, names, by, time, weekly_trend, params), names, names, by, time, keep)
    order = list(dict.fromkeys([*VOTERS, *[n for n in names if n != "Ensemble"]]))
    wide = _with_votes(_signals_wide(panel, order, by, time, weekly_trend, params), len(VOTERS), by, time)
    wide = ensemble_signal(wide, params.get("Ensemble", {}).get("threshold", 3), by, time)
    wide = wide.withColumnRenamed("signal", f"_s{len(order)}")
    return _long(wide, [*order, "Ensemble"], names, by, time, keep)


def _with_votes(wide, n: int, by, time) -> DataFrame:
    w = series(by, time)
    votes = F.lit(0)
    for k in range(n):
        votes = votes + held(f"_s{k}", w)
    return wide.withColumn("votes_buy", votes.cast("int"))


def _long(wide, columns: Sequence[str], names: Sequence[str], by, time, keep) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("strategy"),
                F.col(f"_s{columns.index(n)}").alias("signal"),
                F.lit(STRATEGIES[n].min_bars).alias("_need"),
            )
            for n in names
        ]
    )
    return (
        wide.select(*by, time, *keep, "_bars", F.inline(rows))
        .filter(F.col("_bars") >= F.col("_need"))
        .select(*by, "strategy", time, *keep, "signal")
    )


def last_cross(panel, short: int = K.MA_SHORT, long: int = K.MA_LONG, digits: int = 2, by=BY, time=TIME) -> DataFrame:
    """Per key: trend at the last bar and the newest crossover."""
    panel = add_means(ma_crossover(panel, short, long, by, time), {"_short": short, "_long": long}, by=by, time=time)
    cross = F.struct(
        F.col(time).alias("cross_dt"),
        F.when(F.col("signal") == 1, "golden_cross").otherwise("death_cross").alias("cross_type"),
        F.round("close", digits).alias("cross_price"),
    )
    out = panel.groupBy(*by).agg(
        F.max_by(F.struct("_short", "_long"), time).alias("_last"),
        F.max(F.when(F.col("signal") != 0, cross)).alias("_x"),
    )
    above = holds(F.col("_last._short") > F.col("_last._long"))
    return out.select(
        *by,
        F.when(above, "bullish").otherwise("bearish").alias("trend"),
        F.round("_last._short", digits).alias("sma_short"),
        F.round("_last._long", digits).alias("sma_long"),
        "_x.cross_type",
        "_x.cross_dt",
        "_x.cross_price",
    )


def vix_regime(v: Column) -> Column:
    regime = F.when(v.isNull(), "unknown")
    for name, upper in K.VIX_BOUNDS:
        regime = regime.when(v < upper, name)
    return regime.otherwise("crisis")


def size_multiplier(v: Column) -> Column:
    """Position size by volatility regime."""
    regime = vix_regime(v)
    size = F.lit(K.VIX_SIZE["unknown"])
    for name, value in K.VIX_SIZE.items():
        size = F.when(regime == name, F.lit(value)).otherwise(size)
    return size


def vix_filter(signals, vix: DataFrame, suppress_elevated: bool = True, time: str = TIME) -> DataFrame:
    """Take out entries in a crisis and, unless told otherwise, in elevated volatility."""
    out = asof_calendar(signals, vix, ["vix"], time).withColumn("vix_regime", vix_regime(F.col("vix")))
    barred = ["crisis", "elevated"] if suppress_elevated else ["crisis"]
    stop = F.col("vix_regime").isin(barred) & (F.col("signal") == 1)
    return out.withColumn("filtered_signal", F.when(stop, 0).otherwise(F.col("signal")))
