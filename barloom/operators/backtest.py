"""Positions, trades, equity and risk metrics from signals.

Everything is a window over (key, time).  A trade multiplies the capital by a
factor known at its exit, so the capital path is a running product and no state
has to be carried row by row.  Input: key columns, time, close, signal and, for
volatility sizing, ``atr``.  All long only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import TIME, latest, ratio, row_index, running, series
from .signals import held

KEY = ("symbol", "strategy")


def add_position(signals, by: Sequence[str] = KEY, time: str = TIME) -> DataFrame:
    """``position`` 0/1 with the bars on which it changes."""
    w = series(by, time)
    df = signals.withColumns({"position": held("signal", w), "_prev": held("signal", w, -1)})
    return df.withColumns(
        {
            "entered": (F.col("position") == 1) & (F.col("_prev") == 0),
            "exited": (F.col("position") == 0) & (F.col("_prev") == 1),
        }
    ).drop("_prev")


def position_fraction(mode: str = "full", risk: float = 0.10, atr_mult: float = 2.0) -> Column:
    """Share of the capital put into a trade that is entered on this bar."""
    if mode == "full":
        return F.lit(1.0)
    if mode == "fixed_frac":
        return F.lit(float(risk))
    if mode == "volatility":
        sized = F.least(F.lit(1.0), ratio(risk, ratio(F.col("atr") * atr_mult, F.col("close"))))
        return F.when(F.col("atr") > 0, sized).otherwise(F.lit(float(risk)))
    raise ValueError(f"unknown position mode {mode!r}")


def equity_curve(
    signals,
    initial: float = 10_000.0,
    commission: float = 0.0,
    mode: str = "full",
    risk: float = 0.10,
    atr_mult: float = 2.0,
    by: Sequence[str] = KEY,
    time: str = TIME,
) -> DataFrame:
    """One row per bar: position, trade number, capital, equity, buy-and-hold value.

    The exit fee is charged when a trade closes, so an open trade is marked
    without it; ``closed_out`` is the capital if the bar were the last one.
    """
    w = series(by, time)
    f, c = F.col("fraction"), F.col("close")
    df = add_position(signals, by, time).withColumn("_f", position_fraction(mode, risk, atr_mult))
    df = df.withColumns(
        {
            "trade_no": F.sum(F.col("entered").cast("int")).over(running(w)),
            "entry_price": latest(F.when(F.col("entered"), c), w),
            "entry_dt": latest(F.when(F.col("entered"), F.col(time)), w),
            "fraction": latest(F.when(F.col("entered"), F.col("_f")), w),
            "buy_hold": ratio(initial * c, F.first("close").over(running(w))),
        }
    ).drop("_f")
    kept = 1 - commission
    growth = ratio(c, F.col("entry_price"))
    closed = 1 - f + f * kept * kept * growth
    df = df.withColumn("_m", F.when(F.col("exited"), closed).otherwise(F.lit(1.0)))
    df = df.withColumn("capital", initial * F.product("_m").over(running(w))).drop("_m")
    inside = F.col("position") == 1
    return df.withColumns(
        {
            "equity": F.when(inside, F.col("capital") * (1 - f + f * kept * growth)).otherwise(F.col("capital")),
            "closed_out": F.when(inside, F.col("capital") * closed).otherwise(F.col("capital")),
            "shares": F.when(F.col("entered"), ratio(F.col("capital") * f * kept, c)),
            "pnl_pct": F.when(F.col("exited"), F.round(ratio(c - F.col("entry_price"), F.col("entry_price")) * 100, 2)),
            "duration_days": F.when(F.col("exited"), F.datediff(time, "entry_dt")),
        }
    )


def round_trips(curve, by: Sequence[str] = KEY, time: str = TIME) -> DataFrame:
    """One row per trade; a trade that is still open has null exit columns."""
    moves = curve.filter(F.col("entered") | F.col("exited"))
    out = F.col("exited")
    return moves.groupBy(*by, "trade_no").agg(
        F.min("entry_dt").alias("entry_dt"),
        F.round(F.min("entry_price"), 2).alias("entry_price"),
        F.round(F.max("shares"), 4).alias("shares"),
        F.max(F.when(out, F.col(time))).alias("exit_dt"),
        F.max(F.when(out, F.round("close", 2))).alias("exit_price"),
        F.max("pnl_pct").alias("pnl_pct"),
        F.max("duration_days").alias("duration_days"),
    )


def _bar_columns(curve, by, time) -> DataFrame:
    """Per-bar inputs of the metrics: return, drawdown, lengths of the current runs."""
    w = series(by, time)
    up = running(w)
    won = F.col("exited") & (F.col("pnl_pct") > 0)
    lost = F.col("exited") & (F.col("pnl_pct") <= 0)
    df = curve.withColumns(
        {
            "_i": row_index(w),
            "_ret": ratio(F.col("equity"), F.lag("equity").over(w)) - 1,
            "_peak": F.max("equity").over(up),
            "_exits": F.sum(F.col("exited").cast("int")).over(up),
            "_won": won,
            "_lost": lost,
        }
    )
    under = F.col("equity") < F.col("_peak")
    return df.withColumns(
        {
            "_dd": ratio(F.col("equity") - F.col("_peak"), F.col("_peak")),
            "_under": F.when(under, F.col("_i") - F.coalesce(latest(F.when(~under, F.col("_i")), w), F.lit(-1))),
            "_wins": F.when(
                F.col("_won"), F.col("_exits") - F.coalesce(latest(F.when(F.col("_lost"), F.col("_exits")), w), F.lit(0))
            ),
            "_losses": F.when(
                F.col("_lost"), F.col("_exits") - F.coalesce(latest(F.when(F.col("_won"), F.col("_exits")), w), F.lit(0))
            ),
        }
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the divisor is zero or missing."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(0.0))


def metrics(
    curve, initial: float = 10_000.0, by: Sequence[str] = KEY, time: str = TIME, rounded: bool = True
) -> DataFrame:
    """Return, risk and trade metrics, one row per key, from a single aggregation of the curve."""
    df = _bar_columns(curve, by, time)
    won, lost, pnl = F.col("_won"), F.col("_lost"), F.col("pnl_pct")
    agg = df.groupBy(*by).agg(
        F.count("*").alias("bars"),
        F.min(time).alias("_t0"),
        F.max(time).alias("_t1"),
        F.min_by("equity", time).alias("_e0"),
        F.max_by("equity", time).alias("_e1"),
        F.max_by("closed_out", time).alias("_final"),
        F.max_by("buy_hold", time).alias("_bh"),
        F.count("_ret").alias("_nret"),
        F.avg("_ret").alias("_mean"),
        F.stddev_samp("_ret").alias("_sd"),
        F.stddev_samp(F.when(F.col("_ret") < 0, F.col("_ret"))).alias("_down"),
        F.min("_dd").alias("_mdd"),
        F.count("pnl_pct").alias("num_trades"),
        F.count(F.when(won, 1)).alias("_nw"),
        F.count(F.when(lost, 1)).alias("_nl"),
        F.coalesce(F.sum(F.when(won, pnl)), F.lit(0.0)).alias("_gw"),
        F.coalesce(F.abs(F.sum(F.when(lost, pnl))), F.lit(0.0)).alias("_gl"),
        F.coalesce(F.avg("duration_days"), F.lit(0.0)).alias("avg_trade_duration"),
        F.coalesce(F.max("_wins"), F.lit(0)).alias("max_consec_wins"),
        F.coalesce(F.max("_losses"), F.lit(0)).alias("max_consec_losses"),
        F.coalesce(F.max("_under"), F.lit(0)).alias("max_dd_duration"),
    )
    year = math.sqrt(K.TRADING_DAYS)
    many = F.col("_nret") > 1
    days = F.greatest(F.datediff("_t1", "_t0"), F.lit(1))
    agg = agg.withColumns(
        {
            "total_return_pct": (F.col("_final") - initial) / initial * 100,
            "buy_hold_return_pct": (F.col("_bh") / initial - 1) * 100,
            "max_drawdown_pct": F.col("_mdd") * 100,
            "annualized_return_pct": F.when(
                many, (F.pow(F.col("_e1") / F.col("_e0"), F.lit(365.25) / days) - 1) * 100
            ),
        }
    )
    n = F.col("num_trades")
    agg = agg.withColumns(
        {
            "final_capital": F.col("_final"),
            "alpha_pct": F.col("total_return_pct") - F.col("buy_hold_return_pct"),
            "sharpe_ratio": F.when(many, _ratio(F.col("_mean"), F.col("_sd")) * year).otherwise(F.lit(0.0)),
            "sortino_ratio": F.when(many, _ratio(F.col("_mean"), F.col("_down")) * year).otherwise(F.lit(0.0)),
            "calmar_ratio": F.coalesce(
                _ratio(F.col("annualized_return_pct"), F.abs("max_drawdown_pct")), F.lit(0.0)
            ),
            "win_rate_pct": _ratio(F.col("_nw") * 100.0, n),
            "no_losses": (F.col("_gl") == 0) & (F.col("_gw") > 0),
            "profit_factor": F.when(F.col("_gl") > 0, F.col("_gw") / F.col("_gl")).when(
                F.col("_gw") == 0, F.lit(0.0)
            ),
            "avg_win_pct": _ratio(F.col("_gw"), F.col("_nw")),
            "avg_loss_pct": _ratio(F.col("_gl"), F.col("_nl")),
        }
    )
    share = F.col("win_rate_pct") / 100
    agg = agg.withColumns(
        {
            "payoff_ratio": _ratio(F.col("avg_win_pct"), F.col("avg_loss_pct")),
            "expectancy": F.col("avg_win_pct") * share - F.col("avg_loss_pct") * (1 - share),
            "recovery_factor": _ratio(
                F.abs(F.round("total_return_pct", 2)), F.abs(F.round("max_drawdown_pct", 2))
            ),
        }
    )
    kelly = F.greatest(F.lit(0.0), 0.5 * (share - (1 - share) / F.col("payoff_ratio")))
    agg = agg.withColumn("kelly_fraction", F.when(F.col("payoff_ratio") > 0, kelly).otherwise(F.lit(0.0)))
    digits = METRIC_DIGITS if rounded else {}
    cols = [F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in METRIC_COLUMNS]
    return agg.select(*by, *cols)


METRIC_DIGITS = {
    "final_capital": 2,
    "total_return_pct": 2,
    "annualized_return_pct": 2,
    "buy_hold_return_pct": 2,
    "alpha_pct": 2,
    "max_drawdown_pct": 2,
    "sharpe_ratio": 3,
    "sortino_ratio": 3,
    "calmar_ratio": 3,
    "profit_factor": 2,
    "win_rate_pct": 2,
    "avg_trade_duration": 1,
    "expectancy": 2,
    "recovery_factor": 2,
    "kelly_fraction": 3,
    "payoff_ratio": 2,
    "avg_win_pct": 2,
    "avg_loss_pct": 2,
}
METRIC_COLUMNS = [
    "bars",
    *list(METRIC_DIGITS)[:12],
    "no_losses",
    "num_trades",
    "max_consec_wins",
    "max_consec_losses",
    *list(METRIC_DIGITS)[12:],
    "max_dd_duration",
]


def resample_paths(
    trades, n_sims: int = K.RESAMPLES, initial: float = 10_000.0, seed: int = 7, by: Sequence[str] = KEY
) -> DataFrame:
    """Final value and worst drawdown of every reshuffled trade order, for keys with at least three trades.

    A key's trades (at most one per two bars) are one short array; each
    simulation is a row that orders it by a hash of (seed, simulation, trade).
    The trades are shuffled once, not once per simulation, and a rerun gives the
    same orders.
    """
    closed = trades.filter("pnl_pct is not null")
    bundle = closed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("trade_no", "pnl_pct"))).alias("_t"))
    sims = bundle.filter(F.size("_t") >= 3).select(
        *by, "_t", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("sim")
    )
    head = F.concat(F.lit(f"{seed}:"), F.col("sim").cast("string"), F.lit(":"))
    shuffled = F.array_sort(
        F.transform(
            "_t",
            lambda t: F.struct(
                F.md5(F.concat(head, t["trade_no"].cast("string"))).alias("k"), (t["pnl_pct"] / 100).alias("r")
            ),
        )
    )
    start = F.struct(
        F.lit(float(initial)).alias("value"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst")
    )

    def step(acc: Column, t: Column) -> Column:
        value = acc["value"] * (1 + t["r"])
        peak = F.greatest(acc["peak"], value)
        return F.struct(
            value.alias("value"), peak.alias("peak"), F.least(acc["worst"], (value - peak) / peak).alias("worst")
        )

    sims = sims.withColumn("_end", F.aggregate(shuffled, start, step))
    return sims.select(
        *by, "sim", F.col("_end.value").alias("final_value"), (F.col("_end.worst") * 100).alias("max_drawdown_pct")
    )


def resample_summary(paths, initial: float = 10_000.0, by: Sequence[str] = KEY) -> DataFrame:
    """Percentiles over the reshuffles.  The final value does not depend on the order; the drawdown does."""
    q = paths.groupBy(*by).agg(
        F.percentile("final_value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_f"),
        F.percentile("max_drawdown_pct", F.array(F.lit(0.05), F.lit(0.5))).alias("_d"),
    )
    ret = lambda k: F.round((F.col("_f")[k] / initial - 1) * 100, 2)
    return q.select(
        *by,
        ret(1).alias("median_return"),
        ret(0).alias("p5_return"),
        ret(2).alias("p95_return"),
        F.round(F.col("_d")[1], 2).alias("median_max_dd"),
        F.round(F.col("_d")[0], 2).alias("p95_max_dd"),
    )


def histogram(df, value: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts per fixed-width bin."""
    low = F.floor(F.col(value) / width) * width
    return df.filter(F.col(value).isNotNull()).groupBy(*by, low.cast("double").alias("bin_low")).agg(
        F.count("*").alias("n")
    )


def ranked_strategies(metric_rows, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Strategies of each key by alpha, best first."""
    w = Window.partitionBy(*by).orderBy(F.col("alpha_pct").desc(), "strategy")
    return metric_rows.withColumn("alpha_rank", F.row_number().over(w))
