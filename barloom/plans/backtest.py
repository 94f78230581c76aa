"""Backtest of any strategies over any number of symbols in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import BY, TIME
from ..operators import backtest as bt
from ..operators.bars import between, drop_missing_close, in_period
from ..operators.indicators import add_atr
from ..operators.signals import compute_signals


@dataclass(frozen=True)
class Backtest:
    """``curve``: a row per bar; ``trades``: a row per round trip; ``metrics``: a row per symbol and strategy."""

    curve: DataFrame
    trades: DataFrame
    metrics: DataFrame


def backtest(
    panel: DataFrame,
    strategies: Sequence[str] | None = None,
    start=None,
    end=None,
    period: str | None = None,
    params: dict[str, dict] | None = None,
    initial: float = 10_000.0,
    commission: float = 0.0,
    mode: str = "full",
    risk: float = 0.10,
    atr_mult: float = 2.0,
    by: Sequence[str] = BY,
    time: str = TIME,
    weekly_trend: str = "asof",
) -> Backtest:
    """Signals see all bars; positions start flat at the first bar of the range.

    ``atr`` for volatility sizing is measured within the range.
    """
    key = [*by, "strategy"]
    keep = ("close", "high", "low") if mode == "volatility" else ("close",)
    signals = compute_signals(drop_missing_close(panel), strategies, params, by, time, keep, weekly_trend)
    signals = between(signals, start, end, time)
    if period is not None:
        signals = in_period(signals, period, by, time)
    if mode == "volatility":
        signals = add_atr(signals, by=key, time=time)
    curve = bt.equity_curve(signals, initial, commission, mode, risk, atr_mult, key, time)
    return Backtest(curve, bt.round_trips(curve, key, time), bt.metrics(curve, initial, key, time))


def best_strategies(result: Backtest, by: Sequence[str] = BY) -> DataFrame:
    """The strategy with the highest alpha of each symbol."""
    return bt.ranked_strategies(result.metrics, by).filter(F.col("alpha_rank") == 1)
