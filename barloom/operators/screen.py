"""Cross-sectional scans: one row per symbol, sorted lists, two-phase screen.

Lists are produced by a sort (range partitioned) or a top-n, never by numbering
rows within a bucket: a bucket such as "no signal" can hold most of the symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import BY, TIME
from . import backtest as bt
from .bars import weekly_bars, with_history
from .indicators import add_bollinger, add_rsi
from .scores import (
    add_touches,
    buy_columns,
    consensus_columns,
    factor_columns,
    newest,
    sell_columns,
    setup_array,
    setups_of,
    snapshot,
    vote_columns,
)
from .signals import ma_crossover

MIN_BARS = K.MA_LONG


def in_universe(panel: DataFrame, universe: DataFrame, by=BY) -> DataFrame:
    """Bars of the listed symbols; no size is assumed for the list, so the join type is left to the optimizer."""
    return panel.join(universe.select(*by).distinct(), list(by), "left_semi")


def _trend():
    up = F.coalesce(F.col("sma_50") > F.col("sma_200"), F.lit(False))
    return F.when(up, "bullish").otherwise("bearish").alias("ma_trend")


def scan(panel, level: str = "full", by=BY, time=TIME) -> DataFrame:
    """Scan row of every key with enough history.

    ``base``: buy signal and trend; ``enhanced``: plus factors; ``full``: plus
    sell signal, setups and consensus.
    """
    parts = {"base": ("buy", "cross"), "enhanced": ("buy", "cross", "factors")}.get(
        level, ("buy", "cross", "factors", "sell", "setups", "votes")
    )
    snap = snapshot(panel, parts, by, time).filter(F.col("bars") >= MIN_BARS)
    buy = buy_columns()
    cols = [
        *by,
        time,
        F.round("close", 2).alias("price"),
        F.round("rsi", 2).alias("rsi"),
        *[c.alias(n) for n, c in buy.items()],
        "touches",
        "touch_dates",
        *[F.round(c, 2).alias(c) for c in ("bb_lower", "bb_mid", "bb_upper")],
        _trend(),
        "cross",
    ]
    if level != "base":
        cols += [c.alias(n) for n, c in factor_columns().items()]
        cols.append(F.round("zscore", 2).alias("zscore"))
    if level == "full":
        cols += [c.alias(n) for n, c in sell_columns().items()]
        votes = vote_columns()
        snap = snap.withColumns(votes)
        cols += [*votes, *[c.alias(n) for n, c in consensus_columns().items()], setup_array().alias("setups")]
    return snap.select(*cols)


def bucketed(rows: DataFrame) -> DataFrame:
    """``bucket`` buy / sell / watch / none in this priority and a ``sort_key`` that ascends within it."""
    sell = F.col("sell_signal") if "sell_signal" in rows.columns else F.lit(False)
    score = F.col("composite_score") if "composite_score" in rows.columns else F.col("strength")
    bucket = (
        F.when(F.col("buy_signal"), "buy").when(sell, "sell").when(F.col("rsi_oversold"), "watch").otherwise("none")
    )
    key = F.when(F.col("bucket") == "watch", F.col("rsi"))
    if "sell_strength" in rows.columns:
        key = key.when(F.col("bucket") == "sell", -F.col("sell_strength"))
    return rows.withColumn("bucket", bucket).withColumn("sort_key", key.otherwise(-score))


_ORDER = {"buy": 0, "sell": 1, "watch": 2, "none": 3}


def _settled(rows: DataFrame, *by: str) -> DataFrame:
    """The rows behind a shuffle of their own: a sort reads its input twice, first for the ranges, and would run the whole scan twice."""
    return rows.repartition(*by)


def bucket_list(rows: DataFrame, by=BY) -> DataFrame:
    """All rows, bucket by bucket, best first."""
    place = F.lit(len(_ORDER))
    for name, k in _ORDER.items():
        place = F.when(F.col("bucket") == name, k).otherwise(place)
    return _settled(bucketed(rows), *by, "bucket").orderBy(place, "sort_key", *by)


def bucket_counts(rows: DataFrame) -> DataFrame:
    return bucketed(rows).groupBy("bucket").agg(F.count("*").alias("symbols"))


def setup_list(rows: DataFrame, by=BY) -> DataFrame:
    """Setups of all scanned symbols by tier and falling confidence."""
    out = setups_of(rows, "setups", [*by, "price"])
    return _settled(out, *by, "setup_rank").orderBy("tier", F.col("confidence").desc(), *by, "setup_rank")


def watchlist_scan(panel, watchlist: DataFrame, by=BY, time=TIME) -> DataFrame:
    """Buy list by strength and watch list by RSI for the listed symbols."""
    rows = bucketed(scan(in_universe(panel, watchlist, by), "base", by, time))
    return _settled(rows.filter(F.col("bucket").isin("buy", "watch")), *by, "bucket").orderBy("bucket", "sort_key", *by)


def factor_table(rows: DataFrame, by=BY) -> DataFrame:
    cols = ["price", "rsi", "bucket", "rsi_score", "zscore", "zscore_score", "volume_score", "regime"]
    return bucketed(rows).select(*by, *cols, "regime_score", "atr_score", "composite_score")


def weekly_screen(panel, rsi_below: float = 38.0, top: int = 15, by=BY, time=TIME) -> DataFrame:
    """Two phases: oversold on weekly bars, then ranked with a daily crossover backtest of the survivors only."""
    weeks = add_bollinger(add_rsi(weekly_bars(panel, by, time), by=by, time=time), by=by, time=time)
    snap = newest(add_touches(weeks, by=by, time=time), by, time)
    buy = buy_columns()
    survivors = (
        snap.filter((F.col("bars") >= 20) & (F.col("rsi") < rsi_below))
        .withColumns(buy)
        .select(*by, "close", "rsi", "strength", "buy_signal", "rsi_oversold", "touches", "bb_lower", "bb_mid", "bb_upper")
    )
    daily = with_history(panel.join(survivors.select(*by), list(by), "left_semi"), K.MA_LONG, by)
    tested = bt.metrics(bt.equity_curve(ma_crossover(daily, by=by, time=time), by=by, time=time), by=by, time=time)
    tested = tested.select(*by, "win_rate_pct", "num_trades", "total_return_pct")
    rows = survivors.join(tested, list(by), "left").na.fill(0, ["win_rate_pct", "num_trades", "total_return_pct"])
    score = F.round(F.col("strength") * 0.6 + F.col("win_rate_pct") * 0.4, 1)
    return (
        rows.withColumn("score", score)
        .orderBy(F.col("score").desc(), *by)
        .limit(top)
        .select(
            *by,
            "score",
            F.round("close", 2).alias("price"),
            F.round("rsi", 2).alias("rsi"),
            "strength",
            "buy_signal",
            "rsi_oversold",
            "touches",
            *[F.round(c, 2).alias(c) for c in ("bb_lower", "bb_mid", "bb_upper")],
            F.round("win_rate_pct", 1).alias("win_rate"),
            "num_trades",
            F.round("total_return_pct", 2).alias("bt_return"),
        )
    )
