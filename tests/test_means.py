"""Exponential means against pandas, on series that span several blocks."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import DAY0, flat, panel, walk
from pyspark.sql import functions as F

from barloom.functions.ewm import Ewm, add_ewm, span
from barloom.functions.windows import add_extremes, add_means
from barloom.operators.indicators import add_macd, add_oscillators, add_rsi
from barloom.operators.joins import asof_backward
from barloom.operators.ranges import STRUCTURE, add_price_structure, asof_price_structure


def rows(df, *cols):
    return df.orderBy("symbol", "dt").select(*cols).toPandas()


@pytest.mark.parametrize("alpha", [1 / 14, 2 / 27, 2 / 10, 0.5])
def test_long_series(spark, alpha):
    a, b = walk(3000, 1, "A"), walk(129, 2, "B")
    got = rows(add_ewm(panel(spark, a, b), [Ewm("y", "close", alpha)]), "symbol", "y")
    for s, frame in (("A", a), ("B", b)):
        want = frame["close"].ewm(alpha=alpha, adjust=False).mean().to_numpy()
        np.testing.assert_allclose(got[got.symbol == s]["y"], want, rtol=1e-12)


def test_very_different_rates_do_not_share_a_block(spark):
    a = walk(700, 3)
    got = rows(add_ewm(panel(spark, a), [Ewm("slow", "close", span(200)), Ewm("fast", "close", 0.9)]), "slow", "fast")
    np.testing.assert_allclose(got["slow"], a["close"].ewm(span=200, adjust=False).mean(), rtol=1e-12)
    np.testing.assert_allclose(got["fast"], a["close"].ewm(alpha=0.9, adjust=False).mean(), rtol=1e-12)


def test_constant_start_is_exact(spark):
    closes = [50.0] * 40 + [51.0, 52.0]
    m = rows(add_macd(panel(spark, flat(closes))), "macd", "macd_signal")
    assert (m["macd"][:40] == 0).all() and (m["macd_signal"][:40] == 0).all()
    assert m["macd"].iloc[-1] > 0


def wilder(close: pd.Series, n: int = 14) -> pd.Series:
    d = close.diff()
    up = d.clip(lower=0).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
    down = (-d).clip(lower=0).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
    return 100 - 100 / (1 + up / down.replace(0, np.nan))


@pytest.mark.parametrize("n", [10, 14, 15, 20, 2000])
def test_rsi(spark, n):
    a = walk(n, 4)
    got = rows(add_rsi(panel(spark, a)), "rsi")["rsi"].astype(float)
    want = wilder(a["close"])
    assert got.isna().tolist() == want.isna().tolist()
    np.testing.assert_allclose(got.dropna(), want.dropna(), rtol=1e-9)


def test_rsi_is_null_without_losses(spark):
    got = rows(add_rsi(panel(spark, flat(np.arange(1, 60)))), "rsi")["rsi"]
    assert got.isna().all()


def test_oscillators_equal_the_single_functions(spark):
    p = panel(spark, walk(900, 5, "A"), walk(60, 6, "B"))
    together = add_oscillators(p).select("symbol", "dt", "macd", "macd_signal", "rsi")
    apart = add_rsi(add_macd(p)).select("symbol", "dt", "macd", "macd_signal", "rsi")
    both = together.alias("a").join(apart.alias("b"), ["symbol", "dt"])
    worst = both.select(
        *[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(c) for c in ("macd", "macd_signal", "rsi")]
    ).first()
    assert max(worst) < 1e-9


@pytest.mark.parametrize("price", [101.37, 33.33, 0.1, 0.123])
def test_flat_decimal_prices_give_no_signal(spark, price):
    from barloom.operators import signals as G
    from barloom.operators.indicators import add_bollinger
    from conftest import flat, panel, walk

    moving = walk(260, 3)["close"].tolist()
    for closes, quiet_from in (([price] * 600, 1), (moving + [price] * 400, 470)):
        df = panel(spark, flat(closes))
        for signals in (G.ma_crossover(df), G.bb_squeeze(df)):
            got = [r["signal"] for r in signals.orderBy("dt").collect()]
            assert not any(got[quiet_from:])
        last = add_bollinger(df).orderBy("dt").tail(1)[0]
        assert last["bb_mid"] == last["bb_upper"] == last["bb_lower"] == price


def test_zero_and_infinite_values_do_no_lasting_harm(spark):
    from barloom.operators import indicators as I
    from barloom.operators import signals as G
    from barloom.operators.bars import without_nan
    from barloom.plans.backtest import backtest
    from conftest import panel, walk

    bad = walk(400, 5)
    bad.loc[30, ["close", "low"]] = 0.0
    bad.loc[40, "volume"] = float("inf")
    df = without_nan(panel(spark, bad))
    out = df
    for add in (I.add_lags, I.add_sma, I.add_bollinger, I.add_realized_vol, I.add_parkinson, I.add_volume_ratio, I.add_vwap, I.add_zscore):
        out = add(out)
    row = out.orderBy("dt").tail(1)[0].asDict()
    assert all(v is not None and v == v for v in row.values())
    assert backtest(df, list(G.STRATEGIES)).metrics.count() == len(G.STRATEGIES)


def test_structure_never_looks_ahead(spark):
    """Cutting the panel at a day changes nothing that was known on it."""
    whole = panel(spark, walk(200, 5, "A"), walk(150, 6, "B"))
    full = add_price_structure(whole).select("symbol", "dt", *[F.round(c, 9).alias(c) for c in STRUCTURE])
    for days in (25, 70, 71, 74, 120):
        day = DAY0 + dt.timedelta(days=days)
        cut = add_price_structure(whole.filter(F.col("dt") <= F.lit(day))).filter(F.col("dt") == F.lit(day))
        then = cut.select("symbol", "dt", *[F.round(c, 9).alias(c) for c in STRUCTURE])
        assert sorted(map(tuple, then.collect())) == sorted(map(tuple, full.filter(F.col("dt") == F.lit(day)).collect()))


def test_structure_of_the_days_that_are_read(spark):
    """Bars out of every snapshot's reach are left out of the costly windows; the values stay those of the whole panel."""
    whole = panel(spark, walk(400, 5, "A"), walk(150, 6, "B"), walk(8, 7, "C"))
    read = [("A", 3), ("A", 130), ("A", 131), ("A", 131), ("A", 390), ("A", 900), ("B", -5), ("B", 149), ("C", 6), ("D", 50)]
    days = spark.createDataFrame([(s, DAY0 + dt.timedelta(days=d), i) for i, (s, d) in enumerate(read)], "symbol string, day date, n int")
    shown = ["n", *[F.round(c, 9).alias(c) for c in STRUCTURE]]
    bars = add_price_structure(whole).withColumnRenamed("dt", "day")
    want = asof_backward(days, bars, STRUCTURE, ("symbol",), "day").select(*shown).orderBy("n").collect()
    got = asof_price_structure(days, whole, at="day").select(*shown).orderBy("n").collect()
    assert len(got) == len(read) and got == want


def test_extremes_and_long_means_equal_loops(spark):
    values = [None if i in (70, 71, 160) else float((i * 37) % 101) for i in range(330)] + [1e15] + [0.1 * (i % 7) for i in range(300)]
    df = spark.createDataFrame([("X", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate(values)], "symbol string, dt date, close double")
    sizes = (1, 2, 3, 20, 55)
    asked = {f"{name}_{n}": (fn, "close", n) for n in sizes for name, fn in (("top", F.max), ("low", F.min))}
    out = add_extremes(add_means(df, {f"m_{n}": n for n in (40, 50, 55, 200)}), asked).orderBy("dt").collect()
    for i, r in enumerate(out):
        for n in sizes:
            part = values[max(i - n, 0) : i]
            there = len(part) == n and None not in part
            assert (r[f"top_{n}"], r[f"low_{n}"]) == ((max(part), min(part)) if there else (None, None))
        for n in (40, 50, 55, 200):
            part = values[max(i - n + 1, 0) : i + 1]
            want = sum(part) / n if len(part) == n and None not in part else None
            assert r[f"m_{n}"] == (want if want is None else pytest.approx(want, rel=1e-13))
