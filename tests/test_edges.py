"""Short, flat, empty and tied inputs; causality; plan shape."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import DAY0, flat, panel, walk
from pyspark.sql import functions as F

from barloom import constants as C
from barloom.functions.ranking import running_position
from barloom.operators import bars as B
from barloom.operators import indicators as I
from barloom.operators import options as O
from barloom.operators import ranges as R
from barloom.operators import scores as Q
from barloom.operators import signals as G
from barloom.operators import structure as S
from barloom.operators import sweep as W
from barloom.operators.joins import asof_backward, asof_calendar, asof_forward
from barloom.plans.backtest import backtest, best_strategies


def one(df, *cols):
    return df.orderBy("symbol", "dt").select(*cols).toPandas()


def test_rolling_needs_a_full_frame(spark):
    p = panel(spark, walk(10, 1))
    got = one(I.add_bollinger(I.add_sma(p, (5, 20))), "sma_5", "sma_20", "bb_mid")
    assert got.sma_5.isna().sum() == 4 and got.sma_20.isna().all() and got.bb_mid.isna().all()


def test_rolling_mean_matches_pandas(spark):
    f = walk(800, 2)
    got = one(I.add_sma(panel(spark, f), (200,)), "sma_200").sma_200.astype(float)
    np.testing.assert_allclose(got.dropna(), f.close.rolling(200).mean().dropna(), rtol=1e-12)


def test_constant_prices(spark):
    p = panel(spark, flat([10.0] * 80))
    got = one(I.add_zscore(I.add_bollinger(p)), "zscore", "bb_upper", "bb_lower")
    assert got.zscore.isna().all()
    assert (got.bb_upper.dropna() == 10).all()
    fd = one(S.add_fractal_dimension(p), "fd").fd
    assert (fd.dropna() == 1.5).all() and fd.isna().sum() == 30
    assert one(S.add_pivots(p), "pivot_high").pivot_high.isna().all()
    assert S.volume_profile(p).count() == 0


def test_choppy_regime(spark):
    closes = [100 + (k % 2) for k in range(60)]
    p = S.add_fractal_dimension(panel(spark, flat(closes)))
    last = p.withColumn("r", S.market_regime(F.col("fd"))).orderBy(F.col("dt").desc()).first()
    assert last["fd"] > 1.65 and last["r"] == "choppy"
    assert one(p.withColumn("r", S.market_regime(F.col("fd"))), "r").r[0] == "unknown"


def test_equal_highs_are_no_pivot(spark):
    highs = [1, 2, 3, 5, 3, 5, 3, 2, 1, 1, 1]
    p = panel(spark, flat(highs))
    assert one(S.add_pivots(p, 2), "pivot_high").pivot_high.isna().all()
    highs[5] = 4
    got = one(S.add_pivots(panel(spark, flat(highs)), 2), "pivot_high").pivot_high
    assert got.dropna().tolist() == [5.0]


def test_gap_events_at_the_default_multiple(spark):
    f = walk(60, 3, swing=0.005)
    f.loc[40, ["open", "high", "low", "close"]] *= 1.2
    f.loc[41:, ["open", "high", "low", "close"]] *= 1.2
    got = S.anchor_events(panel(spark, f)).filter("event = 'Gap'").toPandas()
    assert got.dt.tolist() == [f.dt[40]]
    assert S.anchor_events(panel(spark, f.head(19))).count() == 0


def test_nan_and_null_closes_are_dropped(spark):
    f = walk(30, 4)
    f.loc[5, "close"] = np.nan
    assert B.drop_missing_close(panel(spark, f)).count() == 29
    with_nan = panel(spark, walk(5, 4)).withColumn("close", F.when(F.day("dt") == 3, F.lit(float("nan"))).otherwise(F.col("close")))
    assert B.drop_missing_close(with_nan).count() == 4


def test_min_history_and_last_rows(spark):
    p = panel(spark, walk(50, 5, "A"), walk(20, 6, "B"))
    assert B.with_history(p, 21).select("symbol").distinct().count() == 1
    assert B.last_rows(p, 3).count() == 6


def test_short_panels_score_zero(spark):
    p = panel(spark, walk(30, 7, "A"))
    f = Q.multi_factor_score(p).first()
    assert (f["composite_score"], f["regime"], f["atr_state"]) == (0.0, "unknown", "normal")
    s = Q.sell_signals(p).first()
    assert (s["sell_signal"], s["sell_strength"], s["active_count"]) == (False, 0.0, 0)
    assert Q.opportunities(p).count() == 0
    assert Q.strategy_consensus(p).count() == 1


def test_oversold_null_rsi_scores_zero(spark):
    b = Q.buy_signal(panel(spark, flat(np.arange(100, 160)))).first()
    assert b["buy_signal"] is False and b["strength"] == 0.0


def test_signal_on_the_first_bar_with_both_averages(spark):
    got = one(G.ma_crossover(panel(spark, flat(np.arange(1, 31))), 3, 10), "signal").signal.tolist()
    assert got[9] == 1 and sum(map(abs, got)) == 1


def test_one_month_leg_is_always_negative(spark):
    p = panel(spark, flat(np.arange(1, 60)))
    assert one(G.tsmom(p), "signal").signal.tolist()[21] == -1
    assert one(G.tsmom(p, lookback_months=2, multi_speed=False), "signal").signal.tolist()[50] == 1


def chain_rows(rows, spot=100.0):
    base = dict(symbol="X", asof_dt=dt.date(2024, 1, 2), expiry=dt.date(2024, 1, 19), spot=spot)
    return [dict(base, opt_side=s, strike=float(k), implied_vol=iv, open_interest=oi, volume=v) for s, k, iv, oi, v in rows]


QUOTE = (
    "symbol string, asof_dt date, expiry date, spot double, opt_side string, strike double, implied_vol double,"
    " open_interest bigint, volume bigint"
)


def quotes(spark, rows, spot=100.0):
    return spark.createDataFrame(chain_rows(rows, spot), QUOTE)


def test_empty_chain(spark):
    q = spark.createDataFrame([], QUOTE)
    for op in (O.gex_profile, O.oi_walls, O.max_pain, O.expected_move, O.put_call_ratios, O.iv_skew):
        assert op(q).count() == 0


def test_no_open_interest_falls_back_to_volume(spark):
    q = quotes(spark, [("C", 105, 0.2, 0, 40), ("P", 95, 0.2, 0, 60), ("C", 110, 0.2, 0, 10)])
    w = O.oi_walls(q).first()
    assert (w["activity_source"], w["strongest_call_wall"], w["strongest_put_wall"]) == ("volume", 105.0, 95.0)
    assert O.put_call_ratios(q).first()["oi_bias"] == "bearish"
    none = quotes(spark, [("C", 105, 0.2, 0, 0), ("P", 95, 0.2, 0, 0)])
    w = O.oi_walls(none).first()
    assert w["strongest_call_wall"] == pytest.approx(105.0) and w["call_walls"] == []
    assert O.max_pain(none).first()["max_pain"] == 100.0


def test_junk_volatility_falls_back(spark):
    q = quotes(spark, [("C", 100, 0.01, 5, 5), ("P", 100, 0.02, 5, 5)])
    vix = spark.createDataFrame([(dt.date(2024, 1, 1), 18.0)], "dt date, vix double")
    m = O.expected_move(q, vix).first()
    assert (m["iv_source"], m["iv_used"]) == ("VIX", 0.18)
    assert O.expected_move(q).first()["iv_source"] == "default"
    assert O.gex_profile(q).first()["net_gex"] == 0.0


def test_max_pain_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(s, k, 0.2, int(rng.integers(0, 50)), 1) for s in "CP" for k in range(80, 121)]
    strikes = sorted({k for s, k, _, oi, _ in rows if oi > 0 and 85 <= k <= 100 * 1.15})
    near = [(s, k, oi) for s, k, _, oi, _ in rows if oi > 0 and 85 <= k <= 100 * 1.15]
    pain = {K: sum((max(0, K - k) if s == "C" else max(0, k - K)) * oi for s, k, oi in near) for K in strikes}
    assert O.max_pain(quotes(spark, rows)).first()["max_pain"] == min(pain, key=lambda k: (pain[k], k))


def test_duplicate_strikes_count_once_for_gamma(spark):
    a = quotes(spark, [("C", 100, 0.2, 10, 1)])
    b = quotes(spark, [("C", 100, 0.2, 10, 1), ("C", 100, 0.3, 4, 1)])
    assert O.gex_profile(a).first()["call_gex"] == O.gex_profile(b).first()["call_gex"]


def test_skew_and_ratio_branches(spark):
    bull = quotes(spark, [("P", 90, 0.10, 10, 1), ("C", 110, 0.20, 100, 1)])
    assert O.iv_skew(bull).first()["skew_bias"] == "bullish"
    assert O.put_call_ratios(bull).first()["oi_bias"] == "bullish"
    even = quotes(spark, [("P", 90, 0.20, 80, 1), ("C", 110, 0.20, 100, 1)])
    assert O.iv_skew(even).first()["skew_bias"] == "neutral"
    assert O.put_call_ratios(even).first()["oi_bias"] == "neutral"


def test_term_structure_branches(spark):
    rows = [(20.0, 22.0), (24.0, 20.0), (20.0, 20.0), (15.0, None), (30.0, None), (20.0, None), (None, None)]
    df = spark.createDataFrame(rows, "vix double, v3 double").select(O.term_structure(F.col("vix"), F.col("v3")).alias("s"))
    assert [r.s for r in df.collect()] == [
        "contango", "backwardation", "flat", "contango", "backwardation", "flat", "unknown",
    ]


def test_bias_tie_is_neutral(spark):
    rows = [("X", "options_walls", "bullish"), ("X", "gex_levels", "bearish"), ("X", "put_call_ratio", "bearish"), ("X", "iv_skew", "bullish")]
    ev = spark.createDataFrame(rows, "symbol string, name string, bias string")
    out = R.bias_vote(ev, by=("symbol",)).first()
    assert out["bias"] == "NEUTRAL" and out["confidence"] == 50.0


def test_asof_boundaries(spark):
    left = spark.createDataFrame([("X", 1), ("X", 2), ("X", 3), ("Y", 2)], "symbol string, dt int")
    right = spark.createDataFrame([("X", 2, 20.0), ("X", 3, 30.0)], "symbol string, dt int, v double")
    back = {(r.symbol, r.dt): r.v for r in asof_backward(left, right, ["v"]).collect()}
    assert back == {("X", 1): None, ("X", 2): 20.0, ("X", 3): 30.0, ("Y", 2): None}
    fwd = {(r.symbol, r.dt): r.v for r in asof_forward(left, right, ["v"]).collect()}
    assert fwd == {("X", 1): 20.0, ("X", 2): 30.0, ("X", 3): None, ("Y", 2): None}


def test_calendar_series_before_and_after_its_range(spark):
    p = panel(spark, flat(range(1, 11)))
    day = lambda k: DAY0 + dt.timedelta(days=k)
    vix = spark.createDataFrame([(day(3), 10.0), (day(5), 40.0)], "dt date, vix double")
    got = one(asof_calendar(p, vix, ["vix"]), "vix").vix.tolist()
    assert [None if pd.isna(v) else v for v in got] == [None] * 3 + [10.0, 10.0] + [40.0] * 5
    sig = p.withColumn("signal", F.lit(1))
    f = one(G.vix_filter(sig, vix), "vix_regime", "filtered_signal")
    assert f.vix_regime.tolist() == ["unknown"] * 3 + ["low_vol"] * 2 + ["crisis"] * 5
    assert f.filtered_signal.tolist() == [1] * 5 + [0] * 5


def test_running_position_is_a_row_number(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), int(t), f"T{k}") for k, (d, t) in enumerate(zip(rng.integers(0, 5, 300), rng.integers(0, 3, 300)))]
    df = spark.createDataFrame(rows, "d int, t int, k string")
    got = running_position(df, "d", "t", "k").orderBy("position").toPandas()
    assert got.position.tolist() == list(range(1, 301))
    assert got[["d", "t"]].to_records(index=False).tolist() == sorted((d, t) for d, t, _ in rows)


def test_appending_bars_changes_nothing_before(spark):
    f = walk(330, 8)
    cut = f.head(300)
    full = G.compute_signals(panel(spark, f)).filter(F.col("dt") <= cut.dt.max())
    part = G.compute_signals(panel(spark, cut))
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def test_row_order_and_partitioning_change_nothing(spark):
    f = pd.concat([walk(300, 9, "A"), walk(280, 10, "B")])
    a = G.compute_signals(spark.createDataFrame(f))
    b = G.compute_signals(spark.createDataFrame(f.sample(frac=1, random_state=1)).repartition(7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_registered_strategy_takes_part(spark):
    def always(panel, by=("symbol",), time="dt"):
        return panel.withColumn("signal", F.lit(1))

    G.register_strategy("Always", always, 5)
    try:
        r = backtest(panel(spark, walk(80, 11)), ["Always", "Turtle"], period="1M")
        m = {x.strategy: x for x in r.metrics.collect()}
        assert m["Always"].alpha_pct == pytest.approx(0.0, abs=0.01)
        assert best_strategies(r).count() == 1
    finally:
        del G.STRATEGIES["Always"]


def test_grid_order(spark):
    g = W.grid_rows(C.PARAM_GRIDS["Fractal"])
    assert len(g) == 108 and g[0] == (1.30, 1.50, 20, 3) and g[1] == (1.30, 1.50, 20, 5)


def test_folds_need_a_year_of_training(spark):
    p = panel(spark, walk(252 + 63 * 2, 12, "A"), walk(300, 13, "B"))
    got = W.folds(p).toPandas()
    assert got[got.symbol == "A"].fold.tolist() == [1, 2] and not (got.symbol == "B").any()
    assert got[got.symbol == "A"].test_end.tolist() == [378, 315]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_join_and_no_python(spark):
    p = panel(spark, walk(300, 14)).repartition(2)
    for df in (
        backtest(p).metrics,
        Q.snapshot(p),
        W.train_scores(p, W.FractalSweep()),
        S.volume_profile(p),
    ):
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def S_week(day):
    """The Sunday that ends a day's week."""
    return day + dt.timedelta(days=6 - day.weekday())


def test_indicator_pass_shuffles_once(spark):
    p = panel(spark, walk(300, 15)).repartition(2)
    text = plan(I.add_atr_ratio(I.add_zscore(I.add_bollinger(I.add_oscillators(p)))))
    assert text.count("Exchange hashpartitioning") == 1


def test_all_signals_shuffle_once(spark):
    """The weekly trend included: with broadcasts off no join is left to shuffle for."""
    p = panel(spark, walk(300, 15)).repartition(2)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(G.compute_signals(p))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


@pytest.mark.parametrize("trend", ["asof", "final"])
@pytest.mark.parametrize("seed", [1, 2])
def test_weekly_values_on_days_equal_a_loop(spark, trend, seed):
    """Days against the weekly rows: gaps of weeks, a week without volume, Sundays."""
    rng = np.random.default_rng(seed)
    bars = walk(420, seed, swing=0.03)
    bars = bars[rng.random(len(bars)) < 0.6]
    bars = bars[(bars.index < 150) | (bars.index > 185)].copy()
    lost = [S_week(d) == S_week(bars["dt"].iloc[80]) for d in bars["dt"]]
    bars.loc[lost, "volume"] = np.nan
    df = panel(spark, bars)
    df = df.withColumn("volume", F.nanvl("volume", F.lit(None).cast("double")))
    got = S.add_weekly_pivots(df, 2, trend).orderBy("dt").collect()
    weeks = S.weekly_pivots(df, 2, trend).orderBy("dt").collect()
    whole = {w["dt"]: w for w in weeks}
    assert any(w["weekly_pivot_low"] for w in weeks) and len(got) == len(bars)
    for r in got:
        seen = [w for w in weeks if w["dt"] <= r["dt"]]
        want = (seen[-1]["weekly_pivot_high"], seen[-1]["weekly_pivot_low"], seen[-1]["weekly_trend"]) if seen else (None, None, 0)
        assert (r["weekly_pivot_high"], r["weekly_pivot_low"], r["weekly_trend"]) == want
    assert S_week(bars["dt"].iloc[80]) not in whole
