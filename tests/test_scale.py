"""Task sizes of the panel, and the fractal sweep on turning bars against the plain run."""

from __future__ import annotations

import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest

from barloom.operators import scores, screen
from barloom.operators import signals as G
from barloom.operators import sweep as W
from barloom.operators.structure import add_fractal_dimension
from workload import chains
from workload import tables as T

from .conftest import panel, walk


def test_panel_tasks_grow_with_the_stored_trades(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    n = 4000
    rows = pd.DataFrame(
        {
            "l_suppkey": rng.integers(1, 200, n),
            "l_shipdate": [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 300, n)],
            "l_discount": rng.integers(0, 11, n) / 100,
            "l_quantity": rng.integers(1, 50, n).astype(float),
        }
    )
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "lineitem.parquet"))
    whole = T.bars(spark, str(tmp_path)).toPandas()
    monkeypatch.setattr(T, "SLICE", 1024)
    few, many = T.bars(spark, str(tmp_path)).toPandas(), T.bars(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() > 12
    order = ["symbol", "dt"]
    pd.testing.assert_frame_equal(*(f.sort_values(order, ignore_index=True) for f in (whole, few)))


def _plain_scores(p, sweep, n=8, test=63):
    """Every set on every bar, as the other sweeps run."""
    keys = ["symbol", "param_id"]
    base = W._numbered(sweep.base(p, ["symbol"], "dt"), ["symbol"], "dt")
    run = sweep.state(W.param_sets(base, sweep.grid), keys, "dt").select(*keys, "i", "close", "state").toPandas()
    out = {}
    for key, g in run.sort_values("i").groupby(keys):
        ret = (g.close.pct_change() * g.state.shift(1)).to_numpy()
        for k in range(1, n + 1):
            end = len(g) - k * test
            if end >= max(252, len(g) // 4):
                r = ret[1:end]
                sd = r.std(ddof=1)
                out[(*key, k)] = round(r.mean() / sd * math.sqrt(252), 3) if sd > 0 else 0.0
    return out


def test_fractal_sweep_runs_on_turning_bars(spark):
    flat = walk(330, 3, "C")
    flat.loc[100:, ["open", "high", "low", "close"]] = 50.0
    p = panel(spark, walk(420, 21, "A"), walk(400, 22, "B", swing=0.05), flat)
    sweep = W.FractalSweep()
    got = {(r.symbol, r.param_id, r.fold): r.sharpe for r in W.train_scores(p, sweep).collect()}
    want = _plain_scores(p, sweep)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) <= 0.001 + 1e-9
    assert any(v != 0 for v in got.values())
    base = W._numbered(sweep.base(p, ["symbol"], "dt"), ["symbol"], "dt")
    base = base.selectExpr("*", "cast(null as int) as series")
    runs = sweep.positions(base, ["symbol"], "dt").collect()
    assert len(runs) == 3 * len(W.grid_rows(sweep.grid))
    state = sweep.state(W.param_sets(base, sweep.grid), ["symbol", "param_id"], "dt").toPandas().sort_values("i")
    turns = {k: g.i[g.state.diff().fillna(g.state) != 0].tolist() for k, g in state.groupby(["symbol", "param_id"])}
    assert {(r.symbol, r.param_id): r.turns for r in runs} == turns


def test_sweeps_with_a_costly_base_run_it_once(spark):
    """One run of the base serves training and test: no join, one scan, one shuffle of the panel's rows."""
    p = panel(spark, walk(400, 1, "A"), walk(400, 2, "B"))
    for name in ("Ensemble", "MACD + RSI"):
        plan = W.walk_forward(p, name)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1


def test_sorted_lists_do_not_run_the_scan_twice(spark):
    """A sort reads its input twice, so what it reads has to lie behind a shuffle."""
    rows = screen.scan(panel(spark, walk(300, 1, "A"), walk(300, 2, "B")))
    for out in (screen.setup_list(rows), screen.bucket_list(rows)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        sort = plan.index("rangepartitioning")
        assert "Window" not in plan[sort : plan.index("Exchange", sort)]


def test_newest_row_equals_that_of_the_whole_series(spark, monkeypatch):
    p = panel(spark, walk(900, 1, "A"), walk(310, 2, "B"), walk(120, 3, "C"), walk(40, 4, "D"))
    got = {r["symbol"]: r.asDict() for r in scores.snapshot(p).collect()}
    monkeypatch.setattr(scores, "REACH", 10**6)
    monkeypatch.setattr(scores, "LONG_REACH", 10**6)
    whole = {r["symbol"]: r.asDict() for r in scores.snapshot(p).collect()}
    assert set(got) == set("ABCD") and got == whole


def _market(spark, path):
    rng = np.random.default_rng(8)
    n = 3000
    day = lambda: [dt.datetime(2020, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 200, n)]
    trades = {
        "l_orderkey": rng.integers(1, 900, n),
        "l_partkey": rng.integers(1, 500, n),
        "l_suppkey": rng.integers(1, 9, n),
        "l_shipdate": day(),
        "l_discount": rng.integers(0, 11, n) / 100,
        "l_quantity": rng.integers(1, 50, n).astype(float),
        "l_linestatus": rng.choice(["O", "F"], n),
    }
    spark.createDataFrame(pd.DataFrame(trades)).write.parquet(str(path / "lineitem.parquet"))
    orders = {"o_orderdate": day(), "o_totalprice": rng.integers(1000, 90000, n) / 1.0}
    spark.createDataFrame(pd.DataFrame(orders)).write.parquet(str(path / "orders.parquet"))
    return str(path)


def test_measures_of_a_chain_share_their_input(spark, tmp_path):
    """The measures reuse one shuffle of whole chains: the trades are read for the contracts, the last closes and the panel."""
    df = chains.evidence(spark, _market(spark, tmp_path))
    assert len(df.collect()) == 8 * 7
    final = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert len([line for line in final.splitlines() if "FileScan" in line and "l_discount" in line]) == 3


def test_vote_rides_on_the_rows(spark, tmp_path):
    """The analysis is not joined to a second one for its votes: chains and panel are stacked once."""
    plan = chains.prediction_log(spark, _market(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1


def test_no_long_frame_is_added_up_row_by_row(spark):
    """A sliding frame costs its length at every row: means and channels are put together from short ones."""
    plan = G.compute_signals(panel(spark, walk(300, 1)))._jdf.queryExecution().optimizedPlan().toString()
    widths = [abs(int(a) - int(b)) for a, b in re.findall(r"specifiedwindowframe\(RowFrame, (-?\d+), (?:(-?\d+)|currentrow\$\(\))", plan) if b]
    widths += [abs(int(a)) for a in re.findall(r"specifiedwindowframe\(RowFrame, (-?\d+), currentrow", plan)]
    assert widths and max(widths) <= 30


def test_the_dimension_is_asked_for_only_where_it_can_turn_the_rule(spark):
    p = panel(spark, *[walk(700, s, f"S{s}", swing) for s, swing in ((1, 0.02), (2, 0.005), (3, 0.05))])
    full = add_fractal_dimension(p)
    lazy = G.fractal_base(p, every_fd=False)
    assert 0 < lazy.filter("fd is not null").count() < 0.8 * full.filter("fd is not null").count()
    for trending, choppy in ((1.40, 1.55), (1.9, 1.2), (1.2, 1.9)):
        run = lambda df: {(r["symbol"], r["dt"]): r["signal"] for r in G.fractal(df, 5, trending, choppy).collect()}  # noqa: E731, B023
        assert run(p) == run(full)
