"""Series cut into chunks give what the passes over whole series give."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.chunked import add_ewm_chunked, add_peak_chunked, add_position_chunked
from barloom.functions.ewm import Ewm, span

SCHEMA = "symbol string, dt bigint, close double, signal int, extra string"


def rows(seed: int = 3):
    rng = np.random.default_rng(seed)
    out = []
    for symbol, n in (("A", 2500), (None, 400), ("C", 1)):
        at = 0
        for _ in range(n):
            at += int(rng.choice([1, 1, 2, 300]))
            out.append((symbol, at, float(round(rng.uniform(50, 150), 2)) if rng.random() < 0.95 else None, int(rng.choice([0, 0, 0, 0, 1, -1])), "x"))
    return out


CUTS = [lambda t: F.floor(t / 7), lambda t: F.floor(t / 5000), lambda t: F.floor(t / 10**9)]


@pytest.mark.parametrize("cut", CUTS)
def test_chunks_equal_whole_series(spark, cut):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    chunk = cut(F.col("dt"))
    frame = pd.DataFrame(data, columns=["symbol", "dt", "close", "signal", "extra"])
    frame["symbol"] = frame["symbol"].fillna("")
    got = add_ewm_chunked(df, Ewm("y", "close", span(12), min_periods=3), chunk)
    got = add_peak_chunked(add_position_chunked(got, chunk), chunk).toPandas()
    assert list(got.columns) == [*frame.columns, "y", "position", "entered", "exited", "peak"] and len(got) == len(frame)
    got["symbol"] = got["symbol"].fillna("")
    got = got.sort_values(["symbol", "dt"]).reset_index(drop=True)
    for symbol, part in frame.sort_values(["symbol", "dt"]).groupby("symbol"):
        mine = got[got["symbol"] == symbol]
        want = part["close"].dropna().ewm(span=12, adjust=False, min_periods=3).mean().reindex(part.index)
        assert np.allclose(mine["y"].to_numpy(float), want.to_numpy(float), rtol=1e-11, equal_nan=True)
        held = (part["signal"].replace(0, np.nan).ffill() == 1).astype(int).to_numpy()
        before = np.concatenate([[0], held[:-1]])
        assert (mine["position"].to_numpy() == held).all()
        assert (mine["entered"].to_numpy() == ((held == 1) & (before == 0))).all() and (mine["exited"].to_numpy() == ((held == 0) & (before == 1))).all()
        assert np.allclose(mine["peak"].to_numpy(float), part["close"].cummax().ffill().to_numpy(float), equal_nan=True)


def test_no_task_holds_a_series(spark):
    """Rows are only dealt by (symbol, chunk); by symbol alone goes one row a chunk, after an aggregate."""
    df = spark.createDataFrame(rows(), SCHEMA)
    chunk = F.floor(F.col("dt") / 500)
    for out in (add_position_chunked(df, chunk), add_peak_chunked(df, chunk), add_ewm_chunked(df, Ewm("y", "close", span(12)), chunk)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan and "Aggregate" in plan
        # A window by symbol stands above the aggregate of the chunks, nowhere else.
        for i, line in enumerate(plan.splitlines()):
            if "Window [" in line and "_chunk" not in line.split("], [", 1)[1].split("]", 1)[0]:
                below = "\n".join(plan.splitlines()[i:])
                assert "Aggregate [symbol" in below
    assert add_position_chunked(df.limit(0), chunk).count() == 0
    assert add_ewm_chunked(df.limit(0), Ewm("y", "close", span(12)), chunk).count() == 0
