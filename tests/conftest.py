from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

DAY0 = dt.date(2020, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def walk(n: int, seed: int, symbol: str = "X", swing: float = 0.02) -> pd.DataFrame:
    """A random-walk panel of one symbol."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, swing, n)))
    open_ = np.concatenate([[100.0], close[:-1]]) * np.exp(rng.normal(0, swing / 3, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0, swing, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, swing, n))
    days = [DAY0 + dt.timedelta(days=int(k)) for k in range(n)]
    return pd.DataFrame(
        {
            "symbol": symbol,
            "dt": days,
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "volume": rng.integers(100, 1000, n).astype(float),
        }
    )


def flat(closes, symbol: str = "X") -> pd.DataFrame:
    """A panel whose bars are single prices."""
    n = len(closes)
    c = np.asarray(closes, dtype=float)
    days = [DAY0 + dt.timedelta(days=int(k)) for k in range(n)]
    return pd.DataFrame(
        {"symbol": symbol, "dt": days, "open": c, "high": c, "low": c, "close": c, "volume": np.full(n, 100.0)}
    )


def panel(spark, *frames):
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))
