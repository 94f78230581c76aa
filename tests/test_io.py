"""Sources, sinks, logs and the stream."""

from __future__ import annotations

import datetime as dt
import json

from conftest import panel, walk
from pyspark.sql import functions as F

from barloom.operators import feedback as L
from barloom.operators.bars import trades_to_bars
from barloom.operators.options import put_call_ratios, with_spot
from barloom.operators.ranges import composite_analysis
from barloom.sources import bars as SB
from barloom.sources import chains as SC
from barloom.sources import logs as SL
from barloom.streaming.live_bars import live_bars


def test_bars_csv_and_parquet(spark, tmp_path):
    p = panel(spark, walk(20, 1, "A"), walk(20, 2, "B"))
    p.write.option("header", True).csv(str(tmp_path / "csv"))
    p.write.parquet(str(tmp_path / "pq"))
    a = SB.read_bars(spark, str(tmp_path / "csv"), "csv", symbols=["A"])
    b = SB.read_bars(spark, str(tmp_path / "pq"), symbols=["A"], start="2020-01-05")
    assert a.count() == 20 and b.count() == 16
    assert a.select(F.round("close", 6)).exceptAll(p.select(F.round("close", 6))).count() == 0
    assert "PushedFilters: [IsNotNull(symbol)" in b._jdf.queryExecution().executedPlan().toString()


def test_snapshot_overwrites_its_day_only(spark, tmp_path):
    path = str(tmp_path / "snap")
    p = panel(spark, walk(10, 3))
    SB.write_snapshot(p, path, "2024-01-01")
    SB.write_snapshot(p.limit(4), path, "2024-01-02")
    SB.write_snapshot(p.limit(3), path, "2024-01-02")
    assert SB.read_snapshot(spark, path, "2024-01-01").count() == 10
    assert SB.read_snapshot(spark, path, "2024-01-02").count() == 3


def test_raw_columns(spark):
    rows = [("X", dt.datetime(2024, 1, 2, 5), 1.0, 2.0, 0.5, 1.5, 10), ("X", dt.datetime(2024, 1, 3), 1.0, 2.0, 0.5, None, 10)]
    raw = spark.createDataFrame(rows, "symbol string, ` Date` timestamp, Open double, HIGH double, Low double, `Close ` double, Volume bigint")
    got = SB.read_raw_bars(raw)
    assert got.columns == SB.BAR_SCHEMA.names and got.count() == 1 and got.first()["dt"] == dt.date(2024, 1, 2)


def test_universe(spark):
    listing = spark.createDataFrame([("BRK.B",), ("AAPL",), ("AAPL",)], "Symbol string")
    assert {r.symbol for r in SB.universe(spark, listing, "Symbol").collect()} == {"BRK-B", "AAPL"}
    assert SB.universe(spark, listing.filter("false"), "Symbol").count() == 32


def snapshot(symbol, asof, expiry, calls, spot=100.0):
    contract = lambda k, oi: {"strike": k, "lastPrice": 1.0, "bid": 0.9, "ask": 1.1, "volume": None, "openInterest": oi, "impliedVolatility": 0.2}
    meta = {"resolved_ticker": symbol, "original_ticker": symbol, "expiry": expiry, "asof_dt": asof, "spot_price": spot, "futures_spot": spot, "proxy_used": False}
    return {"calls": [contract(k, 5) for k in calls], "puts": [contract(95.0, None)], "meta": meta}


def test_chain_snapshots(spark, tmp_path):
    files = [
        snapshot("X", "2024-01-02", "2024-01-19", [100.0, 105.0]),
        snapshot("X", "2024-01-03", "2024-02-16", []),
        snapshot("X", "2024-01-02", "2024-02-16", [100.0]),
    ]
    for k, f in enumerate(files):
        (tmp_path / f"{k}.json").write_text(json.dumps(f, indent=1))
    snaps = SC.read_snapshots(spark, str(tmp_path))
    chain = SC.contracts(snaps)
    assert chain.count() == 6
    assert chain.filter("opt_side = 'P'").agg(F.sum("open_interest"), F.sum("volume")).first() == (0, 0)
    newest = SC.latest_snapshot(chain)
    assert {(str(r.asof_dt), str(r.expiry)) for r in newest.collect()} == {("2024-01-02", "2024-01-19")}
    assert SC.chain_meta(snaps).count() == 2
    SC.write_chain(chain, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_futures_use_their_proxy(spark):
    got = SC.resolve(spark.createDataFrame([("es=f",), ("aapl",)], "ticker string")).orderBy("symbol").collect()
    assert [(r.symbol, r.proxy_used) for r in got] == [("AAPL", False), ("SPY", True)]


def test_prediction_log(spark, tmp_path):
    path = str(tmp_path / "log")
    base = dict(date=dt.date(2024, 1, 2), ticker="X", spot_price=100.0, floor=99.0, ceiling=101.0, bias="BULLISH", confidence=60.0, expiry=dt.date(2024, 1, 19), vix=None, gex_net=None, regime="normal")
    for hour, floor in ((10, 98.0), (16, 99.0)):
        row = dict(base, timestamp=dt.datetime(2024, 1, 2, hour), floor=floor)
        SL.append_predictions(spark.createDataFrame([row], SL.PREDICTION_SCHEMA), path)
    log = SL.read_predictions(spark, path)
    assert log.count() == 2 and log.schema == SL.PREDICTION_SCHEMA
    assert L.latest_predictions(log).first()["floor"] == 99.0


def test_text_log_is_coerced(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        "date,timestamp,ticker,spot_price,floor,ceiling,bias,confidence,expiry,vix,gex_net,regime\n"
        "2024-01-02,2024-01-02 10:00:00,X,100,99,oops,BULLISH,60,2024-01-19,,,normal\n"
        "not a day,x,Y,1,1,1,NEUTRAL,1,,,,\n"
    )
    rows = SL.read_predictions(spark, str(tmp_path / "log.csv"), "csv").orderBy("ticker").collect()
    assert rows[0].ceiling is None and rows[0].spot_price == 100.0 and rows[1].date is None


def test_weights_log(spark, tmp_path):
    path = str(tmp_path / "w")
    change = lambda v: spark.createDataFrame([("iv_range", 0.2, v), ("unknown", 0.1, 0.2)], "weight_name string, old_value double, new_value double")
    SL.append_weight_changes(change(0.25), path, 1, "2024-01-01", "retune")
    SL.append_weight_changes(change(0.22), path, 2, "2024-02-01", "retune")
    weights = {r.name: r.weight for r in L.current_weights(spark, SL.read_weight_changes(spark, path)).collect()}
    assert weights["iv_range"] == 0.22 and weights["fractals"] == 0.15 and len(weights) == 7


def test_prediction_on_the_last_bar_is_not_scored(spark):
    bars = panel(spark, walk(5, 4))
    last = bars.agg(F.max("dt").alias("d")).first()["d"]
    row = dict(timestamp=None, ticker="X", spot_price=100.0, floor=1.0, ceiling=1000.0, bias="NEUTRAL", confidence=1.0, expiry=None, vix=None, gex_net=None, regime=None)
    log = spark.createDataFrame([dict(row, date=last), dict(row, date=last - dt.timedelta(days=1))], SL.PREDICTION_SCHEMA)
    got = L.score_predictions(log, bars).collect()
    assert len(got) == 1 and got[0].in_range and got[0].bias_correct


def test_live_bars_equal_batch_bars(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    trades = events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"))
    trades = trades.withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "in"
    trades.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(trades.schema).parquet(str(src))
    q = (
        live_bars(stream)
        .writeStream.format("memory")
        .queryName("live")
        .outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    batch = trades_to_bars(trades, F.date_trunc("day", "ts")).select("symbol", "dt", "open", "high", "low", "close", "volume")
    live = spark.table("live")
    assert live.count() == batch.count()
    assert batch.exceptAll(live).count() == 0


def test_two_tickers_of_one_chain(spark, tmp_path):
    """SPY and ES=F on one day: contracts once, prices for either ticker, and each in its own units."""
    own = snapshot("SPY", "2024-01-02", "2024-01-12", [90.0, 100.0, 110.0])
    future = snapshot("SPY", "2024-01-02", "2024-01-12", [90.0, 100.0, 110.0])
    future["meta"] |= {"original_ticker": "ES=F", "futures_spot": 1000.0, "proxy_used": True}
    for i, s in enumerate((own, future)):
        (tmp_path / f"{i}.json").write_text(json.dumps(s))
    snaps = SC.read_snapshots(spark, str(tmp_path))
    chain, meta = SC.contracts(snaps).cache(), SC.chain_meta(snaps).cache()
    assert chain.count() == 4
    assert put_call_ratios(with_spot(chain, meta)).first()["call_oi"] == 15
    prices = walk(200, 4, "SPY")
    prices["dt"] = [dt.date(2024, 1, 2) - dt.timedelta(days=199 - k) for k in range(200)]
    vix = spark.createDataFrame([(dt.date(2024, 1, 1), 16.0, 18.0)], "dt date, vix double, vix_3m double")
    rows = composite_analysis(chain, meta, panel(spark, prices), vix)
    got = {r.ticker: r for r in SL.prediction_rows(rows, "2024-01-02", "2024-01-02 16:00:00").collect()}
    assert set(got) == {"SPY", "ES=F"}
    assert got["SPY"].spot_price == 100.0 and got["ES=F"].spot_price == 1000.0
    assert abs(got["ES=F"].floor - 10 * got["SPY"].floor) < 0.1
    assert {(r.vix, r.regime) for r in got.values()} == {(16.0, "normal")}
    bare = composite_analysis(chain, meta.filter("false"), panel(spark, prices), vix).collect()
    assert [(r.symbol, r.ticker, r.spot_price, r.bias) for r in bare] == [("SPY", None, None, None)]
