"""Queries over the source operators that work on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bars as OB
from barloom.operators.screen import in_universe
from barloom.sources import bars as SB
from barloom.sources import chains as SC
from barloom.sources import logs as SL

from . import tables as T
from .registry import query
from .sql import cte  # noqa: F401


@query(
    "proxy_symbols",
    """
SELECT upper(c_mktsegment) AS ticker, CASE upper(c_mktsegment) WHEN 'BUILDING' THEN 'SPY' ELSE upper(c_mktsegment) END AS symbol,
       upper(c_mktsegment) = 'BUILDING' AS proxy_used, count(*) AS n
FROM customer GROUP BY 1, 2, 3
""",
)
def proxy_symbols(spark, sf):
    rows = T.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("ticker"))
    out = SC.resolve(rows, proxies={"BUILDING": "SPY"}).withColumn("ticker", F.upper("ticker"))
    return out.groupBy("ticker", "symbol", "proxy_used").agg(F.count("*").alias("n"))


@query(
    "universe_bars",
    """
SELECT symbol, dt, close FROM bars WHERE symbol IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)
""",
)
def universe_bars(spark, sf):
    listing = T.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("code"))
    return in_universe(T.bars(spark, sf), SB.universe(spark, listing, "code")).select("symbol", "dt", "close")


@query(
    "latest_chain",
    """
SELECT symbol, asof_dt, expiry, opt_side, strike, open_interest FROM chain
QUALIFY expiry = min(CASE WHEN opt_side = 'C' THEN expiry END) OVER (PARTITION BY symbol, asof_dt)
""",
)
def latest_chain(spark, sf):
    out = SC.latest_snapshot(T.chain(spark, sf))
    return out.select("symbol", "asof_dt", "expiry", "opt_side", "strike", "open_interest")


@query(
    "pred_coerced",
    """
SELECT date, timestamp, ticker, CASE WHEN bias = 'NEUTRAL' THEN NULL ELSE spot_price END AS spot_price, floor, bias FROM preds_all
""",
)
def pred_coerced(spark, sf):
    raw = T.predictions(spark, sf)
    raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    raw = raw.withColumn("spot_price", F.when(F.col("bias") == "NEUTRAL", "n/a").otherwise(F.col("spot_price")))
    return SL.coerced(raw).select("date", "timestamp", "ticker", "spot_price", "floor", "bias")


@query(
    "snapshot_contracts",
    """
SELECT symbol, asof_dt, expiry, opt_side, strike, volume, CASE WHEN open_interest % 7 > 0 THEN open_interest ELSE 0 END AS open_interest, implied_vol FROM chain
""",
)
def snapshot_contracts(spark, sf):
    """Chains asked for twice give their contracts once; missing counts are zero."""
    out = SC.contracts(T.snapshots(spark, sf))
    return out.select("symbol", "asof_dt", "expiry", "opt_side", "strike", "volume", "open_interest", "implied_vol")


@query("snapshot_meta", "SELECT symbol, asof_dt, ticker, spot, futures_spot, proxy_used FROM meta")
def snapshot_meta(spark, sf):
    return SC.chain_meta(T.snapshots(spark, sf))


@query("clean_panel", "SELECT symbol, dt, open, high, low, close, volume FROM bars WHERE CAST(close AS BIGINT) % 11 <> 0 AND CAST(close AS BIGINT) % 13 <> 0")
def clean_panel(spark, sf):
    """Padded, mixed-case names, times of day, and null, NaN and infinite closes, made clean."""
    close = F.col("close").cast("bigint")
    bad = F.when(close % 11 == 0, F.lit(float("nan"))).when(close % 13 == 0, F.lit(None)).otherwise(F.col("close"))
    raw = T.bars(spark, sf).select(
        F.col("symbol").alias("Symbol"),
        F.timestamp_add("HOUR", F.lit(5), F.col("dt").cast("timestamp")).alias(" DT "),
        F.col("open").alias("Open"),
        F.col("high").alias("HIGH"),
        F.col("low").alias(" Low"),
        bad.alias("Close "),
        F.col("volume").alias("Volume"),
    )
    named = OB.normalize_names(raw)
    rows = OB.drop_missing_close(OB.drop_empty_rows(named.withColumn("dt", OB.naive_day(F.col("dt")))))
    return rows.select("symbol", "dt", *OB.VALUES)
