"""Reading and writing option-chain snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators.options import distinct_quotes

_CONTRACT = T.StructType(
    [
        T.StructField("strike", T.DoubleType()),
        T.StructField("lastPrice", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("openInterest", T.DoubleType()),
        T.StructField("impliedVolatility", T.DoubleType()),
    ]
)
_META = T.StructType(
    [
        T.StructField("resolved_ticker", T.StringType()),
        T.StructField("original_ticker", T.StringType()),
        T.StructField("expiry", T.DateType()),
        T.StructField("asof_dt", T.DateType()),
        T.StructField("spot_price", T.DoubleType()),
        T.StructField("futures_spot", T.DoubleType()),
        T.StructField("proxy_used", T.BooleanType()),
    ]
)
SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("calls", T.ArrayType(_CONTRACT)),
        T.StructField("puts", T.ArrayType(_CONTRACT)),
        T.StructField("meta", _META),
    ]
)


def count_or_zero(c: str) -> Column:
    """A missing or NaN count is zero."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0)).cast("bigint")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one JSON object each: calls, puts, meta."""
    return spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path)


def contracts(snapshots: DataFrame) -> DataFrame:
    """One row per contract of every chain, however many tickers asked for the chain that day.

    Of differing records of a contract the one with the most open interest is kept.
    """
    marked = lambda c, name: F.transform(
        F.coalesce(c, F.array().cast(T.ArrayType(_CONTRACT))), lambda x: F.struct(F.lit(name).alias("opt_side"), x.alias("c"))
    )
    both = snapshots.select(
        F.col("meta.resolved_ticker").alias("symbol"),
        F.col("meta.asof_dt"),
        F.col("meta.expiry"),
        F.inline(F.concat(marked(F.col("calls"), "C"), marked(F.col("puts"), "P"))),
    ).select("symbol", "asof_dt", "expiry", "opt_side", "c.*")
    rows = both.select(
        "symbol",
        "asof_dt",
        "expiry",
        "opt_side",
        "strike",
        "bid",
        "ask",
        F.col("lastPrice").alias("last_price"),
        count_or_zero("volume").alias("volume"),
        count_or_zero("openInterest").alias("open_interest"),
        F.col("impliedVolatility").alias("implied_vol"),
    )
    return distinct_quotes(rows).select(rows.columns)


def chain_meta(snapshots: DataFrame) -> DataFrame:
    """One row per symbol, day and asked-for ticker: prices and whether the chain is a proxy's.

    Of several requests of a day the one for the nearest expiry counts.
    """
    m = lambda c: F.col(f"meta.{c}")
    key = [
        m("resolved_ticker").alias("symbol"),
        m("asof_dt").alias("asof_dt"),
        F.coalesce(m("original_ticker"), m("resolved_ticker")).alias("ticker"),
    ]
    rest = [m(c).alias(c) for c in ("expiry", "spot_price", "futures_spot", "proxy_used")]
    top = snapshots.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_m"))
    return top.select(
        "symbol",
        "asof_dt",
        "ticker",
        F.col("_m.spot_price").alias("spot"),
        F.coalesce("_m.futures_spot", "_m.spot_price").alias("futures_spot"),
        "_m.proxy_used",
    )


def write_chain(chain: DataFrame, path: str) -> None:
    """Store contracts by snapshot day; writing a day again replaces that day only."""
    (
        chain.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("asof_dt")
        .parquet(path)
    )


def latest_snapshot(chain: DataFrame) -> DataFrame:
    """Per symbol the newest snapshot that has calls, with its nearest expiry."""
    listed = chain.filter(F.col("opt_side") == "C").select("symbol", "asof_dt", "expiry").distinct()
    w = Window.partitionBy("symbol").orderBy(F.col("asof_dt").desc(), "expiry")
    newest = listed.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return chain.join(newest, ["symbol", "asof_dt", "expiry"], "left_semi")


def resolve(df: DataFrame, ticker: str = "ticker", proxies: Mapping[str, str] | None = None) -> DataFrame:
    """``symbol`` whose chain to use for a ticker, and whether that is a proxy."""
    proxies = K.FUTURES_PROXY if proxies is None else proxies
    asked = F.upper(F.trim(F.col(ticker)))
    known = F.create_map(*[F.lit(v) for kv in proxies.items() for v in kv])[asked]
    return df.withColumn("symbol", F.coalesce(known, asked)).withColumn("proxy_used", known.isNotNull())
