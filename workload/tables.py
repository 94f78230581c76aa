"""Market-shaped tables derived from the supplied parquet, for queries, tests and the bench.

Every recipe reads its whole source table with commutative aggregates (sum, min,
max), so it holds at any scale and with any skew, and uses integer arithmetic for
price paths, so that other engines reproduce the tables exactly.  The same
recipes in SQL are in ``workload/sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A price is a reflected integer walk of +-STEP moves on a grid of GRID levels.
GRID = 600
TICK = 0.004


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored trades whose bars make one task of a large panel, and of one that has fewer tasks than cores.
SLICE, LEAST = 4 << 20, 1 << 20


def slices(trades: DataFrame) -> int:
    """Number of tasks for the panel: a task's series take the same memory however large the stored table is.

    Adaptive execution would merge the partitions to one or two per core, so that a task grew with the input.  The size
    is the optimizer's, from the file listing; nothing is run.  Long window chains cost a task seconds of code generation,
    so slices are no finer than memory asks for.
    """
    size = int(trades._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = trades.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // SLICE), min(cores, -(-size // LEAST)))


def _price(level: Column) -> Column:
    """Price in whole cents at a grid level: sums of prices are exact in any order."""
    return F.round(F.exp((level - GRID // 2) * TICK) * 10000, 0)


def _reflected(c: Column) -> Column:
    """Fold an unbounded integer into 0..GRID, as a walk reflected at both ends."""
    return F.abs(F.pmod(c + GRID // 2 + GRID, F.lit(2 * GRID)) - GRID)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel: the supplier is the symbol, the ship date the day.

    The number of symbols grows with the scale factor; the bars of one symbol are
    bounded by the calendar.  A day moves the walk by the sum of its trades'
    steps; its wicks are its largest single moves.
    """
    step = F.round(F.col("l_discount") * 100).cast("bigint") - 5
    trades = table(spark, sf_dir, "lineitem")
    day = (
        trades.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("dt"))
        .agg(
            F.sum(step).alias("_s"),
            F.greatest(F.max(step), F.lit(0)).alias("_up"),
            F.greatest(-F.min(step), F.lit(0)).alias("_down"),
            F.sum("l_quantity").alias("volume"),
        )
        .repartition(slices(trades), "symbol")
    )
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    day = day.withColumn("_c", F.sum("_s").over(w))
    day = day.withColumns({"_c1": _reflected(F.col("_c")), "_c0": _reflected(F.col("_c") - F.col("_s"))})
    return day.select(
        "symbol",
        "dt",
        _price(F.col("_c0")).alias("open"),
        _price(F.greatest("_c0", "_c1") + F.col("_up")).alias("high"),
        _price(F.least("_c0", "_c1") - F.col("_down")).alias("low"),
        _price(F.col("_c1")).alias("close"),
        "volume",
    )


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility index: the mean order price of a day, and its 63-row mean."""
    day = (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("dt"))
        .agg(
            F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("_s"), F.count("*").alias("_n")
        )
    )
    # One row per calendar day, so the frame without a key is bounded.
    w = Window.orderBy("dt").rowsBetween(-62, 0)
    return day.select(
        "dt",
        F.round(F.col("_s") / F.col("_n") / 1000000, 2).alias("vix"),
        F.round(F.sum("_s").over(w) / F.sum("_n").over(w) / 1000000, 2).alias("vix_3m"),
    )


def last_close(panel: DataFrame) -> DataFrame:
    return panel.groupBy("symbol").agg(F.max("dt").alias("asof_dt"), F.max_by("close", "dt").alias("spot"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option chain of every symbol on its last bar: 2 sides, 2 expiries, 21 strikes around the close."""
    contracts = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("symbol"),
            F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("opt_side"),
            (F.col("l_orderkey") % 2).alias("_far"),
            (F.col("l_partkey") % 21).alias("_k"),
        )
        .agg(
            F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("_d"),
            F.sum("l_quantity").cast("bigint").alias("open_interest"),
            F.count("*").alias("volume"),
        )
    )
    joined = contracts.join(last_close(bars(spark, sf_dir)), "symbol")
    k = F.col("_k")
    iv = F.round(0.08 + F.col("_d") / F.col("volume") / 50 + F.greatest(F.lit(0), 10 - k) / 50, 10)
    return joined.select(
        "symbol",
        "asof_dt",
        F.date_add("asof_dt", F.when(F.col("_far") == 0, 12).otherwise(47)).alias("expiry"),
        "opt_side",
        F.round(F.col("spot") * (k + 40) / 50, 2).alias("strike"),
        F.when(k == 5, F.lit(0.03)).otherwise(iv).alias("implied_vol"),
        "open_interest",
        "volume",
    )


def chain_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by asked-for ticker: odd keys stand in for a future (symbol=F) at twice their price, multiples of four also for one."""
    key = F.col("symbol").cast("bigint")
    own = F.when(key % 2 == 0, F.struct(F.col("symbol").alias("ticker"), F.col("spot").alias("futures_spot"), F.lit(False).alias("proxy_used")))
    future = F.when(
        (key % 2 == 1) | (key % 4 == 0),
        F.struct(F.concat("symbol", F.lit("=F")).alias("ticker"), (F.col("spot") * 2).alias("futures_spot"), F.lit(True).alias("proxy_used")),
    )
    asked = F.inline(F.array_compact(F.array(own, future)))
    return last_close(bars(spark, sf_dir)).select("symbol", "asof_dt", "spot", asked)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chains, a record for each ticker and expiry: chains that two tickers asked for are there twice."""
    none = F.lit(None).cast("double")
    contract = F.struct(
        "strike",
        none.alias("lastPrice"),
        none.alias("bid"),
        none.alias("ask"),
        F.col("volume").cast("double").alias("volume"),
        F.when(F.col("open_interest") % 7 > 0, F.col("open_interest")).cast("double").alias("openInterest"),
        F.col("implied_vol").alias("impliedVolatility"),
    )
    side = lambda s: F.collect_list(F.when(F.col("opt_side") == s, contract))
    chains = chain(spark, sf_dir).groupBy("symbol", "asof_dt", "expiry").agg(side("C").alias("calls"), side("P").alias("puts"))
    meta = F.struct(
        F.col("symbol").alias("resolved_ticker"),
        F.col("ticker").alias("original_ticker"),
        "expiry",
        "asof_dt",
        F.col("spot").alias("spot_price"),
        "futures_spot",
        "proxy_used",
    )
    return chains.join(chain_meta(spark, sf_dir), ["symbol", "asof_dt"]).select("calls", "puts", meta.alias("meta"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictions for every bar after the 25th: an early one and the final one."""
    w = Window.partitionBy("symbol").orderBy("dt")
    p = bars(spark, sf_dir).withColumn("_lr", F.log(F.col("close") / F.lag("close").over(w)))
    p = p.withColumns(
        {"_i": F.row_number().over(w) - 1, "_sd": F.stddev_samp("_lr").over(w.rowsBetween(-19, 0))}
    ).filter("_i >= 25")
    from barloom.operators.joins import asof_calendar
    from barloom.operators.signals import vix_regime

    p = asof_calendar(p, vix(spark, sf_dir).select("dt", "vix"), ["vix"])
    issue = F.inline(
        F.array(
            F.struct(F.lit(10).alias("hour"), F.lit(2.0).alias("width")),
            F.struct(F.lit(16).alias("hour"), F.lit(1.0).alias("width")),
        )
    )
    c, sd = F.col("close"), F.col("_sd") * F.col("width")
    return p.select("*", issue).select(
        F.col("dt").alias("date"),
        F.timestamp_add("HOUR", F.col("hour"), F.col("dt").cast("timestamp_ntz")).alias("timestamp"),
        F.col("symbol").alias("ticker"),
        F.round(c, 2).alias("spot_price"),
        F.round(c * (1 - sd), 2).alias("floor"),
        F.round(c * (1 + sd), 2).alias("ceiling"),
        F.when(c > F.col("open"), "BULLISH").when(c < F.col("open"), "BEARISH").otherwise("NEUTRAL").alias("bias"),
        F.lit(60.0).alias("confidence"),
        F.date_add("dt", 12).alias("expiry"),
        "vix",
        F.lit(0.0).alias("gex_net"),
        vix_regime(F.col("vix")).alias("regime"),
    )


WEIGHT_NAMES = [
    "options_walls",
    "gex_levels",
    "iv_range",
    "fractals",
    "put_call_ratio",
    "iv_skew",
    "max_pain",
    "retired_signal",
]


def weight_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight-change log from the event stream; errors stand for rows with an unreadable value."""
    names = F.array(*[F.lit(n) for n in WEIGHT_NAMES])
    value = F.round(F.col("value") / 100, 4).cast("decimal(12,4)").cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.to_date("ts").alias("date"),
        F.element_at(names, (F.col("event_id") % len(WEIGHT_NAMES) + 1).cast("int")).alias("weight_name"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(value).alias("new_value"),
        F.col("event_type").alias("reason"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from the event stream: the event type is the symbol, its value the price."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        F.col("value").alias("price"),
        (F.col("user_id") % 100 + 1).cast("double").alias("size"),
    )
