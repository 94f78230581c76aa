"""Option-chain analytics for any number of chains at once.

A chain is the contracts of one (symbol, asof_dt, expiry); all operators take
*quotes*, contracts with the chain's ``spot``, and group by ``CHAIN``.  A chain
holds one row per listed side and strike, a few thousand at most, whatever the
number of chains.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import START, TIME, ratio, row_index, series, whole
from .indicators import parkinson
from .joins import asof_calendar

CHAIN = ("symbol", "asof_dt", "expiry")
SNAPSHOT = ("symbol", "asof_dt")


def is_call() -> Column:
    return F.col("opt_side") == "C"


def distinct_quotes(chain: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """One contract per side and strike; of duplicates the one with the most open interest."""
    rest = [c for c in chain.columns if c not in (*by, "opt_side", "strike")]
    first = [c for c in ("open_interest", "volume") if c in rest]
    top = F.max(F.struct(*first, *[c for c in rest if c not in first]))
    return chain.groupBy(*by, "opt_side", "strike").agg(top.alias("_q")).select(*by, "opt_side", "strike", "_q.*")


def snapshot_spot(meta: DataFrame) -> DataFrame:
    """One price per snapshot, whatever number of tickers asked for it."""
    return meta.groupBy(*SNAPSHOT).agg(F.max("spot").alias("spot"))


def with_spot(chain: DataFrame, meta: DataFrame) -> DataFrame:
    """Contracts with the price of their snapshot; null where it has none."""
    return chain.join(snapshot_spot(meta), list(SNAPSHOT), "left")


def packed(chain: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """One row per chain with its contracts as an array, so that what follows moves and reads whole chains."""
    rest = [c for c in chain.columns if c not in by]
    return chain.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_contracts"))


def unpacked(chains: DataFrame) -> DataFrame:
    """The contracts of ``packed`` chains as rows."""
    return chains.select(*[c for c in chains.columns if c != "_contracts"], F.inline("_contracts"))


def nearest_expiries(chain: DataFrame, n: int = 4, by: Sequence[str] = SNAPSHOT) -> DataFrame:
    """The n nearest expiries of each snapshot, numbered from 1."""
    listed = chain.select(*by, "expiry").distinct()
    w = Window.partitionBy(*by).orderBy("expiry")
    return listed.withColumn("expiry_rank", F.row_number().over(w)).filter(F.col("expiry_rank") <= n)


def usable_expiry(chain: DataFrame, min_activity: int = 1000, look: int | None = None, by: Sequence[str] = SNAPSHOT) -> DataFrame:
    """The nearest expiry with enough open interest or volume (of the first ``look``, if given), else the nearest."""
    per = chain.groupBy(*by, "expiry").agg(F.sum("open_interest").alias("_oi"), F.sum("volume").alias("_v"))
    w = Window.partitionBy(*by).orderBy("expiry")
    busy = (F.col("_oi") >= min_activity) | (F.col("_v") >= min_activity)
    per = per.withColumn("_k", F.row_number().over(w))
    best = F.min(F.when(busy if look is None else busy & (F.col("_k") <= look), F.col("expiry")))
    return per.groupBy(*by).agg(F.coalesce(best, F.min("expiry")).alias("expiry"))


def in_band() -> Column:
    return F.col("strike").between(F.col("spot") * (1 - K.STRIKE_BAND), F.col("spot") * (1 + K.STRIKE_BAND))


def days_to_expiry() -> Column:
    return F.greatest(F.datediff("expiry", "asof_dt"), F.lit(1))


def gamma(spot: Column, strike: Column, years: Column, rate: float, vol: Column) -> Column:
    """Black-Scholes gamma as a column expression."""
    spread = vol * F.sqrt(years)
    d1 = ratio(F.log(ratio(spot, strike)) + (rate + vol * vol / 2) * years, spread)
    return ratio(F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi), spot * spread)


def gex_profile(quotes: DataFrame, rate: float = K.RISK_FREE, by: Sequence[str] = CHAIN) -> DataFrame:
    """Dealer gamma exposure per strike near the spot: calls positive, puts negative."""
    near = distinct_quotes(quotes.filter(in_band()), by)
    years = days_to_expiry() / 365
    g = gamma(F.col("spot"), F.col("strike"), years, rate, F.col("implied_vol"))
    usable = (F.col("implied_vol") > K.MIN_IV) & (F.col("open_interest") > 0)
    sign = F.when(is_call(), 1.0).otherwise(-1.0)
    near = near.withColumn("_g", F.when(usable, sign * g * F.col("open_interest") * 100 * F.col("spot")))
    side = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_g"))), F.lit(0.0))
    out = near.groupBy(*by, "spot", "strike").agg(side(is_call()).alias("_c"), side(~is_call()).alias("_p"))
    return out.select(
        *by,
        "spot",
        "strike",
        F.round("_c", 2).alias("call_gex"),
        F.round("_p", 2).alias("put_gex"),
        F.round(F.col("_c") + F.col("_p"), 2).alias("net_gex"),
    )


def gex_boundaries(profile: DataFrame, top: int = 5, by: Sequence[str] = CHAIN) -> DataFrame:
    """Exposure-weighted strike below and above the spot, from the ``top`` strikes of each side.

    Above, the strikes are ranked by signed exposure, below by its size.
    """
    side = F.when(F.col("strike") > F.col("spot"), "above").when(F.col("strike") < F.col("spot"), "below")
    size = F.abs("net_gex")
    rows = profile.withColumn("_side", side).withColumn(
        "_order", F.when(F.col("_side") == "above", F.col("net_gex")).otherwise(size)
    )
    w = Window.partitionBy(*by, "_side").orderBy(F.col("_order").desc(), "strike")
    rows = rows.withColumn("_k", F.row_number().over(w))

    def level(which: str) -> Column:
        cond = (F.col("_side") == which) & (F.col("_k") <= top)
        weight = F.nullif(F.sum(F.when(cond, size)), F.lit(0.0))
        return F.round(F.sum(F.when(cond, size * F.col("strike"))) / weight, 2)

    return rows.groupBy(*by).agg(level("below").alias("gex_floor"), level("above").alias("gex_ceiling"))


def gex_summary(profile: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """Total exposure, whether it damps moves, and the strike with the largest exposure."""
    peak = F.max(F.struct(F.abs("net_gex").alias("size"), (-F.col("strike")).alias("low")))
    out = profile.groupBy(*by).agg(F.sum("net_gex").alias("total_gex"), peak.alias("_p"))
    return out.select(
        *by,
        "total_gex",
        F.when(F.col("total_gex") > 0, "sticky").otherwise("slippery").alias("gex_regime"),
        (-F.col("_p.low")).alias("peak_strike"),
    )


def add_activity(quotes: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """``activity``: open interest where the chain has any, else volume."""
    w = whole(by)
    use_oi = (F.sum("open_interest").over(w) > 0) | (F.sum("volume").over(w) <= 0)
    quotes = quotes.withColumn("activity_source", F.when(use_oi, "open_interest").otherwise("volume"))
    pick = F.when(F.col("activity_source") == "open_interest", F.col("open_interest")).otherwise(F.col("volume"))
    return quotes.withColumn("activity", pick)


def oi_walls(quotes: DataFrame, top: int = 10, by: Sequence[str] = CHAIN) -> DataFrame:
    """Busiest call strikes above and put strikes below the spot.

    ``*_walls`` are arrays of at most ``top`` (strike, activity) by strike,
    ``strongest_*`` the busiest strike (5% away when there is none), ``*_cluster``
    the activity-weighted strike.
    """
    side = F.when(is_call() & (F.col("strike") >= F.col("spot")), "call").when(
        ~is_call() & (F.col("strike") <= F.col("spot")), "put"
    )
    rows = add_activity(quotes, by).withColumn("_side", side)
    w = Window.partitionBy(*by, "_side").orderBy(F.col("activity").desc(), "strike")
    rows = rows.withColumn("_k", F.row_number().over(w))
    a, s = F.col("activity"), F.col("strike")

    def wall(which: str) -> list[Column]:
        cond = (F.col("_side") == which) & (F.col("_k") <= top) & (a > 0)
        entry = F.struct(s.alias("strike"), a.alias("activity"))
        return [
            F.sort_array(F.collect_list(F.when(cond, entry))).alias(f"{which}_walls"),
            F.max(F.when(cond & (F.col("_k") == 1), s)).alias(f"_{which}_top"),
            (F.sum(F.when(cond, a * s)) / F.sum(F.when(cond, a))).alias(f"_{which}_mean"),
        ]

    out = rows.groupBy(*by, "spot", "activity_source").agg(*wall("call"), *wall("put"))
    out = out.withColumns(
        {
            "strongest_call_wall": F.coalesce(F.col("_call_top"), F.col("spot") * 1.05),
            "strongest_put_wall": F.coalesce(F.col("_put_top"), F.col("spot") * 0.95),
        }
    )
    return out.select(
        *by,
        "call_walls",
        "put_walls",
        "strongest_call_wall",
        "strongest_put_wall",
        F.round(F.coalesce("_call_mean", "strongest_call_wall"), 2).alias("call_cluster"),
        F.round(F.coalesce("_put_mean", "strongest_put_wall"), 2).alias("put_cluster"),
        "activity_source",
    )


def max_pain(quotes: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """Strike at which the holders' total payout is smallest, the lowest such strike on ties.

    With running sums over the strikes the payout at K is ``K * calls below -
    their strike sum`` plus the mirror image for puts, so strikes are never paired
    with each other.
    """
    rows = add_activity(quotes, by)
    active = (F.col("activity") > 0) & in_band()
    part = lambda cond, v: F.sum(F.when(active & cond, v).otherwise(0))
    a, s = F.col("activity"), F.col("strike")
    per = rows.groupBy(*by, "spot", "strike").agg(
        part(is_call(), a).alias("_c"),
        part(is_call(), a * s).alias("_cs"),
        part(~is_call(), a).alias("_p"),
        part(~is_call(), a * s).alias("_ps"),
        F.max(active).alias("_live"),
    )
    w, up = whole(by), Window.partitionBy(*by).orderBy("strike").rowsBetween(START, 0)
    below = lambda c: F.sum(c).over(up)
    above = lambda c: F.sum(c).over(w) - F.sum(c).over(up)
    pain = s * below("_c") - below("_cs") + above("_ps") - s * above("_p")
    per = per.withColumn("_pain", F.round(pain, 6))
    best = F.min(F.when(F.col("_live"), F.struct("_pain", "strike")))
    return per.groupBy(*by, "spot").agg(best.alias("_b")).select(
        *by, F.coalesce(F.col("_b.strike"), F.col("spot")).alias("max_pain")
    )


def expected_move(quotes: DataFrame, vix: DataFrame | None = None, by: Sequence[str] = CHAIN) -> DataFrame:
    """Expected moves from the implied volatility of the three strikes nearest the spot on each side.

    ``vix`` (asof_dt, vix) stands in where no contract has a usable volatility,
    and 20% where that is missing too.
    """
    w = Window.partitionBy(*by, "opt_side").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")
    rows = quotes.withColumn("_k", F.row_number().over(w))
    near = (F.col("_k") <= 3) & (F.col("implied_vol") > K.MIN_IV)
    out = rows.groupBy(*by, "spot").agg(F.avg(F.when(near, F.col("implied_vol"))).alias("_atm"))
    if vix is None:
        out = out.withColumn("vix", F.lit(None).cast("double"))
    else:
        out = asof_calendar(out, vix, ["vix"], "asof_dt")
    proxy = F.when(F.col("vix") > 0, F.col("vix") / 100)
    out = out.withColumns(
        {
            "_iv": F.coalesce(F.col("_atm"), proxy, F.lit(0.20)),
            "iv_source": F.when(F.col("_atm").isNotNull(), "options").when(proxy.isNotNull(), "VIX").otherwise("default"),
            "days_to_expiry": days_to_expiry(),
        }
    )
    spot = F.col("spot")
    out = out.withColumns(
        {
            "_m": spot * F.col("_iv") * F.sqrt(F.col("days_to_expiry") / 365),
            "_d": spot * F.col("_iv") * math.sqrt(1 / 365),
        }
    )
    r = lambda c: F.round(c, 2)
    m, d = F.col("_m"), F.col("_d")
    return out.select(
        *by,
        F.round("_iv", 4).alias("iv_used"),
        "iv_source",
        "days_to_expiry",
        r(m).alias("move_1sigma"),
        r(2 * m).alias("move_2sigma"),
        r(spot - m).alias("low_1sigma"),
        r(spot + m).alias("high_1sigma"),
        r(spot - 2 * m).alias("low_2sigma"),
        r(spot + 2 * m).alias("high_2sigma"),
        r(d).alias("daily_move"),
        r(spot - d).alias("daily_low"),
        r(spot + d).alias("daily_high"),
    )


def _ratio_bias(ratio: Column) -> Column:
    return F.when(ratio < 0.7, "bullish").when(ratio > 1.0, "bearish").otherwise("neutral")


def put_call_ratios(quotes: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """Put/call ratios of open interest and volume; volume decides where open interest is thin."""
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    out = quotes.groupBy(*by).agg(
        total(is_call(), "open_interest").alias("call_oi"),
        total(~is_call(), "open_interest").alias("put_oi"),
        total(is_call(), "volume").alias("call_volume"),
        total(~is_call(), "volume").alias("put_volume"),
    )
    oi = F.when(F.col("call_oi") > 0, F.col("put_oi") / F.col("call_oi")).otherwise(F.lit(1.0))
    vol = F.when(F.col("call_volume") > 0, F.col("put_volume") / F.col("call_volume")).otherwise(F.lit(1.0))
    thick = F.col("call_oi") + F.col("put_oi") > 100
    return out.withColumns(
        {
            "pc_ratio_oi": F.round(oi, 3),
            "pc_ratio_volume": F.round(vol, 3),
            "oi_bias": F.when(thick, _ratio_bias(oi)).otherwise(_ratio_bias(vol)),
            "volume_bias": _ratio_bias(vol),
        }
    )


def iv_skew(quotes: DataFrame, by: Sequence[str] = CHAIN) -> DataFrame:
    """Mean volatility of out-of-the-money puts against calls, 3% away from the spot."""
    put = ~is_call() & (F.col("strike") < F.col("spot") * 0.97)
    call = is_call() & (F.col("strike") > F.col("spot") * 1.03)
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("implied_vol"))), F.lit(0.20))
    out = quotes.groupBy(*by).agg(mean(put).alias("_p"), mean(call).alias("_c"))
    skew = F.when(F.col("_c") > 0, F.col("_p") / F.col("_c")).otherwise(F.lit(1.0))
    out = out.withColumn("_s", skew)
    s = F.col("_s")
    return out.select(
        *by,
        F.round(s, 3).alias("skew_ratio"),
        F.when(s > 1.15, "bearish").when(s < 0.90, "bullish").otherwise("neutral").alias("skew_bias"),
        F.round("_p", 4).alias("otm_put_iv"),
        F.round("_c", 4).alias("otm_call_iv"),
    )


def add_recent_volatility(
    panel: DataFrame, lookback: int = K.VRP_LOOKBACK, window: int = K.PARKINSON_WINDOW, by=("symbol",), time=TIME
) -> DataFrame:
    """Per bar, from it and earlier ones: range volatility over two windows and close-to-close volatility.

    Null until the series has as many bars.
    """
    w, year = series(by, time), math.sqrt(K.TRADING_DAYS)
    rows = panel.withColumns(
        {
            "_i": row_index(w),
            "_lr": F.log(ratio(F.col("close"), F.lag("close").over(w))),
            "_hl": F.pow(F.log(ratio(F.col("high"), F.col("low"))), 2),
        }
    )
    last = lambda n: w.rowsBetween(1 - n, 0)
    after = lambda n, value: F.when(F.col("_i") >= n - 1, value)
    return rows.withColumns(
        {
            "parkinson_short": after(window, parkinson(F.avg("_hl").over(last(window)))),
            "parkinson_long": after(lookback, parkinson(F.avg("_hl").over(last(lookback)))),
            "close_to_close": after(lookback, F.stddev_samp("_lr").over(last(lookback - 1)) * year),
        }
    ).drop("_i", "_lr", "_hl")


def recent_volatility(
    panel: DataFrame, lookback: int = K.VRP_LOOKBACK, window: int = K.PARKINSON_WINDOW, by=("symbol",), time=TIME
) -> DataFrame:
    """Volatility of the newest bars of each key."""
    rows = add_recent_volatility(panel, lookback, window, by, time)
    return rows.groupBy(*by).agg(*[F.max_by(c, time).alias(c) for c in ("parkinson_short", "parkinson_long", "close_to_close")])


def vrp_columns(iv: Column, low: float = K.VRP_MIN, high: float = K.VRP_MAX) -> dict[str, Column]:
    """Variance risk premium from ``recent_volatility`` columns: how far to shrink implied volatility."""
    park, cc = F.col("parkinson_long"), F.col("close_to_close")
    rv = F.when(park > 0, park).otherwise(cc)
    good = F.coalesce((rv > 0) & (iv > 0), F.lit(False))
    factor = F.greatest(F.lit(low), F.least(F.lit(high), rv / iv))
    return {
        "vrp_factor": F.when(good, F.round(factor, 4)).otherwise(F.lit(0.85)),
        "vrp_pct": F.when(good, F.round((1 - rv / iv) * 100, 1)).otherwise(F.lit(15.0)),
        "vrp_source": F.when(good, "parkinson").otherwise("default"),
    }


def term_structure(vix: Column, vix_3m: Column) -> Column:
    """Contango or backwardation from the ratio of spot to three-month volatility, else from the level."""
    ratio = F.when(vix_3m > 0, vix / vix_3m)
    return (
        F.when(vix.isNull() | (vix == 0), "unknown")
        .when(ratio < 0.95, "contango")
        .when(ratio > 1.05, "backwardation")
        .when(ratio.isNotNull(), "flat")
        .when(vix < 18, "contango")
        .when(vix > 28, "backwardation")
        .otherwise("flat")
    )
