"""Directional bias, expected floor and ceiling, and the composite analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.windows import START, TIME, latest, running, series, whole
from . import options as O
from .joins import asof_calendar
from .signals import vix_regime
from .structure import add_fractal_dimension, add_pivots, market_regime


def _lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def bias_vote(evidence: DataFrame, weights: Mapping[str, float] | None = None, by=O.CHAIN, carry: Sequence[str] = ()) -> DataFrame:
    """Weighted vote over evidence rows (key, name, bias); the strict winner, else neutral.

    ``carry`` are columns with one value per key that the result keeps.
    """
    weight = _lookup(F.col("name"), weights or K.SIGNAL_WEIGHTS, 0.0)
    side = lambda b: F.sum(F.when(F.col("bias") == b, weight).otherwise(0.0))
    out = evidence.groupBy(*by).agg(
        side("bullish").alias("_up"),
        side("bearish").alias("_down"),
        F.sum(weight).alias("_all"),
        *[F.first(c).alias(c) for c in carry],
    )
    # Rounded so that equal sums of weights stay equal whatever order they were added in.
    up, down = F.round("_up", 9), F.round("_down", 9)
    rest = F.round(F.col("_all") - F.col("_up") - F.col("_down"), 9)
    top = F.greatest(up, down, rest)
    return out.select(
        *by,
        *carry,
        F.when((up > down) & (up > rest), "BULLISH")
        .when((down > up) & (down > rest), "BEARISH")
        .otherwise("NEUTRAL")
        .alias("bias"),
        F.when(F.col("_all") > 0, F.round(top / F.round("_all", 9) * 100, 1)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def add_range(rows: DataFrame) -> DataFrame:
    """Floor and ceiling at three widths from spot, daily move, premium, regime, term structure and dealer levels.

    Needs spot, daily_move, vrp_factor, regime, structure, gex_floor, gex_ceiling,
    put_cluster, call_cluster.
    """
    spot = F.col("spot")
    rows = rows.withColumns(
        {
            "regime_factor": _lookup(F.col("regime"), K.REGIME_SCALE, 1.0),
            "term_factor": _lookup(F.col("structure"), K.TERM_SCALE, 1.0),
            "dealer_floor": F.when(
                F.col("gex_floor") < spot, F.col("gex_floor") * 0.6 + F.col("put_cluster") * 0.4
            ).otherwise(F.col("put_cluster")),
            "dealer_ceiling": F.when(
                F.col("gex_ceiling") > spot, F.col("gex_ceiling") * 0.6 + F.col("call_cluster") * 0.4
            ).otherwise(F.col("call_cluster")),
        }
    )
    rows = rows.withColumn(
        "final_move", F.col("daily_move") * F.col("vrp_factor") * (F.col("regime_factor") * F.col("term_factor"))
    )
    b = K.DEALER_BLEND
    cols = {}
    for label, sigma, _ in K.SIGMAS:
        low, high = spot - F.col("final_move") * sigma, spot + F.col("final_move") * sigma
        df, dc = F.col("dealer_floor"), F.col("dealer_ceiling")
        floor = F.when((df > low) & (df < spot), low * (1 - b) + df * b).otherwise(low)
        ceil = F.when((dc < high) & (dc > spot), high * (1 - b) + dc * b).otherwise(high)
        cols[f"floor_{label}"] = F.round(floor, 2)
        cols[f"ceiling_{label}"] = F.round(ceil, 2)
    return rows.withColumns(cols)


def range_rows(rows: DataFrame, by=O.CHAIN) -> DataFrame:
    """``add_range`` in long form: one row per width, with its probability."""
    widths = F.array(
        *[
            F.struct(
                F.lit(label).alias("level"),
                F.lit(sigma).alias("sigma"),
                F.lit(p).alias("probability"),
                F.col(f"floor_{label}").alias("floor"),
                F.col(f"ceiling_{label}").alias("ceiling"),
            )
            for label, sigma, p in K.SIGMAS
        ]
    )
    return rows.select(*by, F.inline(widths))


def price_ratio(spot: Column, futures_spot: Column) -> Column:
    return F.when(spot > 0, futures_spot / spot).otherwise(F.lit(1.0))


def rescaled(level: Column, ratio: Column, proxy_used: Column) -> Column:
    """Level of the proxy in units of the futures contract."""
    return F.when(proxy_used & (ratio > 1), level * ratio).otherwise(level)


#: What ``add_price_structure`` adds.
STRUCTURE = ["fd", "support", "resistance", "parkinson_short", "parkinson_long", "close_to_close"]


def add_price_structure(panel: DataFrame, by=("symbol",), time=TIME) -> DataFrame:
    """Per bar: dimension, newest pivots, recent volatility, as known at its close.

    A pivot is known ``PIVOT_PERIOD`` bars later.  Later bars change nothing; all windows share one key and order.
    """
    rows = _add_levels(panel, by, time)
    return O.add_recent_volatility(add_fractal_dimension(rows, by=by, time=time), by=by, time=time).withColumn(
        "fd", F.coalesce("fd", F.lit(1.5))
    )


def _add_levels(panel: DataFrame, by, time) -> DataFrame:
    w = series(by, time)
    return add_pivots(panel, by=by, time=time).withColumns(
        {
            "support": latest("pivot_low", w, -K.PIVOT_PERIOD),
            "resistance": latest("pivot_high", w, -K.PIVOT_PERIOD),
        }
    )


#: Bars before a bar that its dimension and volatilities read.
REACH = max(K.FD_WINDOW, K.VRP_LOOKBACK, K.PARKINSON_WINDOW)


def asof_price_structure(rows: DataFrame, panel: DataFrame, by=("symbol",), time=TIME, at: str = TIME) -> DataFrame:
    """Rows with ``add_price_structure`` of their key's newest bar at or before their day ``at``.

    Rows and bars share one frame, told apart by a side that is part of the windows' key.  The levels look back over all
    bars; dimension and volatility, which cost far more, only see the bars that a row's newest bar reaches.
    """
    bar = ["high", "low", "close"]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    lhs = rows.select(*by, F.col(at).alias(time), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), *[none(panel, c) for c in bar])
    no_row = F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row")
    both = lhs.unionByName(panel.select(*by, time, F.lit(0).alias("_side"), no_row, *bar))
    mixed = Window.partitionBy(*by).orderBy(time, "_side")
    newest = (F.col("_side") == 0) & (F.lead("_side", 1, 0).over(mixed) == 1)
    both = both.withColumn("_newest", newest.cast("int"))

    side = (*by, "_side")
    w = series(side, time)
    both = _add_levels(both, side, time).withColumns({"_seen": F.sum("_newest").over(running(w)), "_all": F.sum("_newest").over(whole(side))})
    ahead = F.coalesce(F.lead("_seen", REACH).over(w), F.col("_all")) - F.col("_seen") + F.col("_newest")
    both = both.withColumn("_ahead", ahead).filter("_side = 1 or _ahead > 0")
    both = O.add_recent_volatility(add_fractal_dimension(both, by=side, time=time, only="_newest = 1"), by=side, time=time)
    both = both.withColumn("fd", F.coalesce("fd", F.lit(1.5)))
    hit = F.last(F.when(F.col("_newest") == 1, F.struct(*STRUCTURE)), ignorenulls=True).over(mixed.rowsBetween(START, 0))
    both = both.withColumn("_hit", hit).filter("_side = 1")
    return both.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in STRUCTURE])


def evidence_rows(rows: DataFrame, by=O.CHAIN) -> DataFrame:
    """Seven evidence rows per chain: name, value, bias."""
    spot = F.col("spot")
    up = lambda cond: F.when(cond, "bullish").otherwise("bearish")
    middle = (F.col("strongest_put_wall") + F.col("strongest_call_wall")) / 2
    sup = F.coalesce(F.col("support"), spot * 0.95)
    res = F.coalesce(F.col("resistance"), spot * 1.05)
    items = [
        ("options_walls", F.lit(0.0), up(spot < middle)),
        ("gex_levels", F.col("total_gex"), up(F.coalesce(F.col("total_gex") > 0, F.lit(False)))),
        ("iv_range", F.col("iv_used"), F.lit("neutral")),
        ("fractals", F.col("fd"), up(spot - sup < res - spot)),
        ("put_call_ratio", F.col("pc_ratio_oi"), F.col("oi_bias")),
        ("iv_skew", F.col("skew_ratio"), F.col("skew_bias")),
        ("max_pain", F.col("max_pain"), up(spot < F.col("max_pain"))),
    ]
    structs = [F.struct(F.lit(n).alias("name"), F.round(v, 4).alias("value"), b.alias("bias")) for n, v, b in items]
    return rows.select(*by, F.inline(F.array(*structs)))


def composite_inputs(chain: DataFrame, meta: DataFrame, panel: DataFrame, vix: DataFrame) -> DataFrame:
    """All per-chain measures of the usable expiry of every snapshot, one row per chain.

    The chains are partitioned once; the measures and the joins between them reuse that.  They move as packed rows:
    of loose contracts every measure would read other columns, so that each had a shuffle, and an input, of its own.
    The panel counts up to the snapshot's day.
    """
    key = list(O.CHAIN)
    chains = O.packed(chain.dropna(subset=key)).repartition(*O.CHAIN)
    chosen = chains.join(O.usable_expiry(O.unpacked(chains)), key, "left_semi")
    quotes = O.unpacked(O.with_spot(chosen, meta).repartition(*O.CHAIN))
    profile = O.gex_profile(quotes)
    rows = O.expected_move(quotes, vix)
    for part in (
        quotes.groupBy(*key).agg(F.max("spot").alias("spot")),
        O.oi_walls(quotes),
        O.max_pain(quotes),
        O.put_call_ratios(quotes),
        O.iv_skew(quotes),
        O.gex_boundaries(profile),
        O.gex_summary(profile),
    ):
        rows = rows.join(part, key, "left")
    rows = asof_price_structure(rows, panel, at="asof_dt")
    rows = asof_calendar(rows, vix, ["vix", "vix_3m"], "asof_dt")
    return (
        rows.withColumn("fd", F.coalesce(F.col("fd"), F.lit(1.5)))
        .withColumn("regime", market_regime(F.col("fd")))
        .withColumn("structure", O.term_structure(F.col("vix"), F.col("vix_3m")))
        .withColumns(O.vrp_columns(F.col("iv_used")))
    )


def composite_analysis(
    chain: DataFrame, meta: DataFrame, panel: DataFrame, vix: DataFrame, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Bias, confidence, floor and ceiling of every snapshot for every ticker that asked for it.

    Spot, floors and ceilings are in units of the asked-for ticker; walls, pivots, dealer levels and maximum pain in those
    of the chain.  A snapshot without ``meta`` keeps one row: no ticker, spot, bias or range.
    """
    rows = add_range(composite_inputs(chain, meta, panel, vix))
    rows = rows.dropna(subset=list(O.CHAIN)).withColumn("_row", F.struct("*"))
    rows = bias_vote(evidence_rows(rows, (*O.CHAIN, "_row")), weights, carry=["_row"]).select("_row.*", "bias", "confidence")
    asked = meta.select(*O.SNAPSHOT, *[c for c in ("ticker",) if c in meta.columns], "futures_spot", "proxy_used")
    rows = rows.join(asked, list(O.SNAPSHOT), "left")
    ticker = F.col("ticker") if "ticker" in asked.columns else F.col("symbol")
    priced = F.col("spot").isNotNull()
    ratio, proxy = price_ratio(F.col("spot"), F.col("futures_spot")), F.col("proxy_used")
    shown = F.when(proxy & (ratio > 1), F.col("futures_spot")).otherwise(F.col("spot"))
    levels = {
        f"{side}_{label}": F.round(rescaled(F.col(f"{side}_{label}"), ratio, proxy), 2)
        for label, _, _ in K.SIGMAS
        for side in ("floor", "ceiling")
    }
    return rows.withColumn("_ratio", ratio).select(
        ticker.alias("ticker"),
        *O.CHAIN,
        F.round(shown, 2).alias("spot_price"),
        F.round("spot", 2).alias("proxy_spot"),
        "proxy_used",
        F.round("_ratio", 4).alias("price_ratio"),
        *[c.alias(n) for n, c in levels.items()],
        F.when(priced, F.col("bias")).alias("bias"),
        F.when(priced, F.col("confidence")).alias("confidence"),
        "iv_used",
        "vrp_factor",
        "regime",
        "structure",
        "vix",
        vix_regime(F.col("vix")).alias("vix_regime"),
        "max_pain",
        F.round("fd", 3).alias("fractal_dimension"),
        F.round("parkinson_short", 4).alias("parkinson_rv"),
        "support",
        "resistance",
        "strongest_put_wall",
        "strongest_call_wall",
        "pc_ratio_oi",
        "skew_ratio",
        "gex_floor",
        "gex_ceiling",
        "total_gex",
    )
