"""Scoring logged predictions and learning the vote weights from them.

The log has one row per prediction (date, timestamp, ticker, spot_price, floor,
ceiling, bias, confidence, expiry, vix, gex_net, regime).  Weights are a table of
seven rows (name, weight); they reach the log as one map value through a scalar
subquery, so trying other weights costs no join and no copies of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ranking import running_position
from ..functions.windows import holds
from .joins import asof_forward

NAMES = list(K.SIGNAL_WEIGHTS)


def latest_predictions(log: DataFrame) -> DataFrame:
    """The newest prediction per ticker and day; a missing timestamp loses, equal ones are settled by their values."""
    rest = [c for c in log.columns if c not in ("date", "ticker", "timestamp")]
    top = log.groupBy("date", "ticker").agg(F.max(F.struct("timestamp", *rest)).alias("_r"))
    return top.select(*[F.col(c) if c in ("date", "ticker") else F.col(f"_r.{c}").alias(c) for c in log.columns])


def weight_table(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((weights or K.SIGNAL_WEIGHTS).items()), "name string, weight double")


def current_weights(spark: SparkSession, changes: DataFrame, baseline: dict[str, float] | None = None) -> DataFrame:
    """Baseline weights with the last readable change of each name; unknown names are ignored."""
    last = (
        changes.withColumn("_v", F.col("new_value").try_cast("double"))
        .filter("_v is not null and not isnan(_v)")
        .groupBy(F.col("weight_name").alias("name"))
        .agg(F.max_by("_v", "seq").alias("_v"))
    )
    base = weight_table(spark, baseline)
    return base.join(last, "name", "left").select("name", F.coalesce("_v", "weight").alias("weight"))


def eligibility(
    log: DataFrame,
    as_of,
    min_days: int = K.RETUNE_MIN_DAYS,
    window_days: int = K.RETUNE_WINDOW_DAYS,
    min_rows: int = K.RETUNE_MIN_ROWS,
) -> DataFrame:
    """One row: days on record, rows in the learning window, and whether that is enough."""
    since = F.date_sub(_day(as_of), window_days)
    out = log.agg(
        F.count_distinct("date").alias("days"),
        F.count(F.when(F.col("date") >= since, 1)).alias("recent_rows"),
    )
    return out.withColumn("eligible", (F.col("days") >= min_days) & (F.col("recent_rows") >= min_rows))


def _day(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def in_window(log: DataFrame, as_of, window_days: int = K.RETUNE_WINDOW_DAYS) -> DataFrame:
    return log.filter(F.col("date") >= F.date_sub(_day(as_of), window_days))


def score_predictions(log: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions with the first close after their day and how they fared; those without one are left out."""
    closes = bars.select(F.col("symbol").alias("ticker"), F.col("dt").alias("date"), F.col("close").alias("actual_close"))
    scored = asof_forward(log.filter("date is not null"), closes, ["actual_close"], ["ticker"], "date")
    a, lo, hi, spot = (F.col(c) for c in ("actual_close", "floor", "ceiling", "spot_price"))
    error = F.when(a < lo, (lo - a) / spot * 100).when(a > hi, (a - hi) / spot * 100).otherwise(F.lit(0.0))
    right = (
        ((F.col("bias") == "BULLISH") & (a > spot))
        | ((F.col("bias") == "BEARISH") & (a < spot))
        | (F.col("bias") == "NEUTRAL")
    )
    return scored.filter("actual_close is not null").withColumns(
        {"in_range": holds((a >= lo) & (a <= hi)), "bias_correct": holds(right), "range_error": error}
    )


def range_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("predictions"),
        (F.avg(F.col("in_range").cast("double")) * 100).alias("range_accuracy"),
        (F.avg(F.col("bias_correct").cast("double")) * 100).alias("bias_accuracy"),
        F.avg("range_error").alias("mean_error"),
    )


def recent_accuracy(scored: DataFrame, last: int = 30) -> DataFrame:
    """Accuracy of each ticker's newest predictions."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    newest = scored.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last)
    return range_accuracy(newest, ["ticker"])


# ---- trying other weights -----------------------------------------------------------


def weights_map(weights: DataFrame) -> Column:
    """The weights table, one row per name, as a map value."""
    one = weights.agg(F.map_from_entries(F.collect_list(F.struct("name", "weight"))).alias("m"))
    return one.scalar()


def width_scale(weight_of) -> Column:
    """How much wider or narrower a range gets under other weights; three of the names matter."""
    total = F.lit(0.0)
    for name, share in K.WIDTH_MIX.items():
        base = K.SIGNAL_WEIGHTS[name]
        total = total + F.coalesce(weight_of(name), F.lit(base)) / max(base, 0.01) * share
    return total


def still_inside(scale: Column) -> Column:
    """Whether the close would lie in the range rescaled around its middle; false without a spot price."""
    lo, hi, a = F.col("floor"), F.col("ceiling"), F.col("actual_close")
    middle, half = (lo + hi) / 2, (hi - lo) * scale / 2
    usable = F.col("spot_price").isNotNull() & (F.col("spot_price") != 0)
    return holds(usable & (a >= middle - half) & (a <= middle + half))


def accuracy_under(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: accuracy if the ranges had been built with other weights."""
    rows = scored.withColumn("_w", weights_map(weights))
    scale = width_scale(lambda n: F.col("_w")[n])
    return rows.agg((F.avg(still_inside(scale).cast("double")) * 100).alias("accuracy"))


def leave_one_out(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """What accuracy would be lost without each signal: positive means the signal helps.

    Dropping a signal spreads its weight over the others in proportion.  All
    scenarios are evaluated in one pass as seven averages of one aggregation.
    """
    rows = scored.withColumn("_w", weights_map(weights))
    w = F.col("_w")
    positive = lambda n: F.greatest(F.coalesce(w[n], F.lit(0.0)), F.lit(0.0))

    def without(name: str):
        rest = F.lit(0.0)
        for other in NAMES:
            if other != name:
                rest = rest + positive(other)
        factor = 1 + F.when(rest > 0, w[name] / rest).otherwise(F.lit(0.0))
        return lambda n: F.lit(0.0) if n == name else F.when(w[n] > 0, w[n] * factor).otherwise(w[n])

    pct = lambda c: F.avg(c.cast("double")) * 100
    one = rows.agg(
        pct(F.col("in_range")).alias("_base"), *[pct(still_inside(width_scale(without(n)))).alias(n) for n in NAMES]
    )
    structs = [F.struct(F.lit(n).alias("name"), F.round(F.col("_base") - F.col(n), 2).alias("score")) for n in NAMES]
    return one.select(F.inline(F.array(*structs)))


def proposed_weights(weights: DataFrame, scores: DataFrame, max_change: float = K.RETUNE_MAX_CHANGE) -> DataFrame:
    """Weights moved by at most ``max_change`` along their scores, kept within bounds, summing to one.

    Both tables have one row per signal name, so the window over all rows sees seven.
    """
    every = Window.partitionBy()
    rows = weights.join(scores, "name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    s = F.col("score")
    rows = rows.withColumns(
        {
            "_top": F.greatest(F.max(F.abs(s)).over(every), F.lit(0.01)),
            "_flat": F.max(s).over(every) == F.min(s).over(every),
        }
    )
    moved = F.col("weight") * (1 + s / F.col("_top") * max_change)
    bounded = F.greatest(F.lit(K.RETUNE_MIN_WEIGHT), F.least(F.lit(K.RETUNE_MAX_WEIGHT), moved))
    rows = rows.withColumn("_b", bounded)
    fair = F.col("_b") / F.sum("_b").over(every)
    return rows.select(
        "name", F.col("weight").alias("old_weight"), F.when(F.col("_flat"), F.col("weight")).otherwise(fair).alias("weight")
    )


def holdout_rows(scored: DataFrame, share: float = K.RETUNE_HOLDOUT) -> DataFrame:
    """The newest ``share`` of the scored predictions, in order of time; equal times go by the hash of the ticker."""
    placed = running_position(scored, "date", "timestamp", "ticker")
    total = scored.agg(F.count("*").alias("n")).scalar()
    placed = placed.withColumn("_n", total)
    start = F.floor(F.round(F.col("_n") * (1 - share), 6))
    return placed.filter(F.col("position") > start).drop("position", "_n")


def holdout_check(
    scored: DataFrame, proposed: DataFrame, baseline: DataFrame, min_accuracy: float = K.RETUNE_MIN_ACCURACY
) -> DataFrame:
    """One row: do the proposed weights do at least as well on the held-out rows, and well enough?"""
    held = holdout_rows(scored).withColumns({"_b": weights_map(baseline), "_p": weights_map(proposed.select("name", "weight"))})
    pct = lambda m: F.avg(still_inside(width_scale(lambda n: F.col(m)[n])).cast("double")) * 100
    out = held.agg(F.count("*").alias("held_out"), pct("_b").alias("_ba"), pct("_p").alias("_pa"))
    out = out.withColumn("_n", scored.agg(F.count("*").alias("n")).scalar())
    enough = (F.col("_n") >= 10) & (F.col("held_out") >= 5)
    good = (F.col("_pa") >= F.col("_ba")) & (F.col("_pa") >= min_accuracy * 100)
    value = lambda c: F.when(enough, F.round(c, 1)).otherwise(F.lit(0.0))
    return out.select(
        "held_out",
        value("_ba").alias("baseline_accuracy"),
        value("_pa").alias("proposed_accuracy"),
        holds(enough & good).alias("passed"),
    )


def regime_adjustments(scored: DataFrame, min_rows: int = 5) -> DataFrame:
    """Accuracy, mean width and suggested scale of each volatility regime."""
    out = (
        scored.filter("regime is not null and regime <> ''")
        .groupBy("regime")
        .agg(
            F.count("*").alias("predictions"),
            (F.avg(F.col("in_range").cast("double")) * 100).alias("_a"),
            F.avg(F.col("ceiling") - F.col("floor")).alias("_w"),
            F.avg("spot_price").alias("_s"),
        )
        .filter(F.col("predictions") >= min_rows)
    )
    a = F.col("_a")
    return out.select(
        "regime",
        "predictions",
        F.round(a, 1).alias("accuracy"),
        F.round(F.when(F.col("_s") > 0, F.col("_w") / F.col("_s") * 100).otherwise(F.lit(0.0)), 2).alias("width_pct"),
        F.when(a > 75, 0.85).when(a > 65, 1.0).when(a > 55, 1.15).otherwise(1.30).alias("range_scale"),
    )


def weight_changes(proposed: DataFrame, check: DataFrame, threshold: float = 0.001) -> DataFrame:
    """Changes to apply: none unless the hold-out check passed."""
    rows = proposed.withColumn("_ok", check.select("passed").scalar())
    return rows.filter(F.col("_ok") & (F.abs(F.col("weight") - F.col("old_weight")) > threshold)).select(
        F.col("name").alias("weight_name"), F.col("old_weight").alias("old_value"), F.col("weight").alias("new_value")
    )
