"""Weight learning end to end: eligibility, scores, proposal, hold-out check, regime scales.

Nothing is applied: the result is four tables, and ``changes`` is what one would
append to the weight-change log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import feedback as L


@dataclass(frozen=True)
class Retune:
    """``report``: one row; ``proposal``: one row per signal; ``regimes``; ``changes``."""

    report: DataFrame
    proposal: DataFrame
    regimes: DataFrame
    changes: DataFrame
    scored: DataFrame

    def release(self) -> None:
        """Give back the storage of the scored predictions, which all four tables read."""
        self.scored.unpersist()


def retune(
    spark: SparkSession,
    log: DataFrame,
    bars: DataFrame,
    as_of,
    weights: DataFrame,
    baseline: DataFrame | None = None,
    min_accuracy: float = K.RETUNE_MIN_ACCURACY,
) -> Retune:
    """``log`` holds one prediction per ticker and day (see ``latest_predictions``)."""
    baseline = L.weight_table(spark) if baseline is None else baseline
    fit = L.eligibility(log, as_of)
    recent = L.score_predictions(L.in_window(log, as_of), bars)
    recent = recent.withColumn("_ok", fit.select("eligible").scalar()).filter("_ok").drop("_ok").persist()
    proposal = L.proposed_weights(weights, L.leave_one_out(recent, weights))
    check = L.holdout_check(recent, proposal, baseline, min_accuracy)
    one = lambda df, c: df.select(c).scalar()
    report = fit.withColumns({c: one(check, c) for c in ("held_out", "baseline_accuracy", "proposed_accuracy", "passed")})
    report = report.withColumn("passed", F.coalesce("passed", F.lit(False)))
    return Retune(report, proposal, L.regime_adjustments(recent), L.weight_changes(proposal, check), recent)
