"""Exponential means as window expressions.

``y[t] = (1-a) y[t-1] + a x[t]``, ``y[0] = x[0]`` is a recursion, which no frame
aggregate expresses.  Unrolled it is a weighted sum, ``(1-a)^t * sum(a x[i]
(1-a)^-i)``, whose weights overflow on long series.  So a series is cut into
blocks long enough that ``(1-a)^block`` is below 1e-26: inside a block the closed
form is safe, and of everything before it only the value at the end of the
previous block still matters in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import BY, START, TIME, row_index, series

_DECAY = 60.0      # exp(-60) ~ 1e-26, what is lost of older blocks
_OVERFLOW = 600.0  # exp(600) still fits a double


@dataclass(frozen=True)
class Ewm:
    """One exponential mean: output column, input column, smoothing factor.

    ``min_periods`` values must have been seen before the result is given.
    ``centered`` measures from the first value, which keeps a constant start of
    the series exact; leave it off for series of gains and losses, where zero is
    the exact point.
    """

    out: str
    source: str
    alpha: float
    min_periods: int = 1
    centered: bool = True

    @property
    def rate(self) -> float:
        return -math.log(1.0 - self.alpha)


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def _grouped(specs: Sequence[Ewm]) -> list[list[Ewm]]:
    """Specs that can share one block length, slowest decay first."""
    groups: list[list[Ewm]] = []
    for s in sorted(specs, key=lambda s: s.rate):
        if groups and _DECAY / groups[-1][0].rate * s.rate < _OVERFLOW:
            groups[-1].append(s)
        else:
            groups.append([s])
    return groups


def add_ewm(
    df: DataFrame,
    specs: Sequence[Ewm],
    by: Sequence[str] = BY,
    time: str = TIME,
    derive: Mapping[str, Column] | None = None,
    then: Sequence[Ewm] = (),
) -> DataFrame:
    """Add exponential means.  Nulls are allowed before the first value only.

    ``derive`` adds columns made from the first means and ``then`` smooths those
    again (a line and its signal line) within the same two sorts.
    """
    groups = _grouped([*specs, *then])
    if len(groups) > 1:
        for group in _grouped(specs):
            df = _pass(df, group, by, time, {}, [])
        df = df.withColumns(dict(derive)) if derive else df
        for group in _grouped(then):
            df = _pass(df, group, by, time, {}, [])
        return df
    return _pass(df, list(specs), by, time, dict(derive or {}), list(then))


def _pass(df: DataFrame, specs: list[Ewm], by, time: str, derive: dict, then: list[Ewm]) -> DataFrame:
    block = math.ceil(_DECAY / min(s.rate for s in [*specs, *then]))
    out = [*df.columns, *[s.out for s in specs], *derive, *[s.out for s in then]]
    df = df.withColumn("_i", row_index(series(by, time)))
    df = df.withColumns({"_b": F.floor(F.col("_i") / block), "_p": F.col("_i") % block})
    df = _smooth(df, specs, block, by, time)
    if derive:
        df = df.withColumns(derive)
    if then:
        df = _smooth(df, then, block, by, time)
    return df.select(*out)


def _smooth(df: DataFrame, specs: list[Ewm], block: int, by, time: str) -> DataFrame:
    # (key, block, time) is the order of both windows below, so they share one sort.
    ordered = Window.partitionBy(*by).orderBy("_b", time)
    so_far, before = ordered.rowsBetween(START, 0), ordered.rowsBetween(START, -1)
    in_block = Window.partitionBy(*by, "_b").orderBy(time).rowsBetween(START, 0)
    seen, local, result = {}, {}, {}
    for k, s in enumerate(specs):
        x = F.col(s.source)
        seen[f"_n{k}"] = F.count(x).over(so_far)
        if s.centered:
            seen[f"_c{k}"] = F.first(x, ignorenulls=True).over(so_far)
    for k, s in enumerate(specs):
        at = F.col(f"_c{k}") if s.centered else F.lit(0.0)
        weight = F.when(F.col(f"_n{k}") == 1, F.lit(1.0)).otherwise(F.lit(s.alpha))
        scaled = weight * (F.col(s.source) - at) * F.exp(F.col("_p") * s.rate)
        local[f"_e{k}"] = F.sum(F.coalesce(scaled, F.lit(0.0))).over(in_block) * F.exp(F.col("_p") * -s.rate)
    for k, s in enumerate(specs):
        at = F.col(f"_c{k}") if s.centered else F.lit(0.0)
        carry = F.last(F.when(F.col("_p") == block - 1, F.col(f"_e{k}")), ignorenulls=True).over(before)
        decayed = F.coalesce(carry, F.lit(0.0)) * F.exp((F.col("_p") + 1) * -s.rate)
        result[s.out] = F.when(F.col(f"_n{k}") >= max(s.min_periods, 1), at + F.col(f"_e{k}") + decayed)
    return df.withColumns(seen).withColumns(local).withColumns(result).drop(*seen, *local)


#: Decay that a block of a series with gaps spans, and the most that one step is given (exp(-200) of anything is nothing).
_SPAN, _STEP = 300.0, 200.0


def add_ewm_gaps(df: DataFrame, specs: Sequence[Ewm], by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Exponential means of series with missing values anywhere.

    The weight of what came before decays with every row, present or not: at a value ``d`` rows after the one before it is
    ``(1-a)^d / ((1-a)^d + a)``, and the value's own weight is the rest.  A row without a value keeps the mean so far; without any value
    there is none.  ``min_periods`` counts values.

    Blocks are cut by the decay summed up rather than by rows, so that long gaps fit: inside a block the closed form neither
    overflows nor loses digits, and of earlier blocks the last row of the newest one is all that matters.
    """
    kept = df.columns
    w = series(by, time)
    df = df.withColumn("_i", row_index(w))
    for k, s in enumerate(specs):
        df = _gap_pass(df, s, f"_{k}", by, time)
    return df.select(*kept, *[s.out for s in specs])


def _gap_pass(df: DataFrame, s: Ewm, tag: str, by, time: str) -> DataFrame:
    w = series(by, time)
    name = lambda c: f"_{c}{tag}"
    x = F.col(s.source).cast("double")
    there = x.isNotNull()
    last = F.last(F.when(there, F.col("_i")), ignorenulls=True).over(w.rowsBetween(START, -1))
    df = df.withColumns(
        {name("at"): last, name("n"): F.count(x).over(w.rowsBetween(START, 0)), name("c"): F.first(x, ignorenulls=True).over(w.rowsBetween(START, 0))}
    )
    late = F.least((F.col("_i") - F.col(name("at"))) * s.rate, F.lit(_STEP))
    step = F.when(there, F.coalesce(F.log1p(s.alpha * F.exp(late)), F.lit(0.0))).otherwise(0.0)
    df = df.withColumn(name("step"), step)
    df = df.withColumn(name("sum"), F.sum(name("step")).over(w.rowsBetween(START, 0)))
    df = df.withColumn(name("b"), F.floor(F.col(name("sum")) / _SPAN))
    # (key, block, time) is the order of both windows, so they share one sort.
    ordered = Window.partitionBy(*by).orderBy(name("b"), time)
    in_block = Window.partitionBy(*by, name("b")).orderBy(time).rowsBetween(START, 0)
    center = F.col(name("c")) if s.centered else F.lit(0.0)
    weight = F.when(F.col(name("n")) == 1, F.lit(1.0)).otherwise(-F.expm1(-F.col(name("step"))))
    inside = F.col(name("sum")) - F.col(name("b")) * _SPAN
    scaled = F.when(there, weight * (x - center) * F.exp(inside)).otherwise(0.0)
    df = df.withColumn(name("e"), F.sum(scaled).over(in_block) * F.exp(-inside))
    ends = F.coalesce(F.lead(name("b")).over(ordered) != F.col(name("b")), F.lit(True))
    df = df.withColumn(name("end"), F.when(ends, F.struct(name("e"), name("sum"))))
    carry = F.last(name("end"), ignorenulls=True).over(ordered.rowsBetween(START, -1))
    df = df.withColumn(name("carry"), carry)
    rest = F.col(name("carry"))[name("e")] * F.exp(F.col(name("carry"))[name("sum")] - F.col(name("sum")))
    y = center + F.col(name("e")) + F.coalesce(rest, F.lit(0.0))
    return df.withColumn(s.out, F.when(F.col(name("n")) >= max(s.min_periods, 1), y))
