"""Row-frame helpers.

A series is the rows of one key (``by``) in time order.  Bars are unique per
(key, day), so a series is bounded by the calendar (about 36,500 rows a
century) however large the panel is; what grows is the number of series.

A trailing value is null until its frame is full, because Spark evaluates a
partly filled ROWS frame and these indicators must not.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BY = ("symbol",)
TIME = "dt"

START = Window.unboundedPreceding


def series(by: Sequence[str] = BY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(time)


def whole(by: Sequence[str] = BY) -> WindowSpec:
    return Window.partitionBy(*by)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(START, 0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | float, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a if isinstance(a, Column) else F.lit(a), b)


def roll_count(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Non-null values among the last n rows, as a difference of two running counts."""
    c = col(c)
    return F.count(c).over(running(w)) - F.count(c).over(w.rowsBetween(START, -n))


#: Up to this many rows a frame is added up anew for every row; longer ones are differences of running sums.
DIRECT = 250
#: From this many rows on, ``add_means`` adds a frame up in steps of so many rows.
LONG, STEP = 40, 10


def _filled(value: Column, c: Column, n: int, w: WindowSpec) -> Column:
    return F.when(roll_count(c, n, w) == n, value)


def roll_sum(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Sum of the last n rows.

    A frame is summed by itself, n additions a row, so an earlier row leaves no residue; above ``DIRECT`` rows it is a difference
    of running sums, two additions a row.
    """
    c = col(c)
    if n <= DIRECT:
        return _filled(F.sum(c).over(w.rowsBetween(-(n - 1), 0)), c, n, w)
    before = F.coalesce(F.sum(c).over(w.rowsBetween(START, -n)), F.lit(0.0))
    return _filled(F.sum(c).over(running(w)) - before, c, n, w)


def roll_avg(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Mean of the last n rows; of equal values it is that value, to the last bit.

    Signals compare means with each other and with prices, and n equal decimals rarely add up to n times one of them.
    """
    frame = w.rowsBetween(-(n - 1), 0)
    low = F.min(col(c)).over(frame)
    return F.when(low == F.max(col(c)).over(frame), _filled(low, col(c), n, w)).otherwise(roll_sum(c, n, w) / F.lit(n))


def add_means(panel: DataFrame, means: Mapping[str, int], c: str = "close", by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Adds means of the last n rows, as ``roll_avg`` has them.

    Whether the last n values are equal is told by how often the value has moved, a running count, so a mean costs one frame of n rows instead
    of three.  A long frame of doubles is added up from the sums of STEP rows each: n / STEP + STEP additions a row instead of n, and
    still none of a row outside of it.
    """
    w = series(by, time)
    moved = ~F.lag(c).over(w).eqNullSafe(F.col(c))
    parted = {n for n in means.values() if LONG <= n <= DIRECT and n % STEP == 0} if dict(panel.dtypes).get(c) == "double" else set()
    steps = {"_step": F.sum(c).over(w.rowsBetween(1 - STEP, 0))} if parted else {}
    panel = panel.withColumns({"_moved": moved.cast("int"), **steps})

    def total(n: int) -> Column:
        if n not in parted:
            return roll_sum(c, n, w)
        out = F.lag("_step", n - STEP).over(w)
        for k in range(n - 2 * STEP, 0, -STEP):
            out = out + F.lag("_step", k).over(w)
        return out + F.col("_step")

    def mean(n: int) -> Column:
        moves = F.sum("_moved").over(running(w)) - F.coalesce(F.sum("_moved").over(w.rowsBetween(START, -(n - 1))), F.lit(0))
        return F.when(roll_count(c, n, w) == n, F.when(moves == 0, F.col(c)).otherwise(total(n) / F.lit(n)))

    return panel.withColumns({out: mean(n) for out, n in means.items()}).drop("_moved", *steps)


def add_extremes(panel: DataFrame, extremes: Mapping[str, tuple], by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """Adds for each (F.max or F.min, column, n) the extreme of the n rows before the current one, null unless all n have a value.

    It is the extreme of the extremes of few rows each, which may overlap: about twice the root of n values a row instead of n.
    """
    w = series(by, time)
    short = {out: max(1, math.isqrt(n)) for out, (_, _, n) in extremes.items()}
    panel = panel.withColumns({f"_x_{out}": fn(c).over(w.rowsBetween(1 - short[out], 0)) for out, (fn, c, _) in extremes.items()})

    def extreme(out: str, fn, c: str, n: int) -> Column:
        ends = sorted({*range(1, n - short[out] + 1, short[out]), n - short[out] + 1})
        parts = [F.lag(f"_x_{out}", k).over(w) for k in ends]
        whole = parts[0] if len(parts) == 1 else (F.greatest if fn is F.max else F.least)(*parts)
        there = F.count(c).over(w.rowsBetween(START, -1)) - F.count(c).over(w.rowsBetween(START, -n - 1))
        return F.when(there == n, whole)

    panel = panel.withColumns({out: extreme(out, *x) for out, x in extremes.items()})
    return panel.drop(*[f"_x_{out}" for out in extremes])


def _sliding(fn, c: str | Column, n: int, w: WindowSpec) -> Column:
    return F.when(roll_count(c, n, w) == n, fn(col(c)).over(w.rowsBetween(-(n - 1), 0)))


def roll_std(c: str | Column, n: int, w: WindowSpec) -> Column:
    """Sample standard deviation; a sliding frame, since differences of squares cancel badly.  Equal values have 0."""
    frame = w.rowsBetween(-(n - 1), 0)
    flat = F.min(col(c)).over(frame) == F.max(col(c)).over(frame)
    return F.when(flat & (roll_count(c, n, w) == n) & F.lit(n > 1), 0.0).otherwise(_sliding(F.stddev_samp, c, n, w))


def roll_min(c: str | Column, n: int, w: WindowSpec) -> Column:
    return _sliding(F.min, c, n, w)


def roll_max(c: str | Column, n: int, w: WindowSpec) -> Column:
    return _sliding(F.max, c, n, w)


def shifted(fn, c: str | Column, lo: int, hi: int, w: WindowSpec) -> Column:
    """fn over rows lo..hi relative to the current one, null unless every row is there."""
    frame = w.rowsBetween(lo, hi)
    return F.when(F.count(col(c)).over(frame) == hi - lo + 1, fn(col(c)).over(frame))


def row_index(w: WindowSpec) -> Column:
    """0-based position in the series."""
    return F.row_number().over(w) - 1


def latest(c: str | Column, w: WindowSpec, end: int = 0) -> Column:
    """Last non-null value up to ``end`` rows from the current one."""
    return F.last(col(c), ignorenulls=True).over(w.rowsBetween(START, end))


def holds(cond: Column) -> Column:
    """A predicate where unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def two_state(enter: str, leave: str, w: WindowSpec) -> Column:
    """State (0/1) of an in/out automaton driven by two boolean columns.

    Only ``enter``: in.  Only ``leave``: out.  Both: toggle, because leaving is
    looked at only while in and entering only while out.  Neither: keep.  The
    state is therefore the value at the last row that decides on its own, plus
    the parity of the toggles since.
    """
    e, x = F.col(enter), F.col(leave)
    decides = e != x
    toggles = F.sum((e & x).cast("int")).over(running(w))
    at_decision = F.last(F.when(decides, toggles), ignorenulls=True).over(running(w))
    value = F.last(F.when(decides, e.cast("int")), ignorenulls=True).over(running(w))
    parity = F.coalesce(value, F.lit(0)) + toggles - F.coalesce(at_decision, F.lit(0))
    return (parity % 2).cast("int")
