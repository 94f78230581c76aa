"""Passes over series that are longer than a task, cut into chunks of time.

A window over (key, time) holds a whole series in one task, which days bear and ticks or minutes of many years do not.
Here a series is cut by ``chunk``, a column that grows with time (its day, say): each chunk is reduced to its transfer, what it
does to the state that enters it, by a hash aggregate with partial sums; the transfers of a series, one row a chunk, are scanned by a
window; and every chunk is finished alone with the state that enters it.  No task holds more of a series than a chunk
of its rows, or one row for each of its chunks.

The last signal, the highest value and a linear map of one number are such transfers.  Keys may be null; rows of one key must
have different times; no rows give no rows.  Columns that begin with ``_`` are the passes' own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ewm import _SPAN, Ewm, add_ewm
from .windows import BY, START, TIME, holds, running


def _entering(
    df: DataFrame, by: Sequence[str], transfer: Mapping[str, Column], scan: Callable[[DataFrame, WindowSpec], DataFrame], states: Sequence[str]
) -> DataFrame:
    """``df`` with the states that enter each row's chunk (column ``_chunk``).

    ``transfer`` holds aggregates over a chunk; ``scan`` adds the states to the table of transfers, given the window of a series'
    chunks in order.
    """
    sums = df.groupBy(*by, "_chunk").agg(*[c.alias(n) for n, c in transfer.items()])
    found = scan(sums, Window.partitionBy(*by).orderBy("_chunk"))
    key = [*by, "_chunk"]
    found = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], *states)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(found, on).drop(*[f"_k{i}" for i in range(len(key))])


def _in_chunk(by: Sequence[str], time: str) -> WindowSpec:
    return Window.partitionBy(*by, "_chunk").orderBy(time)


def add_position_chunked(signals: DataFrame, chunk: Column, signal: str = "signal", by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """``position`` 0/1 with the rows on which it changes, as ``add_position``: the last signal that is not 0 decides.

    Null signals change nothing.
    """
    kept = signals.columns
    decisive = F.nullif(F.col(signal), F.lit(0))
    df = signals.withColumns({"_chunk": chunk, "_s": decisive})
    last = F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col(time)))
    scan = lambda t, w: t.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(START, -1)))
    df = _entering(df, by, {"_last": last}, scan, ["_before"])
    w = _in_chunk(by, time)
    now = F.coalesce(F.last("_s", ignorenulls=True).over(running(w)), F.col("_before"))
    then = F.coalesce(F.last("_s", ignorenulls=True).over(w.rowsBetween(START, -1)), F.col("_before"))
    df = df.withColumns({"_now": holds(now == 1), "_then": holds(then == 1)})
    return df.select(*kept, F.col("_now").cast("int").alias("position"), (F.col("_now") & ~F.col("_then")).alias("entered"), (~F.col("_now") & F.col("_then")).alias("exited"))


def add_peak_chunked(curve: DataFrame, chunk: Column, value: str = "close", by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """``peak``: the highest value so far, from which drawdowns are measured.  Null until there is a value."""
    kept = curve.columns
    scan = lambda t, w: t.withColumn("_before", F.max("_top").over(w.rowsBetween(START, -1)))
    df = _entering(curve.withColumn("_chunk", chunk), by, {"_top": F.max(value)}, scan, ["_before"])
    peak = F.greatest(F.max(value).over(running(_in_chunk(by, time))), F.col("_before"))
    return df.select(*kept, peak.alias("peak"))


def add_ewm_chunked(df: DataFrame, spec: Ewm, chunk: Column, by: Sequence[str] = BY, time: str = TIME) -> DataFrame:
    """One exponential mean, as ``add_ewm`` has it, of series of any length.

    Inside a chunk the mean is begun anew with the chunk's first value ``x``; what enters as ``y`` adds ``(1-a)^k (y - x)`` at its
    k-th row.  So a chunk of n rows maps y to ``(1-a)^n (y - x)`` plus its own last mean.  Rows without a value get no mean
    and do not count.
    """
    kept = df.columns
    there = F.col(spec.source).isNotNull()
    begun = Ewm("_own", spec.source, spec.alpha)
    rows = add_ewm(df.filter(there).withColumn("_chunk", chunk), [begun], by=[*by, "_chunk"], time=time)
    rows = rows.withColumn("_row", F.row_number().over(_in_chunk(by, time)))
    transfer = {
        "_n": F.count("*"),
        "_x": F.min_by(F.col(spec.source).cast("double"), time),
        "_end": F.max_by("_own", time),
    }

    def scan(t: DataFrame, w: WindowSpec) -> DataFrame:
        before = w.rowsBetween(START, -1)
        # The state behind chunk c is the sum of b[j] exp(-(S[c] - S[j])), S being the decay summed up; blocks of S as for series with gaps.
        first = F.row_number().over(w) == 1
        decay = F.exp(-F.col("_n") * spec.rate)
        t = t.withColumns({"_seen": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_c": F.first("_x").over(running(w))})
        own = F.col("_end") - F.col("_c")
        t = t.withColumns({"_b": F.when(first, own).otherwise(own - decay * (F.col("_x") - F.col("_c"))), "_sum": F.sum("_n").over(running(w)) * spec.rate})
        t = t.withColumn("_block", F.floor(F.col("_sum") / _SPAN))
        inside = F.col("_sum") - F.col("_block") * _SPAN
        in_block = Window.partitionBy(*by, "_block").orderBy("_chunk").rowsBetween(START, 0)
        t = t.withColumn("_e", F.sum(F.col("_b") * F.exp(inside)).over(in_block) * F.exp(-inside))
        ends = F.coalesce(F.lead("_block").over(w) != F.col("_block"), F.lit(True))
        t = t.withColumn("_carry", F.last(F.when(ends, F.struct("_e", "_sum")), ignorenulls=True).over(before))
        rest = F.col("_carry._e") * F.exp(F.col("_carry._sum") - F.col("_sum"))
        t = t.withColumn("_y", F.col("_c") + F.col("_e") + F.coalesce(rest, F.lit(0.0)))
        return t.withColumn("_enters", F.lag("_y").over(w))

    rows = _entering(rows, by, transfer, scan, ["_x", "_enters", "_seen"])
    added = F.exp(-F.col("_row") * spec.rate) * (F.col("_enters") - F.col("_x"))
    mean = F.col("_own") + F.coalesce(added, F.lit(0.0))
    rows = rows.select(*kept, F.when(F.col("_seen") + F.col("_row") >= spec.min_periods, mean).alias(spec.out))
    return rows.unionByName(df.filter(~there).withColumn(spec.out, F.lit(None).cast("double")))
