"""Mixing sources to target weights: a low-discrepancy schedule of slots over shuffled equal-word blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fractional part of the golden ratio in units of 2^-31, made odd: its multiples modulo 2^31 are the points, each once.
GOLDEN = 1327217885


def note_size(text: str | Column) -> Column:
    """Words between ASCII white space; 0 for a missing text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float = 3.0) -> DataFrame:
    """(source, size) -> source, source_size, target.

    The sources in order of code points, null last, get the weights in turn and share the words of all.  A
    target stops at ``most`` times the source's size; the excess goes to the others by weight until none is above.
    In order of cap / weight the capped sources come first, so running sums over the sources (one row each) find
    the level at which the others stand.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark compares strings by their UTF-8 bytes, which is the order of code points.
    order = Window.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    # A source is capped if the level that holds when all before it are capped lies above its cap.
    free = F.col("level") * F.col("weight") < F.col("cap")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return per.select(
        "source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).alias("target")
    )


def _running(df: DataFrame, part: str, cell: Column, order: Sequence[Column], value: Column, into: str) -> DataFrame:
    """Exclusive running sum within each part, in order of (cell, order): sums of cells, then inside each cell.

    No window holds more than one cell of a part, or one row for each of its cells.
    """
    df = df.withColumn("_cell", cell).withColumn("_value", value)
    cells = df.groupBy(part, "_cell").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col(part).alias("_part"), F.col("_cell").alias("_at"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(part, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    df = df.join(cells, df[part].eqNullSafe(cells["_part"]) & (df["_cell"] == cells["_at"]))
    return df.withColumn(into, F.col("_base") + F.col("_local")).drop("_cell", "_value", "_local", "_part", "_at", "_base")


def schedule(targets: DataFrame, block: int, seed: int = 0, cells: int = 4096, per_cell: int = 1 << 16) -> DataFrame:
    """Slots of ``block`` words: slot, source, rank (the n-th slot of its source), words.

    Slot j lies at the fractional part of j times the golden ratio and goes to the source on whose share of the
    targets' line it falls: every stretch of slots has the sources in proportion, to a few slots.  The last slot of a source
    is cut or filled so that the source gets its target, rounded down; a source that no slot falls on gets one at the end.
    """
    spark = targets.sparkSession
    whole = Window.partitionBy()
    line = Window.orderBy(F.col("source").isNull(), "source")
    shares = targets.filter("target >= 1").withColumn("want", F.floor("target").cast("bigint"))
    total = F.sum("target").over(whole)
    shares = shares.select(
        "source", "want", (F.sum("target").over(line) / total).alias("hi"), ((F.sum("target").over(line) - F.col("target")) / total).alias("lo")
    )
    found = targets.agg(F.sum("target")).head()[0] or 0.0
    n = -(-int(found) // block)
    unit = 1 << 31
    point = ((F.col("slot") + seed) % unit * F.lit(GOLDEN).cast("bigint") % unit) * F.lit(1.0 / unit)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("_part", F.floor(F.col("point") * cells).cast("int"))
    spread = shares.withColumn(
        "_part", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int")))
    )
    slots = slots.join(spread, "_part").filter("point >= lo and point < hi").select("slot", "source", "want")
    slots = _running(slots, "source", F.floor(F.col("slot") / per_cell), [F.col("slot")], F.lit(1), "rank")
    missed = shares.join(slots.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_anti")
    slots = slots.unionByName(missed.select(F.lit(n).cast("bigint").alias("slot"), "source", "want", F.lit(0).cast("bigint").alias("rank")))
    counts = slots.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    slots = slots.join(counts, F.col("source").eqNullSafe(F.col("s")))
    start = F.col("rank") * block
    end = F.when(F.col("rank") == F.col("n") - 1, F.col("want")).otherwise(F.least(start + block, F.col("want")))
    return slots.select("slot", "source", "rank", F.greatest(end - start, F.lit(0)).alias("words"), start.alias("start"))


def mix_sources(
    notes: DataFrame,
    key: str = "seq",
    text: str = "reason",
    source: str = "weight_name",
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    block: int = 256,
    seed: int = 17,
    cells: int = 4096,
) -> DataFrame:
    """How many words of each note a mix takes: key, size, source, source_size, target, taken.

    Notes are rows with a key, a free text and a source, as ``seq``, ``reason`` and ``weight_name`` of the
    weight-change log.  The size of a note is its number of words.  Sources get targets (source_targets) and slots
    (schedule).  The notes of a source, shuffled by a hash of key, text and ``seed``, form a line of words, cut into
    blocks of ``block`` words; the n-th slot of a source takes the n-th block, starting over at the end of the line, so a
    source that is taken two and a half times repeats every note twice and half of them once more.  ``taken`` is at most
    ``most`` times the size, sums up to the target of the source, rounded down, and is the same in every run.

    Only window and join expressions: hot sources are split into ``cells`` by the shuffling hash before any running
    sum, and notes meet slots by block.  Null texts and texts without words have size and taken 0; null is a source of its
    own, the last; repeated rows each have a place of their own.  No rows give no rows; extra columns are left out.
    """
    rows = notes.select(F.col(key).alias("k"), F.col(source).alias("source"), note_size(text).alias("size"), F.xxhash64(key, text, F.lit(seed)).alias("deal"))
    rows = written(rows, "sizes")  # a few numbers a note; the texts are read once
    targets = source_targets(rows, weights, most)
    line = _running(rows, "source", F.floor(F.shiftrightunsigned(F.col("deal"), 11) * F.lit(2.0**-53) * cells), [F.col("deal"), F.col("k")], F.col("size"), "at")
    t = targets.withColumnRenamed("source", "s")
    line = line.join(t, line["source"].eqNullSafe(t["s"])).drop("s")
    # Each place of a note on the source's line, laid end to end ``most`` times, block by block.
    want = F.floor("target").cast("bigint")
    laid = line.filter("size > 0").withColumn("from", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.col("at") + p * F.col("source_size"))))
    laid = laid.filter(F.col("from") < want).withColumn("to", F.least(F.col("from") + F.col("size"), want))
    last = F.floor((F.col("to") - 1) / block)
    laid = laid.select("k", "source", "deal", "at", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), last)).alias("b"))
    slots = schedule(targets, block, seed).filter("words > 0")
    ends = slots.select(F.col("source").alias("s"), "rank", "start", (F.col("start") + F.col("words")).alias("end"))
    # A filled last slot spans several blocks: one row for each.
    ends = ends.select("s", "start", "end", F.explode(F.sequence(F.col("rank"), F.floor((F.col("end") - 1) / block))).alias("b"))
    met = laid.join(ends, laid["source"].eqNullSafe(ends["s"]) & (laid["b"] == ends["b"]))
    lo = F.greatest("from", laid["b"] * block, "start")
    hi = F.least("to", (laid["b"] + 1) * block, "end")
    taken = met.groupBy("source", "at", "k", "deal").agg(F.sum(F.greatest(hi - lo, F.lit(0))).alias("words"))
    taken = taken.select(F.col("source").alias("s"), F.col("at").alias("a"), "words")
    out = line.join(taken, line["source"].eqNullSafe(taken["s"]) & (line["at"] == taken["a"]) & (line["size"] > 0), "left")
    return out.select(F.col("k").alias(key), "size", F.col("source").alias(source), "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"))
