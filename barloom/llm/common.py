"""Helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries a worker's memo may hold before it starts anew.
MEMO = 150_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of its own only on one machine, where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the executors need a folder they share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage, survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, into: str) -> DataFrame:
    """Adds each row's number (from 0) in ascending ``order``, nulls first: range partitions, and the rows before each of them.

    Tasks number their own range; only one count for each partition is summed in one place.
    """
    held = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    held = written(held, "numbered").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return held.join(parts, "_part").withColumn(into, number).drop("_at", "_part", "_before")


#: Rows of an Arrow batch between Spark and Python: texts are long, so 10,000 of them are too many.
BATCH_ROWS = 1000
_memos: dict[str, Callable[[], None]] = {}


def short_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to at most BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def working(name: str, forget: Callable[[], object] | None = None) -> None:
    """A worker process begins work of this name: what it remembers of other work goes, so that memory doesn't add up."""
    for other in [n for n in _memos if n != name]:
        _memos.pop(other)()
    if forget:
        _memos[name] = forget


def notes_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, as ``k`` and ``t``; a missing text is empty."""
    short_batches(df.sparkSession)
    return df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def text_id(c: str | Column) -> Column:
    """16 bytes that equal texts share."""
    return F.unhex(F.md5(F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One memo a worker process, whatever operators it runs.
HASHES = WordHashes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words; of all words, if there are fewer."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def connected(edges: DataFrame, a: str, b: str, rounds: Callable[[int], None] | None = None) -> DataFrame:
    """The smallest id each node of a graph is connected to: columns ``node`` and ``label``.

    Every round takes the smallest label around a node and then the label of that label, so the
    number of rounds grows with the logarithm of a component's diameter.  Each round is written.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = written(both.union(both.select("near", "node")).distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("seen")), "near")
        low = near.groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(low, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = written(
            step.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")),
            "labels",
        )
        moved = new.filter("next <> label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def sliced(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in smaller ones, so that few long texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
