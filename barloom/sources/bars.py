"""Reading and writing price bars, and the universe of symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators.bars import VALUES, drop_empty_rows, drop_missing_close, normalize_names, without_nan

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("dt", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in VALUES],
    ]
)


def clean_bars(df: DataFrame) -> DataFrame:
    """Bars as the operators expect them: no NaN, no row without a close."""
    return drop_missing_close(without_nan(drop_empty_rows(df)))


def read_bars(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    symbols: Sequence[str] | None = None,
    start=None,
    end=None,
    **options,
) -> DataFrame:
    """Bars from files.  Symbol and date filters reach the scan, so files and row groups are skipped."""
    if fmt == "csv":
        options = {"header": True, "dateFormat": "yyyy-MM-dd", **options}
    df = spark.read.format(fmt).schema(BAR_SCHEMA).options(**options).load(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.filter(F.col("dt") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("dt") <= F.lit(end).cast("date"))
    return clean_bars(df)


def read_raw_bars(df: DataFrame, time: str = "date") -> DataFrame:
    """Vendor columns (any case, padded names, timestamps with a zone) as bars."""
    df = normalize_names(df)
    typed = [F.col(c).cast("double").alias(c) for c in VALUES]
    return clean_bars(df.select("symbol", F.to_date(F.col(time).cast("timestamp_ntz")).alias("dt"), *typed))


def write_snapshot(bars: DataFrame, path: str, snapshot_date, fmt: str = "parquet") -> None:
    """Store bars under their download day; writing a day again replaces that day only."""
    out = bars.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
    (
        out.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .save(path)
    )


def read_snapshot(spark: SparkSession, path: str, snapshot_date, fmt: str = "parquet") -> DataFrame:
    """Bars of one download day; only its folder is read."""
    schema = T.StructType([*BAR_SCHEMA.fields, T.StructField("snapshot_date", T.DateType())])
    df = spark.read.format(fmt).schema(schema).load(path)
    return df.filter(F.col("snapshot_date") == F.lit(snapshot_date).cast("date")).drop("snapshot_date")


def universe(spark: SparkSession, listing: DataFrame, column: str = "symbol", default: Sequence[str] | None = None):
    """Distinct symbols of a listing with '.' written as '-'; the default list if the listing is empty."""
    listed = listing.select(F.translate(F.trim(F.col(column)), ".", "-").alias("symbol")).distinct()
    names = K.WATCHLIST if default is None else list(default)
    fallback = spark.createDataFrame([(n,) for n in names], "symbol string")
    size = listed.agg(F.count("*").alias("n")).scalar()
    fallback = fallback.withColumn("_n", size).filter("_n = 0").drop("_n")
    return listed.unionByName(fallback)
