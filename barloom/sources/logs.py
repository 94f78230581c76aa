"""The prediction log and the weight-change log: append-only tables with fixed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("spot_price", T.DoubleType()),
        T.StructField("floor", T.DoubleType()),
        T.StructField("ceiling", T.DoubleType()),
        T.StructField("bias", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("expiry", T.DateType()),
        T.StructField("vix", T.DoubleType()),
        T.StructField("gex_net", T.DoubleType()),
        T.StructField("regime", T.StringType()),
    ]
)
_DIGITS = {"spot_price": 2, "floor": 2, "ceiling": 2, "confidence": 1, "vix": 2, "gex_net": 2}

WEIGHT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("weight_name", T.StringType()),
        T.StructField("old_value", T.DoubleType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)


def coerced(raw: DataFrame) -> DataFrame:
    """Rows of text as predictions: what cannot be read becomes null."""
    cols = []
    for f in PREDICTION_SCHEMA.fields:
        c = F.col(f.name)
        text = c.cast("string")
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.nanvl(text.try_cast("double"), F.lit(None).cast("double")).alias(f.name))
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            cols.append(text.try_cast(f.dataType).alias(f.name))
        else:
            cols.append(text.alias(f.name))
    return raw.select(*cols)


def prediction_rows(analysis: DataFrame, date, timestamp) -> DataFrame:
    """Composite-analysis rows in the layout of the log, rounded as logged.

    ``date`` and ``timestamp`` are values or columns.  The ticker is the one that was asked for, whose units the range has; the
    regime is that of the volatility index, which the feedback step groups by.
    """
    rows = analysis.select(
        F.lit(date).cast("date").alias("date"),
        F.lit(timestamp).cast("timestamp_ntz").alias("timestamp"),
        "ticker",
        "spot_price",
        F.col("floor_1sigma").alias("floor"),
        F.col("ceiling_1sigma").alias("ceiling"),
        "bias",
        "confidence",
        "expiry",
        "vix",
        F.col("total_gex").alias("gex_net"),
        F.col("vix_regime").alias("regime"),
    )
    return rows.withColumns({c: F.round(c, d) for c, d in _DIGITS.items()})


def append_predictions(rows: DataFrame, path: str) -> None:
    """Append to the log; columns and types are those of the schema or the write fails."""
    types = {f.name: f.dataType for f in PREDICTION_SCHEMA.fields}
    rows.select(*[F.col(n).cast(t).alias(n) for n, t in types.items()]).write.mode("append").parquet(path)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The log; text formats are read as text and coerced."""
    if fmt == "parquet":
        return spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in PREDICTION_SCHEMA.fields])
    return coerced(spark.read.format(fmt).schema(text).option("header", True).load(path))


def append_weight_changes(changes: DataFrame, path: str, seq: int, date, reason: str) -> None:
    """Append weight changes of one retune; ``seq`` orders the retunes."""
    rows = changes.select(
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(date).cast("date").alias("date"),
        "weight_name",
        F.round("old_value", 4).alias("old_value"),
        F.round("new_value", 4).cast("string").alias("new_value"),
        F.lit(reason).alias("reason"),
    )
    rows.write.mode("append").parquet(path)


def read_weight_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHT_SCHEMA).parquet(path)
