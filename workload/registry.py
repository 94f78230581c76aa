"""Registered queries: a Spark function of (session, data folder) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return fn

    return add


def shown(df: DataFrame, *cols: str, digits: int = 6, **per_column: int) -> DataFrame:
    """The columns of a result, doubles rounded so that engines can be compared."""
    types = dict(df.dtypes)
    names: Sequence[str] = cols or df.columns
    return df.select(
        *[F.round(c, per_column.get(c, digits)).alias(c) if types[c] == "double" else F.col(c) for c in names]
    )


def rl(fn: str, x: str, n: int, part: str = "symbol", order: str = "dt", extra: str = "") -> str:
    """SQL for a trailing aggregate over exactly n values."""
    f = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {fn}({x}) {f} END"
