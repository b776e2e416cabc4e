"""The engine's queries over the test tables, by operator id, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator's id."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """SQL over test tables given as ``{name}``; the frames are bound as arguments, so no view is left."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def total(c) -> Column:
    """A sum of amounts with two decimals. Rounding takes away what the order of additions leaves, since a true sum never lies near a tie."""
    return F.round(F.sum(c), 2)
