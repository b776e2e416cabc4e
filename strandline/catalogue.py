"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import ORACLES, QUERIES, maintenance, relational, scalar, scans, statements, streams, vectors


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by return flag and line status."""
    return QUERIES["a1_group_by"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["flagship", "maintenance", "oracle_sql", "queries", "relational", "scalar", "scans", "statements", "streams", "vectors"]
