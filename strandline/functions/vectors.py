"""Vector distances as higher-order JVM expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def query_vector(query) -> Column:
    """A query vector given as a list, as JSON text or as a column."""
    if isinstance(query, Column):
        return query
    values = json.loads(query) if isinstance(query, str) else list(query)
    return F.array(*(F.lit(float(v)).cast("float") for v in values))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _same_length(a: Column, b: Column, value: Column) -> Column:
    wrong = F.raise_error(F.concat_ws(" ", F.lit("vectors differ in length:"), F.size(a).cast("string"), F.size(b).cast("string")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value).otherwise(wrong.cast("double"))


def cosine_distance(vector, query) -> Column:
    """1 - cosine, as FLOAT; 1 for a zero vector, null for a null one, an error for different lengths."""
    a, b = F.col(vector) if isinstance(vector, str) else vector, query_vector(query)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    cosine = F.greatest(F.least(_dot(a, b) / norm, F.lit(1.0)), F.lit(-1.0))
    return _same_length(a, b, F.when(norm == 0, F.lit(1.0)).otherwise(1 - cosine)).cast("float")


def l2_distance(vector, query) -> Column:
    """The squared Euclidean distance."""
    a, b = F.col(vector) if isinstance(vector, str) else vector, query_vector(query)
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return _same_length(a, b, square).cast("float")


def dot_distance(vector, query) -> Column:
    """1 - dot product."""
    a, b = F.col(vector) if isinstance(vector, str) else vector, query_vector(query)
    return _same_length(a, b, 1 - _dot(a, b)).cast("float")


def distance(metric: str, vector, query) -> Column:
    return {"cosine": cosine_distance, "l2": l2_distance, "dot": dot_distance}[metric.lower()](vector, query)


def score(metric: str, dist: Column) -> Column:
    """Higher is better: 1 - distance, or the negative squared distance."""
    return (-dist if metric.lower() == "l2" else 1 - dist).cast("float")
