"""Vector operators (F6, V1, V2, J10, O6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import vector
from . import query, table

AXIS = [1.0] + [0.0] * 63
MIX = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]


def _sql(q) -> str:
    return "[" + ",".join(map(str, q)) + "]::DOUBLE[]"


def distance(q) -> str:
    """1 - cosine in double precision, rounded so that the order of additions doesn't matter."""
    return f"round(1 - list_dot_product(embedding::DOUBLE[], {_sql(q)}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({_sql(q)}, {_sql(q)})), 4)"


@query("f6_cosine_distance", f"SELECT vec_id, {distance(MIX)} AS d FROM embeddings")
def f6(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine_distance("embedding", MIX).cast("double"), 4).alias("d"))


@query("v1_top_k", f"SELECT vec_id FROM embeddings ORDER BY {distance(MIX).replace(', 4)', ', 12)')}, vec_id LIMIT 10")
def v1(spark, d):
    return vector.nearest(table(spark, d, "embeddings"), "embedding", MIX, 10, tie="vec_id").select("vec_id")


@query("v2_vector_search", f"SELECT CAST(vec_id AS VARCHAR) AS row_id, round(1 - {distance(AXIS).replace(', 4)', ', 12)')}, 3) AS score FROM embeddings ORDER BY {distance(AXIS).replace(', 4)', ', 12)')}, vec_id LIMIT 5")
def v2(spark, d):
    found = vector.vector_search(table(spark, d, "embeddings"), "embedding", AXIS, 5, pk="vec_id")
    return found.select("row_id", F.round(F.col("score").cast("double"), 3).alias("score"))


@query("v2b_filter_after_search", f"SELECT row_id FROM (SELECT CAST(vec_id AS VARCHAR) AS row_id, {distance(MIX)} AS dist FROM embeddings ORDER BY {distance(MIX).replace(', 4)', ', 12)')}, vec_id LIMIT 20) t WHERE CAST(row_id AS BIGINT) % 2 = 0")
def v2b(spark, d):
    return vector.vector_search(table(spark, d, "embeddings"), "embedding", MIX, 20, pk="vec_id").filter(F.col("row_id").cast("bigint") % 2 == 0).select("row_id")


@query("v2c_l2_scores", f"SELECT vec_id, round(-list_sum(list_transform(list_zip(embedding::DOUBLE[], {_sql(AXIS)}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 3) AS s FROM embeddings")
def v2c(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.score("l2", vectors.l2_distance("embedding", AXIS)).cast("double"), 3).alias("s"))


@query("j10_join_search", f"SELECT vec_id, label FROM embeddings ORDER BY {distance(MIX).replace(', 4)', ', 12)')}, vec_id LIMIT 10")
def j10(spark, d):
    e = table(spark, d, "embeddings")
    return vector.with_rows(vector.vector_search(e, "embedding", MIX, 10, pk="vec_id"), e, "vec_id").select("vec_id", "label")
