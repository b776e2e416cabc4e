"""Connected components of a graph of long ids, by alternating large-star and small-star steps.

Each round is two aggregations and joins over the edges; the edges of a round are written to the shared folder, so that a lost executor
costs one round. Rounds grow with the logarithm of the longest path. Degrees are reduced with partial aggregation before the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, fresh, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): neighbours of u move to the least of them."""
    if large:
        sided = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sided.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u").alias("c"), F.least("u", "m").alias("m"))
    joined = sided.join(least, F.col("u") == F.col("c"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge."""
    edges = materialise(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        later = materialise(_star(_star(edges, True), False))
        now = print_of(later)
        drop_written(edges)
        edges = later
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # at the fixed point every id but the least points at the least
    lone = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(lone)
