"""Vector search: exact top-k by distance, and joins of its result. One query is answered by JVM expressions, a table of queries by products of matrices in Python workers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors

DEFAULT_TOP_K = 10
#: Rows that a task compares at once with the queries dealt to it, and queries whose distances it holds at once.
BUCKET, CHUNK = 16_384, 256


def nearest(rows: DataFrame, column: str, query, k: int = DEFAULT_TOP_K, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """The ``k`` rows of least distance, with ``_distance``; a top-k per task, then one merge. ``tie`` orders equal distances."""
    out = rows.filter(F.col(column).isNotNull()).withColumn("_distance", vectors.distance(metric, column, query))
    return out.orderBy(F.col("_distance").asc_nulls_last(), *([tie] if tie else [])).limit(k)


def vector_search(rows: DataFrame, column: str, query, k: int = DEFAULT_TOP_K, metric: str = "cosine", pk: str = "id") -> DataFrame:
    """(row_id TEXT, score FLOAT), best first. A filter on the result applies after the top-k."""
    found = nearest(rows.select(pk, column), column, query, k, metric, pk)
    return found.select(F.col(pk).cast("string").alias("row_id"), vectors.score(metric, F.col("_distance")).alias("score"))


def with_rows(found: DataFrame, rows: DataFrame, pk: str) -> DataFrame:
    """The search result joined to its table; the result has at most k rows, so it is broadcast."""
    return rows.join(F.broadcast(found), F.col("row_id") == rows[pk].cast("string"))


def nearest_of_many(rows: DataFrame, asked: DataFrame, column: str, key: str, k: int = DEFAULT_TOP_K, metric: str = "cosine") -> DataFrame:
    """:func:`nearest` for every row of ``asked`` (asked, q) at once, by brute force, in double precision: (asked, near, seen), where near has the ``k`` (distance, key) of least distance, ties by key, and seen counts the rows compared."""
    rows = rows.filter(F.col(column).isNotNull())
    buckets = max(1, math.ceil(rows.count() / BUCKET))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.lit(0).alias("list"), F.col(key).alias("key"), F.col(column).alias("v"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    return in_buckets(dealt, asked.filter("q IS NOT NULL").select(everywhere, F.array(F.lit(0)).alias("lists"), "asked", "q"), k, metric)


def in_buckets(rows: DataFrame, asked: DataFrame, k: int, metric: str) -> DataFrame:
    """The search of :func:`nearest_of_many` for rows (bucket, list, key, v) and queries (bucket, lists, asked, q): in a bucket, a query is compared with the rows of its lists."""
    near = T.ArrayType(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("key", rows.schema["key"].dataType)]))
    schema = T.StructType([T.StructField("asked", asked.schema["asked"].dataType), T.StructField("near", near), T.StructField("seen", T.LongType())])
    metric, chunk = metric.lower(), CHUNK

    def search(left, right):  # by value: the executors need nothing of this package
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        def matrix(column):
            lists = column.combine_chunks()
            sizes = {*lists.value_lengths().to_pylist()} if len(lists) else {0}
            return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1) if sizes != {0} and len(sizes) == 1 else sizes

        def placed(x):
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            return np.divide(x, norm, out=np.where(norm == 0, 0.0, np.nan) * np.ones_like(x), where=norm > 0)

        to = to_arrow_schema(schema)
        if not len(left) or not len(right):
            return to.empty_table()
        left = left.sort_by([("list", "ascending"), ("key", "ascending")])
        x, q = matrix(left["v"]), matrix(right["q"])
        if isinstance(x, set) or isinstance(q, set) or x.shape[1] != q.shape[1]:
            raise ValueError(f"vectors differ in length: {x if isinstance(x, set) else x.shape[1]} {q if isinstance(q, set) else q.shape[1]}")
        if metric == "cosine":
            x, q = placed(x), placed(q)
        names, begin, size = np.unique(left["list"].to_numpy(), return_index=True, return_counts=True)
        wanted = right["lists"].combine_chunks()
        owner = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy(zero_copy_only=False))
        wanted = wanted.flatten().to_numpy()
        place = np.zeros(len(x), np.int64)
        place[pc.sort_indices(left["key"]).to_numpy()] = np.arange(len(x))  # of the keys, for ties
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in range(len(q))]
        seen = np.zeros(len(q), np.int64)
        for name, a, n in zip(names, begin, size, strict=True):
            own, block = owner[wanted == name], x[a : a + n]
            seen[own] += n
            for at in range(0, len(own), chunk):
                some = own[at : at + chunk]
                # not by BLAS: equal vectors shall have equal distances
                gap = np.einsum("ik,jk->ij", q[some], block)
                if metric == "l2":
                    gap = np.maximum(np.einsum("ij,ij->i", q[some], q[some])[:, None] - 2 * gap + np.einsum("ij,ij->i", block, block)[None, :], 0.0)
                else:
                    gap = 1 - (np.clip(gap, -1.0, 1.0) if metric == "cosine" else gap)
                gap[np.isnan(gap)] = np.inf  # after all others, as in nearest()
                most = np.partition(gap, min(k, n) - 1, axis=1)[:, min(k, n) - 1]
                for i, d, limit in zip(some, gap, most, strict=True):
                    near = np.flatnonzero(d <= limit)
                    ds, rows_ = np.concatenate([best[i][0], d[near]]), np.concatenate([best[i][1], near + a])
                    first = np.lexsort((place[rows_], ds))[:k]
                    best[i] = ds[first], rows_[first]
        lengths = np.cumsum([0, *(len(d) for d, _ in best)])
        found = pa.StructArray.from_arrays([pa.array(np.concatenate([d for d, _ in best])), left["key"].combine_chunks().take(pa.array(np.concatenate([r for _, r in best])))], fields=list(to.field("near").type.value_type))
        return pa.Table.from_arrays([right["asked"], pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), found), pa.array(seen)], names=to.names).cast(to)

    parts = rows.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(search, schema)
    return parts.groupBy("asked").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("seen").alias("seen"))
