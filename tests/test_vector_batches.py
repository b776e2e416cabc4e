"""Searches for many vectors at once against one search each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.engine import Engine
from strandline.operators import vector
from strandline.operators.vector_index import VectorIndex
from strandline.queries import QUERIES, maintenance

VECTORS = "vec_id bigint, e array<float>"


def vectors(n, dim=4, seed=1):
    """Whole numbers, so distances that are equal are exactly equal; with copies, a zero vector and a null one."""
    x = np.random.default_rng(seed).integers(-3, 4, size=(n, dim)).astype(float)
    x[n // 2 :: 3] = x[1]
    x[2] = 0
    return [(i, None if i == 5 else [float(v) for v in row]) for i, row in enumerate(x)]


def one_by_one(rows, asked, metric, k=6):
    """By definition, in double precision, ties by key."""
    return {a: [key for _, key in sorted((gap(metric, q, e), key) for key, e in rows if e is not None)[:k]] for a, q in asked if q is not None}


def gap(metric, q, e):
    q, e = np.array(q), np.array(e)
    if metric == "l2":
        return round(float(((q - e) ** 2).sum()), 9)
    norm = np.linalg.norm(q) * np.linalg.norm(e)
    return round(float(1 - q @ e if metric == "dot" else 1 - q @ e / norm if norm else 1.0), 9)


def keys(df):
    return {r["asked"]: [x["key"] for x in r["near"]] for r in df.collect()}


def distances(df):
    return {r["asked"]: [round(x["distance"], 6) for x in r["near"]] for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_many_are_searched_as_one_each(spark, monkeypatch, metric):
    monkeypatch.setattr(vector, "BUCKET", 17)
    monkeypatch.setattr(vector, "CHUNK", 3)
    data = vectors(60)
    rows = spark.createDataFrame(data, VECTORS)
    asked = rows.filter("vec_id % 4 < 2").select(F.col("vec_id").alias("asked"), F.col("e").alias("q"))
    found = vector.nearest_of_many(rows, asked, "e", "vec_id", 6, metric)
    want = one_by_one(data, [x for x in data if x[0] % 4 < 2], metric)
    by_key = dict(data)
    assert distances(found) == {a: [round(gap(metric, by_key[a], by_key[x]), 6) for x in near] for a, near in want.items()}
    if metric != "cosine":  # its equal distances needn't be equal to the last bit
        assert keys(found) == want
    assert {r["seen"] for r in found.collect()} == {59}
    one = [r["vec_id"] for r in vector.nearest(rows, "e", by_key[8], 6, metric, "vec_id").collect()]
    assert sorted(gap(metric, by_key[8], by_key[x]) for x in one) == sorted(gap(metric, by_key[8], by_key[x]) for x in keys(found)[8])


def test_many_of_none(spark):
    rows = spark.createDataFrame(vectors(20), VECTORS)
    asked = rows.select(F.col("vec_id").alias("asked"), F.col("e").alias("q"))
    assert vector.nearest_of_many(rows.limit(0), asked, "e", "vec_id").collect() == []
    assert vector.nearest_of_many(rows, asked.limit(0), "e", "vec_id").collect() == []
    with pytest.raises(Exception, match="vectors differ in length"):
        vector.nearest_of_many(rows, asked.withColumn("q", F.slice("q", 1, 3)), "e", "vec_id").collect()


@pytest.mark.parametrize("probes", [1, 3, None])
def test_index_is_searched_for_many(spark, tmp_path, monkeypatch, probes):
    """The candidates of each query: flushed lists (small ones together, large ones in several buckets), changed, new and deleted vectors."""
    monkeypatch.setattr(vector, "BUCKET", 11)
    s = Engine(spark, f"file://{tmp_path}").session()
    s.sql("CREATE SHARED TABLE v (vec_id BIGINT PRIMARY KEY, e EMBEDDING(4)); ALTER TABLE v CREATE VECTOR INDEX e USING L2")
    s.insert("v", spark.createDataFrame(vectors(80), VECTORS))
    s.sql("STORAGE FLUSH TABLE v; DELETE FROM v WHERE vec_id = 7; UPDATE v SET e = '[9,9,9,9]' WHERE vec_id = 8; INSERT INTO v VALUES (-1, '[1,0,0,1]')")
    index = VectorIndex(s.engine.log(s.table_def("v")), "e", "l2")
    ask = [(i, q) for i, q in vectors(40, seed=2) if i % 8 == 1]
    found = index.search_many(spark.createDataFrame(ask, "asked bigint, q array<float>"), 6, probes=probes)
    want, seen = {}, {}
    for a, q in ask:
        near = [(r["vec_id"], list(r["e"])) for r in index.candidates(q, probes=probes).filter("e IS NOT NULL").collect()]
        want |= one_by_one(near, [(a, q)], "l2")
        seen[a] = len(near)
    assert keys(found) == want and {r["asked"]: r["seen"] for r in found.collect()} == seen


def test_recall_takes_as_many_jobs_for_many_vectors(spark, tmp_path, monkeypatch):
    """200 vectors are searched for in a few jobs."""
    x = np.random.default_rng(3).normal(size=(200, 64))
    spark.createDataFrame([(100 * i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    real = maintenance._indexed

    def then_counted(*args):
        out = real(*args)
        spark.sparkContext.setJobGroup("searches", "")
        return out

    monkeypatch.setattr(maintenance, "_indexed", then_counted)
    try:
        assert QUERIES["v3_index_recall"](spark, str(tmp_path)).first()["recalled"]
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("searches")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
