"""Every registered query of the engine against its SQL in DuckDB, over the smallest test tables."""

import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline import catalogue

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_plans(spark):
    """Filters and columns reach the scan; small dimension tables are broadcast; top-k needs no full sort."""
    q = catalogue.queries()
    plan = lambda name: q[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in plan("s9_parquet_projection") and "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in plan("s9_parquet_projection")
    assert "WindowGroupLimit" in plan("s1_versioned_scan")
    assert "EqualTo(o_orderkey,420)" in plan("s5_point_lookup")
    assert "o_totalprice" not in plan("s6_count_scan").split("ReadSchema", 1)[1]
    assert "TakeOrderedAndProject" in plan("o3_top_k") and "BroadcastHashJoin" in plan("j2_small_side")


def test_flushed_vectors_hold_the_whole_table(spark, monkeypatch):
    from strandline.queries import maintenance

    seen, real = [], maintenance.vector.vector_search
    monkeypatch.setattr(maintenance.vector, "vector_search", lambda df, *a, **b: seen.append(df) or real(df, *a, **b))
    assert [r.row_id for r in catalogue.queries()["v4_flushed_vectors"](spark, D).collect()] == ["11"]
    assert seen[0].count() == spark.read.parquet(f"{D}/embeddings.parquet").count()


def test_not_in_broadcasts_no_values(spark):
    """However many values there are: with Spark's broadcasts off only the row that counts them is one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["j7_not_in"](spark, D)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan and re.search(r"SortMergeJoin.*LeftAnti", plan)


@pytest.mark.parametrize("condition", ["l_quantity > 10", "l_quantity > 10 AND l_partkey IS NOT NULL", "l_quantity > 99"])
def test_not_in_follows_nulls(spark, tmp_path, condition):
    from strandline.queries.relational import not_in

    spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 11.0), (1, 12.0), (3, 9.0), (2, None), (None, 11.0)], "l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    part, lineitem = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("part", "lineitem"))
    got = not_in(part, "p_partkey", lineitem.filter(condition).select("l_partkey")).collect()
    want = duckdb.sql(f"SELECT p_partkey FROM '{tmp_path}/part.parquet/*.parquet' WHERE p_partkey NOT IN (SELECT l_partkey FROM '{tmp_path}/lineitem.parquet/*.parquet' WHERE {condition})").fetchall()
    assert sorted(map(str, got)) == sorted(f"Row(p_partkey={k})" for (k,) in want)
    assert len(want) == {"l_quantity > 10": 0, "l_quantity > 99": 5}.get(condition, 3)


def test_partition_choice_takes_pages(spark, monkeypatch):
    """The driver gets a page of messages at a time, and what a partition lacks or repeats is still noticed."""
    from strandline.streaming.topics import Topics

    taken, real = [], Topics.consume
    monkeypatch.setattr(Topics, "consume", lambda self, *a, **b: taken.append(rows := real(self, *a, **b)) or rows)
    query = catalogue.queries()["t8_partition_choice"]
    n = spark.read.parquet(f"{D}/orders.parquet").filter("o_orderkey % 3 = 0").count()
    assert query(spark, D).collect() == [(True, n)] and taken and max(map(len, taken)) <= 100 < n
    read = Topics.reading
    for wrong in (lambda m: m.filter("offset <> 120"), lambda m: m.unionAll(m.filter("offset = 120")), lambda m: m.withColumn("partition_id", F.lit(1))):
        monkeypatch.setattr(Topics, "reading", lambda *a, **b: wrong(read(*a, **b)))  # noqa: B023
        assert not query(spark, D).first()["own"]
