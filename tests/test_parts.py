import pytest

from strandline.operators import versions as V
from strandline.plans import select as S
from strandline.plans.live_shape import live_parts
from strandline.plans.statements import classify
from strandline.plans.tokens import SqlError, split_statements, tokenize
from strandline.sources.catalog import CatalogError
from strandline.streaming import live, stream_tables
from strandline.types import SPELLINGS, TypeError_, parse_type


def test_types():
    for name, spellings in SPELLINGS.items():
        for s in spellings:
            text = f"{s}(3)" if name == "EMBEDDING" else s
            assert parse_type(text).name == name
    assert str(parse_type("decimal")) == "DECIMAL(38,10)" and str(parse_type("numeric(10, 2)")) == "DECIMAL(10,2)" and parse_type("VARCHAR(20)").name == "TEXT"
    for bad in ("INTERVAL", "DECIMAL(39,1)", "DECIMAL(3,4)", "EMBEDDING", "EMBEDDING(9000)", "EMBEDDING(0)", "ARRAY"):
        with pytest.raises(TypeError_):
            parse_type(bad)


def test_splitting_and_tokens():
    assert split_statements("SELECT ';' ; -- a;b\n SELECT \"x;y\" /* ; */; ") == ["SELECT ';'", "-- a;b\n SELECT \"x;y\" /* ; */"]
    assert [t.text for t in tokenize("a->>'b''c' >= 1.5e3")] == ["a", "->>", "'b''c'", ">=", "1.5e3"]
    with pytest.raises(SqlError):
        tokenize("SELECT 'open")


KINDS = {
    "create namespace if not exists a": "create_namespace", "USE a": "use_namespace", "show namespaces": "show_namespaces", "drop namespace a cascade": "drop_namespace", "create table t (id int primary key)": "create_table",
    "alter table t add column c int": "alter_table", "drop table if exists t": "drop_table", "show tables": "show_tables", "describe table t history": "describe_table", "show stats for table t": "show_stats", "create view v as select 1": "create_view",
    "create storage s type 's3'": "create_storage", "show storages": "show_storages", "storage check s": "check_storage", "storage flush table a.t": "flush_table", "storage flush all": "flush_all", "storage compact table t": "compact_table", "storage compact all in a": "compact_all",
    "show manifest": "show_manifest", "kill job 'x'": "kill_job", "kill live query 'x'": "kill_live_query", "subscribe to a.t": "subscribe", "create topic t partitions 3": "create_topic", "drop topic t": "drop_topic", "clear topic t": "clear_topic",
    "alter topic t add source a.b on insert": "add_topic_source", "consume from t group 'g' from earliest limit 5": "consume", "ack t group 'g' partition 1 upto offset 9": "ack", "create user 'u' with password 'p' role 'user'": "create_user", "alter user 'u' set role 'dba'": "alter_user",
    "drop user 'u'": "drop_user", "backup database a to '/x'": "backup", "restore database a from '/x'": "restore", "export user data": "export_user_data", "show export": "show_export", "select 1": "select", "with a as (select 1) select * from a": "select", "insert into t values (1)": "insert",
    "update t set a = 1 where b = 2": "update", "delete from t where a = 1": "delete", "begin": "begin", "start transaction": "begin", "commit": "commit", "rollback": "rollback", "explain select 1": "meta", "set a = 1": "meta", "show all": "meta", "execute as user 'u' (select 1)": "execute_as", "cluster list": "cluster",
}


@pytest.mark.parametrize("sql,kind", KINDS.items())
def test_classifier(sql, kind):
    assert classify(sql).kind == kind


def test_rewriting():
    assert S.rewrite_json("a.b->'x'->>'y' = 1") == 'get_json_object(to_json(variant_get(try_parse_json(a.b), "$[\'x\']", "variant")), "$[\'y\']") = 1'
    assert S.bind_params("a = $2 AND b = $1 AND c = $2", [1, 2]) == ("a = ? AND b = ? AND c = ?", [2, 1, 2])
    for bad in (("$3", [1]), ("1", list(range(51))), ("$1", ["x" * 600_000])):
        with pytest.raises(SqlError):
            S.bind_params(*bad)
    names = [(n, m, a) for _, _, n, m, a in S.table_names("SELECT t.x FROM a.b, c AS k JOIN d.e f ON f.x = b.y WHERE z IN (SELECT q FROM g)")]
    assert names == [("t", "x", False), ("a", "b", True), (None, "c", False), ("d", "e", False), ("f", "x", False), ("b", "y", False), (None, "g", True)]
    assert S.strings_as_spark("'it''s' || 'a\\b'") == "'it\\'s' || 'a\\\\b'"


def test_live_shapes():
    assert live_parts("SELECT a, b FROM n.t WHERE a = 1 AND (b > 2)") == ("n.t", ["a", "b"], "a = 1 AND (b > 2)")
    assert live_parts("select * from t;") == ("t", [], None)
    for bad in ("SELECT a FROM (SELECT 1) t", "SELECT a FROM t GROUP BY a", "WITH x AS (SELECT 1) SELECT a FROM x", "SELECT a FROM t, u", "SELECT a FROM t WHERE a IN (SELECT 1)", "SELECT a FROM t WHERE"):
        with pytest.raises(SqlError):
            live_parts(bad)


def test_version_merge_fixtures(spark):
    """The merge batches of the survey's fixtures 20 and 21."""
    schema = "id string, _seq long, _commit_seq long, _deleted boolean, name string, _tier int"
    rows = [("a", 2, 2, False, "hot", 0), ("a", 1, 1, False, "cold", 1), ("b", 3, 1, False, "b", 1), ("c", 2, 1, False, "c", 1), ("d", 1, 1, False, "d", 1), ("d", 5, 1, True, "d", 0), ("", 7, 1, False, "e1", 0), ("", 8, 1, False, "e2", 0), (None, 9, None, None, "n", 1)]
    log = spark.createDataFrame(rows, schema)
    want = {("a", "hot"), ("b", "b"), ("c", "c"), ("", "e1"), ("", "e2"), (None, "n")}
    assert {(r.id, r.name) for r in V.resolve(log, "id").collect()} == want == {(r.id, r.name) for r in V.resolve_by_aggregate(log, "id").collect()}
    snap = spark.createDataFrame([("a", 4, 0, False, "hot", 0), ("a", 5, 2, False, "cold", 1)], schema)
    assert V.resolve(snap, "id", snapshot=1).first().name == "hot" and V.resolve(snap, "id").first().name == "cold"
    tie = spark.createDataFrame([("a", 1, 1, False, "cold", 1), ("a", 1, 1, False, "hot", 0)], schema)
    assert V.resolve(tie, "id").first().name == "hot"
    assert V.count_current(log, "id").first().n == 6


def test_stream_buckets_and_boundary():
    assert [stream_tables.bucket(s)[0] for s in (60, 86_400, 86_401, 7 * 86_400, 8 * 86_400, 31 * 86_400)] == ["hour", "hour", "day", "day", "week", "month"]
    assert live.snapshot_boundary(1_704_067_200_001) == (1 << 22) | ((1 << 22) - 1)


def test_structured_streaming(spark, tmp_path):
    """A log is followed with a checkpoint: each version once, also over a restart."""
    schema = "id int, v string, _seq long"
    path, seen = str(tmp_path / "log"), []
    sink = lambda df, _: seen.extend(r.id for r in df.collect())
    for part in ([(1, "a", 1), (2, "b", 2)], [(3, "a", 3)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        live.follow(live.log_stream(spark, path, schema), sink, str(tmp_path / "check"), "v = 'a'").awaitTermination()
    assert sorted(seen) == [1, 3]


def test_watermarked_windows(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandline.streaming import windows

    events = spark.createDataFrame([("2024-01-01 00:01:00", 1), ("2024-01-01 00:02:00", 2), ("2024-01-01 00:11:00", 4)], "t string, v int").select(F.col("t").cast("timestamp").alias("ts"), "v")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    out = windows.tumbling(stream, "ts", "10 minutes", [], F.sum("v").alias("s"), late="1 minute")
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.s for r in spark.table("w").collect()) == [3, 4]


def test_errors_are_one_family():
    assert issubclass(CatalogError, ValueError) and issubclass(SqlError, ValueError)


def test_key_ranges():
    """Only conditions that must hold choose segments."""
    r = lambda q, args=None: S.key_range(q, "id", args)
    assert r("SELECT a FROM t WHERE id = 5") == (5, 5) and r("SELECT a FROM t x WHERE x.id = 5 AND b = 1 ORDER BY a") == (5, 5)
    assert r("SELECT a FROM t WHERE 3 < id AND id <= 9 LIMIT 1") == (3, 9) and r("SELECT a FROM t WHERE id BETWEEN 2 AND 4 AND a > 1") == (2, 4)
    assert r("SELECT a FROM t WHERE id IN (7, 3, 5)") == (3, 7) and r("SELECT a FROM t WHERE a = ? AND id = ?", [1, 8]) == (8, 8)
    assert r("SELECT a FROM t WHERE id > 4") == (4, None) and r("SELECT a FROM t WHERE id = 'x'") == ("x", "x")
    for q in ("SELECT a FROM t", "SELECT a FROM t WHERE id = 5 OR a = 1", "SELECT a FROM t WHERE NOT id = 5", "SELECT a FROM t WHERE (id = 5 OR a = 1)", "SELECT a FROM t WHERE id + 1 = 5", "SELECT a FROM t WHERE id <> 5", "SELECT a FROM t WHERE id NOT IN (1, 2)", "SELECT a FROM t WHERE id = b", "SELECT a FROM t WHERE id = -5", "SELECT a FROM t WHERE id = 1 UNION SELECT a FROM t", "SELECT a FROM t WHERE a IN (SELECT a FROM t WHERE id = 5)"):
        assert r(q) is None, q


def test_groups_of_ranges():
    from strandline.sources.segments import overlapping

    assert sorted(map(sorted, overlapping([(1, 3), (8, 9), (3, 5), (6, 7), (4, 4)]))) == [[0, 2, 4], [1], [3]]
    assert overlapping([]) == [] and overlapping([(1, 2), (None, None)]) == [[0, 1]]


def test_probes():
    import numpy as np

    from strandline.operators.vector_index import measured_probes

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8)) * 50
    near = np.repeat(centers, 40, axis=0) + rng.normal(size=(480, 8))
    assert measured_probes(rng.permutation(near), centers) == 1 and measured_probes(rng.normal(size=(400, 8)), rng.normal(size=(12, 8))) > 2
