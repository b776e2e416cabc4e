"""Checks of the remaining operators as queries: sources, write rules, jobs, access rules, topics, live queries (S, W, P, V, M, L, T, D, K, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import jobs, security
from ..operators import dml, vector
from ..operators import versions as V
from ..operators.transactions import TransactionError
from ..operators.vector_index import VectorIndex
from ..plans.live_shape import live_parts
from ..plans.tokens import SqlError
from ..sources.catalog import CatalogError
from ..sources.segments import decide
from ..streaming import live
from . import query, table
from .statements import BASE, SHOW, engine, loaded

PK = "SELECT o_orderkey AS id FROM orders"
#: Messages that a consumer takes at once.
PAGE = 100


def one(spark, **values):
    """A row of known values."""
    return spark.createDataFrame([tuple(values.values())], list(values))


def refused(f, *errors) -> bool:
    try:
        f()
    except errors:
        return True
    except Exception as e:  # Spark wraps what a row raises
        return any(isinstance(x, type) and issubclass(x, dml.ConstraintError) for x in errors) and "may not be null" in str(e)
    return False


@query("s10_segment_choice", PK + " WHERE o_orderkey = 7")
def s10(spark, d):
    """Two segments by key range; a point read opens one of them."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id BIGINT PRIMARY KEY)")
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    s.insert("t", ids.filter("id < 100"))
    s.insert("t", ids.filter("id >= 100"))
    log = s.engine.log(s.table_def("t"))
    assert len(log.choose(pk=7)) == 1 and len(log.choose()) == 2
    return s.sql("SELECT id FROM t WHERE id = 7")


@query("s12_system_scan", "SELECT 'orders' AS table_name, 'SHARED' AS table_type")
def s12(spark, d):
    return loaded(spark, d).sql("SELECT table_name, table_type FROM system.tables WHERE namespace_id = 'shop'")


@query("s13_virtual_view", "SELECT count(*) AS n FROM (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17)) t(x)")
def s13(spark, d):
    return engine(spark).session().sql("SELECT count(*) AS n FROM system.datatypes")


@query("s16_table_function", "SELECT '1' AS row_id UNION ALL SELECT '3'")
def s16(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE v (id INT PRIMARY KEY, e EMBEDDING(2)); INSERT INTO v VALUES (1, '[1,0]'), (2, '[0,1]'), (3, '[0.9,0.1]')")
    return s.sql("SELECT row_id FROM vector_search('default.v', 'e', '[1,0]', 2)")


@query("s17_topic_source", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 30")
def s17(spark, d):
    s = loaded(spark, d)
    s.sql("CREATE TOPIC shop.all; ALTER TOPIC shop.all ADD SOURCE shop.orders ON UPDATE; UPDATE orders SET price = 0 WHERE id < 30")
    return s.sql("CONSUME FROM shop.all LIMIT 1000").agg(F.count(F.lit(1)).alias("n"))


@query("s18_store_uri", BASE)
def s18(spark, d):
    """A table on a storage of its own path template; every path is a URI that Hadoop resolves."""
    s = engine(spark).session()
    s.sql("CREATE STORAGE far TYPE 'filesystem' SHARED_TABLES_TEMPLATE 'far/{namespace}/{tableName}'; CREATE NAMESPACE shop; USE shop; CREATE SHARED TABLE orders (id BIGINT PRIMARY KEY, cust BIGINT, status TEXT, price DOUBLE) WITH (STORAGE_ID = 'far')")
    s.insert("orders", table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    assert s.engine.store.exists("far", "shop", "orders")
    return s.sql(SHOW)


@query("w5_stream_writes", "SELECT 'b' AS who, true AS update_refused")
def w5(spark, d):
    s = engine(spark).session()
    s.sql("CREATE STREAM TABLE t (id INT PRIMARY KEY, who TEXT) WITH (TTL_SECONDS = 3600); INSERT INTO t VALUES (1, 'a'), (2, 'b'); DELETE FROM t WHERE id = 1")
    bad = refused(lambda: s.sql("UPDATE t SET who = 'c' WHERE id = 2"), dml.ConstraintError)
    return s.sql("SELECT who FROM t").withColumn("update_refused", F.lit(bad))


@query("w6_not_null", "SELECT true AS refused, count(*) AS n FROM orders")
def w6(spark, d):
    s = loaded(spark, d)
    s.sql("ALTER TABLE orders ALTER COLUMN cust SET NOT NULL")
    bad = refused(lambda: s.sql("INSERT INTO orders (id, price) VALUES (-1, 1.0)"), dml.ConstraintError)
    return s.sql("SELECT count(*) AS n FROM orders").select(F.lit(bad).alias("refused"), "n")


@query("w7_unique_key", "SELECT true AS old_refused, true AS batch_refused, count(*) AS n FROM orders")
def w7(spark, d):
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders")
    old = refused(lambda: s.sql("INSERT INTO orders (id) VALUES (3)"), dml.ConstraintError)
    batch = refused(lambda: s.sql("INSERT INTO orders (id) VALUES (-3), (-3)"), dml.ConstraintError)
    return s.sql("SELECT count(*) AS n FROM orders").select(F.lit(old).alias("old_refused"), F.lit(batch).alias("batch_refused"), "n")


@query("w8_defaults", "SELECT 1 AS id, 'new' AS status, 'root' AS who, 26 AS len")
def w8(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY, status TEXT DEFAULT 'new', who TEXT DEFAULT CURRENT_USER(), u TEXT DEFAULT ULID(), at DATETIME DEFAULT NOW()); INSERT INTO t (id) VALUES (1)")
    return s.sql("SELECT id, status, who, length(u) AS len FROM t WHERE at IS NOT NULL")


@query("w10_files", "SELECT 'a b.txt' AS name, 5 AS size, 'text/plain' AS mime, sha256('hello') AS sha, 'hello' AS body")
def w10(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE f (id INT PRIMARY KEY, a FILE)")
    s.sql('INSERT INTO f VALUES (1, FILE("a b.txt"))', files={"a b.txt": b"hello"})
    r = s.sql("SELECT a->>'name' AS name, CAST(a->>'size' AS INT) AS size, a->>'mime' AS mime, a->>'sha256' AS sha, a FROM f").first()
    return one(spark, name=r["name"], size=r["size"], mime=r["mime"], sha=r["sha"], body=s.file("f", r["a"]).decode()).withColumn("size", F.col("size").cast("int"))


@query("w11_parquet_sink", "SELECT count(*) AS n, true AS zstd FROM orders")
def w11(spark, d):
    """A cold segment: zstd, sorted by the key, with a bloom filter on it."""
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders")
    paths = [r["path"] for r in s.sql("SELECT path FROM system.manifest").collect()]
    read = spark.read.parquet(*(s.engine.store.uri(p) for p in paths))
    return read.agg(F.count(F.lit(1)).alias("n")).withColumn("zstd", F.lit(all(".zstd." in p for p in paths)))


@query("w14_json_result", "SELECT '7' AS id, 'BIGINT' AS kind FROM orders WHERE o_orderkey = 7")
def w14(spark, d):
    """64-bit integers are text in JSON results."""
    s = loaded(spark, d)
    out = s.to_json(s.sql("SELECT id FROM orders WHERE id = 7"))
    return one(spark, id=out["rows"][0][0], kind=out["columns"][0]["type"])


@query("w15_export", "SELECT 2 AS rows")
def w15(spark, d):
    s = engine(spark).session("ann", security.USER)
    s.sql("CREATE USER TABLE notes (id INT PRIMARY KEY, body TEXT); INSERT INTO notes VALUES (1, 'a'), (2, 'b'); EXPORT USER DATA")
    return s.sql("SHOW EXPORT").select(F.col("rows").cast("int").alias("rows"))


@query("w16_backup_restore", BASE)
def w16(spark, d):
    s = loaded(spark, d)
    path = s.engine.store.uri("saved")
    s.sql(f"BACKUP DATABASE shop TO '{path}'; DROP NAMESPACE shop CASCADE; RESTORE DATABASE shop FROM '{path}'")
    return s.sql(SHOW)


@query("w17_typed_operations", "SELECT o_orderkey AS id, 'typed' AS status FROM orders WHERE o_orderkey < 5 UNION ALL SELECT -1, 'new'")
def w17(spark, d):
    """The same writes as calls, without SQL text for the rows."""
    s = loaded(spark, d)
    s.delete("orders", "id >= 5")
    s.update("orders", {"status": "'typed'"}, "id >= 0")
    s.insert("orders", spark.createDataFrame([(-1,)], "id long"))
    return s.read("orders").select("id", "status")


@query("w18_batched_inserts", "SELECT 3 AS n, 1 AS statements")
def w18(spark, d):
    """Consecutive inserts of a transaction are one statement."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY); BEGIN")
    s.sql("INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); INSERT INTO t VALUES (3)")
    statements = s.tx.order
    s.sql("COMMIT")
    return s.sql("SELECT CAST(count(*) AS INT) AS n FROM t").withColumn("statements", F.lit(statements))


@query("p9_live_predicate", BASE + " WHERE (o_orderstatus ILIKE 'f' OR NOT o_totalprice <= 300000) AND o_orderstatus NOT LIKE 'P%'")
def p9(spark, d):
    """A subscription's predicate is any Spark predicate."""
    s = loaded(spark, d)
    sub = s.subscribe("SELECT id, cust, status, price FROM orders WHERE (status ILIKE 'f' OR NOT price <= 300000) AND status NOT LIKE 'P%'")
    return sub.snapshot().select("id", "cust", "status", "price")


@query("p11_exact_filters", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey = 9 AND o_totalprice > 0")
def p11(spark, d):
    """A key filter goes below version resolution, a value filter stays above it."""
    s = loaded(spark, d)
    s.sql("UPDATE orders SET price = price + 1 WHERE id < 20")
    return s.sql("SELECT id FROM orders WHERE id = 9 AND price > 0")


@query("v2a_fresh_vectors_win", "SELECT '2' AS row_id")
def v2a(spark, d):
    """A changed vector replaces its flushed one in the search."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE v (id INT PRIMARY KEY, e EMBEDDING(2)); INSERT INTO v VALUES (1, '[1,0]'), (2, '[0,1]'); STORAGE FLUSH TABLE v; UPDATE v SET e = '[0,-1]' WHERE id = 1; UPDATE v SET e = '[1,0]' WHERE id = 2")
    return s.sql("SELECT row_id FROM vector_search('default.v', 'e', '[1,0]', 1)")


@query("v3_index_metric", "SELECT '2' AS row_id, CAST(-1.0 AS DOUBLE) AS score")
def v3(spark, d):
    """The index names the metric: squared L2 here."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE v (id INT PRIMARY KEY, e EMBEDDING(2)); ALTER TABLE v CREATE VECTOR INDEX e USING L2; INSERT INTO v VALUES (1, '[5,0]'), (2, '[1,1]')")
    return s.sql("SELECT row_id, CAST(score AS DOUBLE) AS score FROM vector_search('default.v', 'e', '[1,0]', 1)")


@query("v4_flushed_vectors", "SELECT CAST(vec_id AS VARCHAR) AS row_id FROM embeddings WHERE vec_id = 11")
def v4(spark, d):
    """Exact search needs no index files: a flush leaves the results as they are."""
    e = table(spark, d, "embeddings")
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE v (vec_id BIGINT PRIMARY KEY, e EMBEDDING(64))")
    s.insert("v", e.select("vec_id", F.col("embedding").alias("e")))
    s.sql("STORAGE FLUSH TABLE v")
    q = [float(x) for x in e.filter("vec_id = 11").first()["embedding"]]
    return vector.vector_search(s.read("v"), "e", q, 1, pk="vec_id").select("row_id")


def _indexed(spark, d, metric: str):
    s = engine(spark).session()
    s.sql(f"CREATE SHARED TABLE v (vec_id BIGINT PRIMARY KEY, e EMBEDDING(64)); ALTER TABLE v CREATE VECTOR INDEX e USING {metric}")
    s.insert("v", table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e")))
    s.sql("STORAGE FLUSH TABLE v")
    return s


@query("v3_index_recall", "SELECT true AS recalled, true AS fewer_rows")
def v3r(spark, d):
    """Every vector whose id is divisible by 100 is searched for in the index: at least nine tenths of its ten true neighbours (all, of fewer rows) are found, in a part of the rows. All are searched for at once, and compared with all rows of the table at once."""
    s = _indexed(spark, d, "COSINE")
    rows = s.read("v").select("vec_id", "e")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("asked"), F.col("e").alias("q"))
    found = VectorIndex(s.engine.log(s.table_def("v")), "e", "cosine").search_many(asked, 10)
    true = vector.nearest_of_many(rows, asked, "e", "vec_id", 10, "cosine")
    both = true.select("asked", F.col("near.key").alias("true"), F.col("seen").alias("all")).join(found, "asked", "left")
    hits = F.coalesce(F.size(F.array_intersect(F.col("near.key"), "true")), F.lit(0))
    r = both.agg(F.coalesce(F.sum(hits), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.size("true")), F.lit(0)).alias("true"), F.sum("seen").alias("seen"), F.sum("all").alias("all")).first()
    return one(spark, recalled=10 * r["hits"] >= 9 * r["true"], fewer_rows=(r["seen"] or 0) < (r["all"] or 0))


@query("v4_indexed_search", "SELECT CAST(vec_id AS VARCHAR) AS row_id FROM embeddings WHERE vec_id = 11")
def v4i(spark, d):
    """A search through the index in SQL."""
    s = _indexed(spark, d, "L2")
    q = [float(x) for x in s.sql("SELECT e FROM v WHERE vec_id = 11").first()["e"]]
    assert s.engine.log(s.table_def("v")).store.exists("default", "v", "index")
    return s.sql(f"SELECT row_id FROM vector_search('default.v', 'e', '{q}', 1)")


@query("v5_written_after_the_index", "SELECT '11' AS row_id UNION ALL SELECT '-1'")
def v5(spark, d):
    """Vectors written after the flush are found beside the index, changed ones at their new place and deleted ones not at all."""
    s = _indexed(spark, d, "L2")
    q = [float(x) for x in s.sql("SELECT e FROM v WHERE vec_id = 12").first()["e"]]
    s.sql(f"DELETE FROM v WHERE vec_id = 12; UPDATE v SET e = '{q}' WHERE vec_id = 11; INSERT INTO v VALUES (-1, '{q}')")
    found = s.sql(f"SELECT row_id, score FROM vector_search('default.v', 'e', '{q}', 2)")
    return found.filter("score = 0").select("row_id")


@query("m7_transaction_rules", "SELECT true AS ddl, true AS stream, true AS nested")
def m7(spark, d):
    s = engine(spark).session()
    s.sql("CREATE STREAM TABLE st (id INT PRIMARY KEY) WITH (TTL_SECONDS = 60); BEGIN")
    rules = [refused(lambda q=q: s.sql(q), TransactionError) for q in ("CREATE TABLE x (id INT PRIMARY KEY)", "INSERT INTO st VALUES (1)", "BEGIN")]
    return one(spark, ddl=rules[0], stream=rules[1], nested=rules[2])


@query("m8_last_writer_wins", "SELECT 'second' AS status")
def m8(spark, d):
    s = loaded(spark, d)
    t = s.engine.session(namespace="shop")
    s.sql("BEGIN; UPDATE orders SET status = 'second' WHERE id = 1")
    t.sql("UPDATE orders SET status = 'first' WHERE id = 1")
    s.sql("COMMIT")
    return t.sql("SELECT status FROM orders WHERE id = 1")


@query("m9_one_commit", "SELECT 1 AS commits, 2 AS versions")
def m9(spark, d):
    """All versions of a transaction carry one commit."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY); BEGIN; INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); COMMIT")
    log = s.engine.log(s.table_def("t")).log()
    return log.agg(F.count_distinct(V.COMMIT).cast("int").alias("commits"), F.count(F.lit(1)).cast("int").alias("versions"))


@query("l2_live_shapes", "SELECT 6 AS refused")
def l2(spark, d):
    bad = ("SELECT a FROM t ORDER BY a", "SELECT DISTINCT a FROM t", "SELECT a FROM t LIMIT 1", "SELECT a FROM t GROUP BY a", "WITH x AS (SELECT 1) SELECT a FROM x", "SELECT a FROM t, u")
    return one(spark, refused=sum(refused(lambda q=q: live_parts(q), SqlError) for q in bad)).select(F.col("refused").cast("int").alias("refused"))


@query("l5_snapshot_boundary", "SELECT CAST(4194303 AS BIGINT) + CAST(5 AS BIGINT) * 4194304 AS boundary")
def l5(spark, d):
    return one(spark, boundary=live.snapshot_boundary(1_704_067_200_005))


@query("l10_no_repeat", "SELECT 0 AS again, 1 AS later")
def l10(spark, d):
    """What the snapshot has shown does not come as a change."""
    s = loaded(spark, d)
    sub = s.subscribe("SELECT id FROM orders")
    again = sub.poll().count()
    s.sql("INSERT INTO orders (id) VALUES (-1)")
    return one(spark, again=again, later=sub.poll().count()).select(F.col("again").cast("int").alias("again"), F.col("later").cast("int").alias("later"))


@query("l13_kill", "SELECT false AS active, 0 AS live")
def l13(spark, d):
    s = loaded(spark, d)
    sub = s.subscribe("SELECT id FROM orders")
    s.sql(f"KILL LIVE QUERY '{sub.id}'")
    return one(spark, active=sub.active, live=s.sql("SELECT * FROM system.live").count()).select("active", F.col("live").cast("int").alias("live"))


@query("l14_resume", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey DESC LIMIT 3")
def l14(spark, d):
    """A subscription that goes on from a version id it has seen."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id BIGINT PRIMARY KEY)")
    s.insert("t", table(spark, d, "orders").orderBy("o_orderkey").coalesce(1).select(F.col("o_orderkey").alias("id")))
    seen = s.read("t").orderBy(F.desc("id")).offset(3).limit(1).first()[V.SEQ]
    return s.subscribe("SELECT id FROM t", **{"from": seen}).snapshot().select("id")


@query("l17_stream_eviction", "SELECT 2 AS evicted, 0 AS left")
def l17(spark, d):
    s = engine(spark).session()
    s.sql("CREATE STREAM TABLE t (id INT PRIMARY KEY) WITH (TTL_SECONDS = 1); INSERT INTO t VALUES (1), (2)")
    t = s.table_def("t")
    n = jobs.evict_stream(s.engine, t, dml.now_ms() + 10_000_000)
    return one(spark, evicted=n, left=s.engine.log(t).log().count()).select(F.col("evicted").cast("int").alias("evicted"), F.col("left").cast("int").alias("left"))


@query("t1_topic_statements", "SELECT 0 AS after_clear, true AS gone")
def t1(spark, d):
    s = loaded(spark, d)
    s.sql("CREATE TOPIC shop.x PARTITIONS 2; ALTER TOPIC shop.x ADD SOURCE shop.orders ON DELETE; DELETE FROM orders WHERE id < 5; CLEAR TOPIC shop.x")
    left = s.sql("CONSUME FROM shop.x").count()
    s.sql("DROP TOPIC shop.x")
    return one(spark, after_clear=left, gone=refused(lambda: s.sql("CONSUME FROM shop.x"), CatalogError)).select(F.col("after_clear").cast("int").alias("after_clear"), "gone")


def _consumer(spark, d):
    s = loaded(spark, d)
    s.sql("CREATE TOPIC shop.q; ALTER TOPIC shop.q ADD SOURCE shop.orders ON UPDATE; UPDATE orders SET price = 0 WHERE id < 10")
    return s


@query("t6_claims", "SELECT 4 AS first, 4 AS second, 4 AS again")
def t6(spark, d):
    """Claimed messages are hidden for a minute, then handed out again."""
    s = _consumer(spark, d)
    take = lambda at: [r["offset"] for r in s.engine.topics.consume("shop.q", "g", None, 4, None, at)]
    a, b, c = take(1_000), take(2_000), take(1_000_000)
    return one(spark, first=len(a), second=len(set(b) - set(a)), again=len(set(c) & set(a))).select(*(F.col(x).cast("int").alias(x) for x in ("first", "second", "again")))


@query("t7_ack", "SELECT 5 AS next_offset")
def t7(spark, d):
    s = _consumer(spark, d)
    s.sql("ACK shop.q GROUP 'g' PARTITION 0 UPTO OFFSET 4")
    return s.sql("CONSUME FROM shop.q GROUP 'g' FROM 0 LIMIT 1").select(F.col("offset").cast("int").alias("next_offset"))


@query("t9_topic_retention", "SELECT count(*) AS dropped FROM orders WHERE o_orderkey < 10")
def t9(spark, d):
    s = _consumer(spark, d)
    return one(spark, dropped=jobs.retain_topic(s.engine, "shop.q", 0, dml.now_ms() + 1_000_000))


@query("d1_namespaces", "SELECT * FROM (VALUES ('default'), ('shop')) t(name)")
def d1(spark, d):
    return loaded(spark, d).sql("SHOW NAMESPACES").select("name")


@query("d2_create_table", "SELECT * FROM (VALUES ('id', 'BIGINT', false), ('cust', 'BIGINT', true), ('status', 'TEXT', true), ('price', 'DOUBLE', true)) t(column_name, data_type, nullable)")
def d2(spark, d):
    return loaded(spark, d).sql("DESCRIBE TABLE orders").select("column_name", "data_type", "nullable")


@query("d4_table_stats", "SELECT 'shop.orders' AS \"table\", count(*) AS hot_versions FROM orders")
def d4(spark, d):
    return loaded(spark, d).sql("SHOW STATS FOR TABLE orders").select("table", "hot_versions")


@query("d6_storages", "SELECT * FROM (VALUES ('local', 'filesystem'), ('cold', 's3')) t(storage_id, storage_type)")
def d6(spark, d):
    s = engine(spark).session()
    s.sql("CREATE STORAGE cold TYPE 's3' BASE_DIRECTORY 's3a://bucket/x'")
    return s.sql("SHOW STORAGES").select("storage_id", "storage_type")


@query("d13_users", "SELECT * FROM (VALUES ('ann', 'dba', false), ('bob', 'user', true)) t(user_id, role, deleted)")
def d13(spark, d):
    s = engine(spark).session()
    s.sql("CREATE USER 'ann' WITH PASSWORD 'x' ROLE 'user'; CREATE USER 'bob' WITH PASSWORD 'y'; ALTER USER 'ann' SET ROLE 'dba'; DROP USER 'bob'")
    return s.sql("SELECT user_id, role, deleted FROM system.users")


@query("d17_explain", "SELECT true AS has_scan")
def d17(spark, d):
    plan = loaded(spark, d).sql("EXPLAIN SELECT id FROM orders WHERE id = 1")
    return plan.select(F.contains("plan", F.lit("Scan parquet")).alias("has_scan"))


@query("d20_batches", "SELECT count(*) + 1 AS n FROM orders")
def d20(spark, d):
    return loaded(spark, d).sql("INSERT INTO orders (id, status) VALUES (-1, 'a;b'); /* ; */ SELECT count(*) AS n FROM orders")


@query("k1_flush_job", "SELECT 'flush' AS job_type, 'completed' AS status, 'cold' AS tier")
def k1(spark, d):
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH ALL IN shop")
    return s.sql("SELECT job_type, status FROM system.jobs").crossJoin(s.sql("SELECT DISTINCT tier FROM system.manifest"))


@query("k2_flush_policy", "SELECT 'cold' AS tier")
def k2(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY) WITH (FLUSH_POLICY = 'rows:2'); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2)")
    return s.sql("SELECT tier FROM system.manifest")


@query("k4_retention", "SELECT 1 AS kept_young, 0 AS kept_old")
def k4(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY) WITH (DELETED_RETENTION_HOURS = 1); INSERT INTO t VALUES (1); DELETE FROM t WHERE id = 1")
    t = s.table_def("t")
    young, old = jobs.retention(s.engine, t), jobs.retention(s.engine, t, dml.now_ms() + 10**10)
    return one(spark, kept_young=young, kept_old=old).select(F.col("kept_young").cast("int").alias("kept_young"), F.col("kept_old").cast("int").alias("kept_old"))


@query("k7_cleanup", "SELECT false AS files_left")
def k7(spark, d):
    s = loaded(spark, d)
    s.sql("DROP TABLE orders")
    return one(spark, files_left=s.engine.store.exists("shop", "orders"))


@query("k8_housekeeping", "SELECT 1 AS users, 1 AS jobs")
def k8(spark, d):
    s = engine(spark).session()
    s.sql("CREATE USER 'ann'; DROP USER 'ann'; CREATE SHARED TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1); STORAGE FLUSH TABLE t")
    late = dml.now_ms() + 10**9
    return one(spark, users=jobs.clean_users(s.engine, 1000, late), jobs=jobs.clean_jobs(s.engine, 1000, late)).select(F.col("users").cast("int").alias("users"), F.col("jobs").cast("int").alias("jobs"))


@query("x1_masking", "SELECT true AS hidden, true AS shown")
def x1(spark, d):
    from .. import views

    s = engine(spark).session()
    s.sql("CREATE USER 'ann' WITH PASSWORD 'x'")
    plain = views.read(s.engine.session("u", security.SERVICE), "users").first()["password_hash"]
    return one(spark, hidden=plain == "***", shown=s.sql("SELECT * FROM system.users").first()["password_hash"] != "***")


@query("x2_shared_downgrade", "SELECT 'USER' AS kind")
def x2(spark, d):
    s = engine(spark).session("ann", security.USER)
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY)")
    return one(spark, kind=s.table_def("t").kind)


@query("x4_slow_log", "SELECT true AS logged")
def x4(spark, d):
    s = engine(spark).session()
    s.engine.settings.slow_query_seconds = 0.0
    s.sql("SELECT 1 AS one")
    return one(spark, logged=len(s.engine.slow) > 0)


@query("x5_committed_offset_first", "SELECT 3 AS next_offset")
def x5(spark, d):
    """A group's acknowledged offset has priority over the position asked for."""
    s = _consumer(spark, d)
    s.sql("ACK shop.q GROUP 'g' UPTO OFFSET 2")
    return s.sql("CONSUME FROM shop.q GROUP 'g' FROM EARLIEST LIMIT 1").select(F.col("offset").cast("int").alias("next_offset"))


@query("x7_write_by_key", BASE + " WHERE o_orderkey <> 6 AND o_orderkey <> 5 UNION ALL SELECT o_orderkey, o_custkey, 'k', o_totalprice FROM orders WHERE o_orderkey = 5")
def x7(spark, d):
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders")
    s.sql("UPDATE orders SET status = $1 WHERE id = $2", ["k", 5])
    s.sql("DELETE FROM orders WHERE id = $1", [6])
    return s.sql(SHOW)


@query("m2_snapshot_after_flush", BASE)
def m2f(spark, d):
    """An open transaction sees its snapshot, whatever is written, flushed and compacted meanwhile."""
    s = loaded(spark, d)
    t = s.engine.session(namespace="shop")
    s.sql("BEGIN")
    t.sql("UPDATE orders SET status = 'new', price = 0 WHERE id % 3 = 0; DELETE FROM orders WHERE id % 7 = 0; STORAGE FLUSH TABLE orders; UPDATE orders SET status = 'x' WHERE id % 2 = 0; STORAGE FLUSH TABLE orders; STORAGE COMPACT TABLE orders")
    return s.sql(SHOW)


@query("l8_update_after_flush", "SELECT 'update' AS op, o_orderkey AS id, o_totalprice AS old_price FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'delete', o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 1")
def l8f(spark, d):
    """A subscription gets updates as updates, with their old values, also after a flush and a compaction."""
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders")
    sub = s.subscribe("SELECT id, price FROM orders")
    s.sql("UPDATE orders SET price = price + 1 WHERE id % 5 = 0; DELETE FROM orders WHERE id % 5 = 1; STORAGE FLUSH TABLE orders; STORAGE COMPACT TABLE orders")
    return sub.poll().select("op", "id", F.col("old.price").alias("old_price"))


@query("l1_out_of_order_commits", "SELECT 1 AS poll, 'update' AS op, o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 2, 'insert', -1 - o_orderkey FROM orders")
def l1o(spark, d):
    """A commit that was begun first and published last comes with the later poll."""
    s = loaded(spark, d)
    t = s.table_def("orders")
    sub, log, commit = s.subscribe("SELECT id FROM orders"), s.engine.log(t), s.engine.next_commit()
    slow = log.write_segments(dml.versioned(dml.prepared(s.read("orders").select((-1 - F.col("id")).alias("id")), t, "root"), t, commit, None), "hot")
    s.sql("UPDATE orders SET price = 0 WHERE id % 4 = 0")
    first = sub.poll()
    log.add(slow, commit)
    return first.select(F.lit(1).alias("poll"), "op", "id").unionByName(sub.poll().select(F.lit(2).alias("poll"), "op", "id"))


@query("k3_readers_during_compaction", BASE)
def k3r(spark, d):
    """A DataFrame that was planned before a flush and a compaction still reads its files."""
    s = loaded(spark, d)
    before = s.sql(SHOW)
    s.sql("STORAGE FLUSH TABLE orders; DELETE FROM orders WHERE id % 2 = 1; STORAGE COMPACT TABLE orders")
    return before


@query("w7_decimal_keys", "SELECT true AS refused, count(*) AS n FROM orders")
def w7d(spark, d):
    """Decimal keys compare as numbers: a key that is there is refused, one between is not."""
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id DECIMAL(12,2) PRIMARY KEY)")
    keys = table(spark, d, "orders").select(F.col("o_orderkey").cast("decimal(12,2)").alias("id"))
    s.insert("t", keys.filter("id < 5 OR id >= 10"))
    s.insert("t", keys.filter("id >= 5 AND id < 10"))
    no = [refused(lambda k=k: s.sql(f"INSERT INTO t VALUES ({k})"), dml.ConstraintError) for k in (1, 5, 9, 10, 100)]
    return s.sql("SELECT count(*) AS n FROM t").select(F.lit(all(no)).alias("refused"), "n")


@query("m9_tables_together", "SELECT 0 AS before, 2 * count(*) AS after FROM orders")
def m9t(spark, d):
    """The tables of a transaction show together, when its record is written: not yet when all their segments are listed."""
    s = loaded(spark, d)
    s.sql("CREATE SHARED TABLE copy (id BIGINT PRIMARY KEY)")
    logs = [s.engine.log(s.table_def(n)) for n in ("orders", "copy")]
    ids, commit = s.read("orders").select((-1 - F.col("id")).alias("id")), s.engine.next_commit()
    for log in logs:
        rows = dml.versioned(dml.prepared(ids, log.table, "root"), log.table, commit, None)
        log.add(log.write_segments(rows, "hot"), commit, tx="both")
    seen = lambda: s.sql("SELECT id FROM orders WHERE id < 0 UNION ALL SELECT id FROM copy WHERE id < 0").count()
    before = seen()
    decide(s.engine.store, "both")
    return one(spark, before=before, after=seen()).select(F.col("before").cast("int").alias("before"), "after")


@query("t2_publish_once", "SELECT count(*) AS n, count(*) - 1 AS last_offset FROM orders WHERE o_orderkey % 3 = 0")
def t2o(spark, d):
    """A commit whose writer stopped before it published is published by the next call, once."""
    s = loaded(spark, d)
    s.sql("CREATE TOPIC shop.c; ALTER TOPIC shop.c ADD SOURCE shop.orders ON UPDATE")
    t, publish = s.table_def("orders"), s.publish
    s.publish = lambda table: 0  # the writer stops here
    s.sql("UPDATE orders SET price = 1 WHERE id % 3 = 0")
    s.publish = publish
    publish(t)
    publish(t)
    return s.engine.topics.messages("shop.c").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_offset"))


@query("s5_point_lookup_sql", "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def s5s(spark, d):
    """A point read through SQL, over 20 flushed segments, opens one of them."""
    s = engine(spark).session()
    s.sql("CREATE NAMESPACE shop; USE shop; CREATE SHARED TABLE orders (id BIGINT PRIMARY KEY, cust BIGINT, status TEXT, price DOUBLE)")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    step = (high - low) // 20 + 1
    s.insert("orders", rows)
    log = s.engine.log(s.table_def("orders"))
    hot = log.visible()
    parts = [log.write_segments(log.read(hot).drop(V.TIER).filter((F.col("id") >= low + k * step) & (F.col("id") < low + (k + 1) * step)), "cold") for k in range(20)]
    log.replace(hot, [x for p in parts for x in p])
    found = s.sql("SELECT id, cust, status, price FROM orders WHERE id = $1", [high])
    assert len(log.visible()) >= 20 and len(found.inputFiles()) == 1
    return found


@query("a12_manifest_count", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0")
def a12m(spark, d):
    """A count of merged rows that reads no row: after a compaction the manifest says it; what is written later is resolved."""
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders; DELETE FROM orders WHERE id % 2 = 1; STORAGE COMPACT TABLE orders")
    counted = s.sql("SELECT count(*) AS n FROM orders")
    assert not counted.inputFiles()
    return counted


@query("t8_partition_choice", "SELECT true AS own, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0")
def t8(spark, d):
    """Messages of one partition at a time: its own offsets without gaps, and together all messages. They are counted where they lie; the driver takes the first and the last page of each partition, for their order."""
    s = loaded(spark, d)
    s.sql("CREATE TOPIC shop.p PARTITIONS 3; ALTER TOPIC shop.p ADD SOURCE shop.orders ON UPDATE; UPDATE orders SET price = 0 WHERE id % 3 = 0")
    topics, asked = s.engine.topics, None
    for p in range(3):
        rows = topics.reading("shop.p", partition=p).select(F.lit(p).alias("asked"), "partition_id", "offset")
        asked = rows if asked is None else asked.unionByName(rows)
    # n different offsets from 0 to n - 1 are all of them
    gapless = (F.min("offset") == 0) & (F.max("offset") == F.count(F.lit(1)) - 1) & (F.count_distinct("offset") == F.count(F.lit(1)))
    found = asked.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), (gapless & F.every(F.col("partition_id").eqNullSafe(F.col("asked")))).alias("own")).collect()
    own, sizes = all(r["own"] for r in found), {r["asked"]: r["n"] for r in found}
    for p in range(3):
        n = sizes.get(p, 0)
        for first in {0, max(0, n - PAGE)}:
            page = topics.consume("shop.p", None, first, PAGE, p)
            own = own and [(r["partition_id"], r["offset"]) for r in page] == [(p, i) for i in range(first, min(n, first + PAGE))]
    return one(spark, own=own, n=sum(sizes.values()))


@query("x8_real_stats", "SELECT count(*) AS cold FROM orders")
def x8(spark, d):
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders")
    return s.sql("SHOW STATS FOR TABLE orders").select(F.col("cold_versions").alias("cold"))


@query("rls_all_users", "SELECT * FROM (VALUES ('ann', 'a'), ('bob', 'b')) t(user_id, body)")
def rls(spark, d):
    e = engine(spark)
    e.session().sql("CREATE USER TABLE notes (id INT PRIMARY KEY, body TEXT)")
    e.session("ann", security.USER).sql("INSERT INTO notes VALUES (1, 'a')")
    e.session("bob", security.USER).sql("INSERT INTO notes VALUES (1, 'b')")
    assert e.session("ann", security.USER).sql("SELECT * FROM notes").count() == 1
    return e.session("svc", security.SERVICE).sql("SELECT _user_id AS user_id, body FROM notes")


@query("access_levels", "SELECT true AS private_refused, 3 AS public_rows")
def access(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1), (2), (3)")
    u = s.engine.session("u", security.USER)
    no = refused(lambda: u.sql("SELECT * FROM t"), security.AccessDenied)
    s.sql("ALTER TABLE t SET ACCESS LEVEL public")
    return one(spark, private_refused=no, public_rows=u.sql("SELECT * FROM t").count()).select("private_refused", F.col("public_rows").cast("int").alias("public_rows"))


@query("d9_show_manifest", "SELECT 'shop.orders' AS \"table\", count(*) AS rows FROM orders")
def d9(spark, d):
    return loaded(spark, d).sql("SHOW MANIFEST").select("table", "rows")


@query("d10_kill_job", "SELECT true AS unknown_refused, 'completed' AS status")
def d10(spark, d):
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders")
    job = s.sql("SELECT job_id FROM system.jobs").first()["job_id"]
    s.sql(f"KILL JOB '{job}'")
    no = refused(lambda: s.sql("KILL JOB 'nothing'"), CatalogError)
    return s.sql("SELECT status FROM system.jobs").withColumn("unknown_refused", F.lit(no))


@query("d16_transaction_statements", "SELECT true AS commit_refused, true AS rollback_refused")
def d16(spark, d):
    s = engine(spark).session()
    return one(spark, commit_refused=refused(lambda: s.sql("COMMIT"), TransactionError), rollback_refused=refused(lambda: s.sql("ROLLBACK"), TransactionError))


@query("d18_cluster", "SELECT true AS listed, true AS managed")
def d18(spark, d):
    s = engine(spark).session()
    return one(spark, listed=s.sql("CLUSTER LIST").count() >= 1, managed="Spark" in s.sql("CLUSTER SNAPSHOT").first()["message"])


@query("p2_select_all_with_versions", "SELECT 'id,cust,status,price,_seq,_deleted' AS columns")
def p2s(spark, d):
    return one(spark, columns=",".join(loaded(spark, d).sql("SELECT * FROM orders").columns))
