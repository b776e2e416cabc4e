"""The dialect end to end: an engine in the shared folder takes statements, and the tables are read back (W, D, M, L, T, K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..engine import Engine
from . import query, table


def engine(spark) -> Engine:
    """An engine in a folder of its own below the folder that all executors share."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/strandline-checkpoints").rstrip("/")
    root = f"{base}/engine-{uuid.uuid4().hex}"
    out = Engine(spark, root)
    out.store.delete_on_exit()
    return out


def loaded(spark, d, kind: str = "SHARED"):
    """A session with the table shop.orders, loaded from the test table."""
    s = engine(spark).session()
    s.sql(f"CREATE NAMESPACE shop; USE shop; CREATE {kind} TABLE orders (id BIGINT PRIMARY KEY, cust BIGINT, status TEXT DEFAULT 'new', price DOUBLE)")
    s.insert("orders", table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    return s


SHOW = "SELECT id, cust, status, price FROM shop.orders"
BASE = "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders"


@query("w1_insert", BASE + " UNION ALL SELECT -1, 5, 'new', NULL UNION ALL SELECT -2, 6, 'x', 1.5")
def w1(spark, d):
    s = loaded(spark, d)
    s.sql("INSERT INTO orders (id, cust) VALUES (-1, 5); INSERT INTO orders VALUES (-2, 6, 'x', 1.5)")
    return s.sql(SHOW)


@query("w2_insert_returning", "SELECT 3 AS n, true AS rising")
def w2(spark, d):
    s = loaded(spark, d)
    return s.sql("INSERT INTO orders (id) VALUES (-1), (-2), (-3) RETURNING _seq").agg(F.count_distinct("_seq").cast("int").alias("n"), (F.min("_seq") > 0).alias("rising"))


@query("w3_update", "SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) || '!' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + o_custkey ELSE o_totalprice END AS price FROM orders")
def w3(spark, d):
    s = loaded(spark, d)
    s.sql("UPDATE orders SET status = lower(status) || '!', price = price + cust WHERE id % 3 = 0")
    return s.sql(SHOW)


@query("w4_delete", BASE + " WHERE NOT (o_custkey > 20 AND o_orderstatus = 'F')")
def w4(spark, d):
    s = loaded(spark, d)
    s.sql("DELETE FROM orders WHERE cust > 20 AND status = 'F'")
    return s.sql(SHOW)


@query("w9_type_coercion", "SELECT 1 AS id, '550e8400-e29b-41d4-a716-446655440000' AS u, CAST(3.5 AS DOUBLE) AS x, CAST(45296000000 AS BIGINT) AS t, 3 AS n")
def w9(spark, d):
    s = engine(spark).session()
    s.sql("CREATE SHARED TABLE c (id INT PRIMARY KEY, u UUID, x DOUBLE, t TIME, e EMBEDDING(3))")
    s.sql("INSERT INTO c VALUES ('1', '{550E8400E29B41D4A716446655440000}', '3.5', '12:34:56', '[1, 2, 3]')")
    return s.sql("SELECT id, u, x, t, size(e) AS n FROM c")


@query("w12_flush_and_read", BASE + " WHERE o_orderkey % 5 <> 0 AND o_orderkey >= 10 UNION ALL SELECT o_orderkey, o_custkey, 'late', o_totalprice FROM orders WHERE o_orderkey < 10 AND o_orderkey % 5 <> 0")
def w12(spark, d):
    """Deletes before the flush and updates after it: cold and hot versions together."""
    s = loaded(spark, d)
    s.sql("DELETE FROM orders WHERE id % 5 = 0; STORAGE FLUSH TABLE orders; UPDATE orders SET status = 'late' WHERE id < 10")
    return s.sql(SHOW)


@query("w13_manifest", "SELECT 'hot' AS tier, count(*) AS rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def w13(spark, d):
    return loaded(spark, d).sql("SELECT tier, rows, CAST(min_key AS BIGINT) AS lo, CAST(max_key AS BIGINT) AS hi FROM system.manifest")


@query("m6_transaction", BASE + " WHERE o_orderkey >= 100 AND o_orderkey <> 200 UNION ALL SELECT o_orderkey, o_custkey, 'T', o_totalprice FROM orders WHERE o_orderkey < 100 UNION ALL SELECT -5, 1, 'T2', 2.0")
def m6(spark, d):
    s = loaded(spark, d)
    s.sql("BEGIN; UPDATE orders SET status = 'T' WHERE id < 100; INSERT INTO orders VALUES (-5, 1, 'ins', 2.0); UPDATE orders SET status = 'T2' WHERE id = -5; DELETE FROM orders WHERE id = 200; COMMIT")
    return s.sql(SHOW)


@query("m6_rollback", BASE)
def m6r(spark, d):
    s = loaded(spark, d)
    s.sql("BEGIN; DELETE FROM orders WHERE id > 0; ROLLBACK")
    return s.sql(SHOW)


@query("k3_compact", BASE + " WHERE o_orderkey % 2 = 0")
def k3(spark, d):
    s = loaded(spark, d)
    s.sql("STORAGE FLUSH TABLE orders; DELETE FROM orders WHERE id % 2 = 1; STORAGE COMPACT TABLE orders")
    return s.sql(SHOW)


@query("d3_alter_table", "SELECT o_orderkey AS id, o_orderstatus AS state, CAST(NULL AS VARCHAR) AS note FROM orders UNION ALL SELECT -1, 'n', 'hi'")
def d3(spark, d):
    s = loaded(spark, d)
    s.sql("ALTER TABLE orders RENAME COLUMN status TO state; ALTER TABLE orders ADD COLUMN note TEXT; ALTER TABLE orders DROP COLUMN cust; INSERT INTO orders (id, state, note) VALUES (-1, 'n', 'hi')")
    return s.sql("SELECT id, state, note FROM orders")


@query("u7_view", "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 3")
def u7(spark, d):
    s = loaded(spark, d)
    s.sql("CREATE VIEW finished (c, n) AS SELECT cust, count(*) FROM orders WHERE status = 'F' GROUP BY cust")
    return s.sql("SELECT c, n FROM finished WHERE n > 3")


@query("s14_information_schema", "SELECT * FROM (VALUES ('id', 1), ('cust', 2), ('status', 3), ('price', 4)) t(column_name, ordinal_position)")
def s14(spark, d):
    return loaded(spark, d).sql("SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'orders'")


@query("d19_execute_as", "SELECT 'mine' AS body")
def d19(spark, d):
    s = engine(spark).session()
    s.sql("CREATE USER TABLE notes (id INT PRIMARY KEY, body TEXT)")
    s.sql("EXECUTE AS USER 'ann' (INSERT INTO notes VALUES (1, 'mine')); EXECUTE AS USER 'bob' (INSERT INTO notes VALUES (1, 'his'))")
    return s.sql("EXECUTE AS USER 'ann' (SELECT body FROM notes)")


@query("l1_subscribe", "SELECT 'update' AS op, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 3 UNION ALL SELECT 'insert', -1 UNION ALL SELECT 'delete', min(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 4")
def l1(spark, d):
    """Changes after a subscription to the finished orders."""
    s = loaded(spark, d)
    sub = s.subscribe("SELECT id, price FROM orders WHERE status = 'F'")
    s.sql("UPDATE orders SET price = price + 1 WHERE cust = 3; INSERT INTO orders VALUES (-1, 3, 'F', 1.0); INSERT INTO orders VALUES (-2, 3, 'O', 1.0)")
    s.sql("DELETE FROM orders WHERE id = (SELECT min(id) FROM orders WHERE status = 'F' AND cust = 4)")
    return sub.poll().select("op", "id")


@query("t2_topic_source", "SELECT 'update' AS op, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey < 40 AND o_totalprice > 200000")
def t2(spark, d):
    s = loaded(spark, d)
    s.sql("CREATE TOPIC shop.moves PARTITIONS 2; ALTER TOPIC shop.moves ADD SOURCE shop.orders ON UPDATE WHERE price > 200000 WITH (payload = 'diff'); UPDATE orders SET status = 'z' WHERE id < 40")
    return s.sql("CONSUME FROM shop.moves LIMIT 1000").select("op", "key")
