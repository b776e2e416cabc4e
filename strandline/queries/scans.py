"""Scans of versioned tables (S1 to S11), version resolution (M1 to M5, A11, A12, N4) and the log they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import versions as V
from ..streaming import stream_tables
from . import query, table


def order_log(spark: SparkSession, d: str) -> DataFrame:
    """A change log of orders: all rows at commit 1, every tenth doubled at 2, every 37th deleted at 3."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias(V.USER), "o_orderstatus", "o_totalprice")
    version = lambda df, commit, step, gone: df.withColumn(V.COMMIT, F.lit(commit).cast("long")).withColumn(V.SEQ, F.col("o_orderkey") + step).withColumn(V.DELETED, F.lit(gone))
    base = version(o, 1, 0, False).withColumn(V.TIER, F.lit(1))
    hot = version(o.filter("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), 2, 1_000_000, False)
    gone = version(o.filter("o_orderkey % 37 = 0"), 3, 2_000_000, True)
    return base.unionByName(hot.unionByName(gone).withColumn(V.TIER, F.lit(0)))


LOG = """WITH log AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) u, o_orderstatus, o_totalprice, 1 c, o_orderkey s, false del FROM orders
  UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), o_orderstatus, o_totalprice * 2, 2, o_orderkey + 1000000, false FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey, CAST(o_custkey AS VARCHAR), o_orderstatus, o_totalprice, 3, o_orderkey + 2000000, true FROM orders WHERE o_orderkey % 37 = 0),
cur AS (SELECT * FROM log {snap} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY c DESC, s DESC) = 1)
"""
NOW = LOG.format(snap="")
SHOWN = ["o_orderkey", "o_orderstatus", "o_totalprice"]
COLS = "o_orderkey, o_orderstatus, o_totalprice"


@query("s1_versioned_scan", NOW + f"SELECT {COLS} FROM cur WHERE NOT del")
def s1(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey").select(SHOWN)


@query("s2_user_scan", NOW + f"SELECT {COLS} FROM cur WHERE NOT del AND u = '7'")
def s2(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey", by_user=True).filter(F.col(V.USER) == "7").select(SHOWN)


@query("s3_all_users_scan", NOW + f"SELECT u AS user_id, {COLS} FROM cur WHERE NOT del")
def s3(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey", by_user=True).select(F.col(V.USER).alias("user_id"), *SHOWN)


def event_log(spark, d):
    """Events as a stream table's log: the version id holds the event's millisecond."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").withColumn(V.SEQ, F.shiftleft(ms - ids.SEQ_EPOCH_MS, 22) + F.col("event_id") % 4096)


AT = 1_705_000_000_000


@query("s4_stream_scan", f"SELECT event_id, event_type FROM events WHERE (epoch_us(ts) // 1000) + 86400000 * 5 > {AT} AND (epoch_us(ts) // 1000) <= {AT}")
def s4(spark, d):
    log = event_log(spark, d).filter(ids.seq_ms(F.col(V.SEQ)) <= AT)
    return stream_tables.scan(log, 5 * 86_400, AT).select("event_id", "event_type")


@query("s5_point_lookup", NOW + f"SELECT {COLS} FROM cur WHERE NOT del AND o_orderkey = 420")
def s5(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey").filter("o_orderkey = 420").select(SHOWN)


@query("s6_count_scan", NOW + "SELECT count(*) AS n FROM cur WHERE NOT del")
def s6(spark, d):
    return V.count_current(order_log(spark, d), "o_orderkey")


@query("s7_seq_range", NOW + f"SELECT {COLS}, s AS seq FROM cur WHERE NOT del AND s > 100 AND s <= 1000500")
def s7(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey").filter("_seq > 100 AND _seq <= 1000500").select(*SHOWN, F.col(V.SEQ).alias("seq"))


@query("s8_deleted_rows", NOW + "SELECT o_orderkey, del AS deleted FROM cur WHERE del")
def s8(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey", include_deleted=True).filter(V.DELETED).select("o_orderkey", F.col(V.DELETED).alias("deleted"))


@query("s9_parquet_projection", "SELECT p_partkey, p_brand FROM part WHERE p_size > 40")
def s9(spark, d):
    return table(spark, d, "part").filter("p_size > 40").select("p_partkey", "p_brand")


@query("s11_schema_evolution", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS customer, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def s11(spark, d):
    """Even keys are in an older schema: another name and a narrower type for the customer, no priority."""
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").cast("int").alias("cust"))
    new = o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    return old.select("o_orderkey", F.col("cust").cast("bigint").alias("customer")).unionByName(new, allowMissingColumns=True)


@query("s15_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(n, s)")
def s15(spark, d):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(n, s)")


@query("s20_subquery_source", "SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE n > 10")
def s20(spark, d):
    return spark.sql("SELECT status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY o_orderstatus) t WHERE n > 10", orders=table(spark, d, "orders"))


@query("m1_version_order", NOW + "SELECT o_orderkey, CAST(c AS BIGINT) AS commit_seq, s AS seq FROM cur")
def m1(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey", include_deleted=True).select("o_orderkey", F.col(V.COMMIT).alias("commit_seq"), F.col(V.SEQ).alias("seq"))


@query("m2_snapshot_read", LOG.format(snap="WHERE c <= 2") + f"SELECT {COLS} FROM cur WHERE NOT del")
def m2(spark, d):
    return V.resolve(order_log(spark, d), "o_orderkey", snapshot=2).select(SHOWN)


@query("m3_null_keys", "SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS k, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 5 = 0 THEN '_seq:' || o_orderkey ELSE CAST(o_orderkey % 100 AS VARCHAR) END ORDER BY o_orderkey DESC) = 1")
def m3(spark, d):
    """Rows with an empty key are version chains of their own."""
    key = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise((F.col("o_orderkey") % 100).cast("string"))
    log = table(spark, d, "orders").select(key.alias("k"), F.col("o_orderkey").alias(V.SEQ))
    return V.resolve(log, "k").select("k", F.col(V.SEQ).alias("seq"))


@query("m4_missing_commit", "SELECT o_orderkey % 50 AS k, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def m4(spark, d):
    """Rows without a commit count as commit 0, without a tombstone mark as live."""
    log = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("k"), F.col("o_orderkey").alias(V.SEQ))
    return V.resolve(log, "k").select("k", F.col(V.SEQ).alias("seq"))


OVERLAY = """WITH base AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice
FROM base WHERE o_orderkey % 7 <> 0 OR o_orderkey % 6 = 0 AND false
UNION ALL SELECT -1 - o_orderkey, 'N', 5.0 FROM base WHERE o_orderkey < 20"""


@query("m5_transaction_overlay", OVERLAY)
def m5(spark, d):
    """Staged: every sixth row's status set, every twelfth's price set after that, every seventh deleted at the end, 20 new rows."""
    base = table(spark, d, "orders").select(*SHOWN)
    none = F.lit(None).cast("double")
    op = lambda df, name, order, names: df.withColumn("_op", F.lit(name)).withColumn("_order", F.lit(order)).withColumn("_set", F.array(*(F.lit(n) for n in names)).cast("array<string>"))
    status = op(base.filter("o_orderkey % 6 = 0").withColumn("o_orderstatus", F.lit("U")).withColumn("o_totalprice", none), "update", 1, ["o_orderstatus"])
    price = op(base.filter("o_orderkey % 12 = 0").withColumn("o_totalprice", F.lit(-1.0)), "update", 2, ["o_totalprice"])
    gone = op(base.filter("o_orderkey % 7 = 0"), "delete", 3, [])
    new = op(base.filter("o_orderkey < 20").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(5.0).alias("o_totalprice")), "insert", 4, SHOWN)
    staged = status.unionByName(price).unionByName(gone).unionByName(new)
    return V.overlay(base, staged, "o_orderkey", SHOWN)


@query("a11_latest_by_aggregate", NOW + f"SELECT {COLS} FROM cur WHERE NOT del")
def a11(spark, d):
    return V.resolve_by_aggregate(order_log(spark, d), "o_orderkey").select(SHOWN)


@query("a12_metadata_count", LOG.format(snap="WHERE c <= 2") + "SELECT count(*) AS n FROM cur WHERE NOT del")
def a12(spark, d):
    return V.count_current(order_log(spark, d), "o_orderkey", snapshot=2)


@query("n4_version_rank", NOW.replace("cur AS", "ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY c DESC, s DESC) r FROM log), cur AS") + "SELECT r AS version_rank, count(*) AS n FROM ranked GROUP BY r")
def n4(spark, d):
    newest = Window.partitionBy("o_orderkey").orderBy(F.col(V.COMMIT).desc(), F.col(V.SEQ).desc())
    return order_log(spark, d).withColumn("version_rank", F.row_number().over(newest).cast("bigint")).groupBy("version_rank").agg(F.count(F.lit(1)).alias("n"))
