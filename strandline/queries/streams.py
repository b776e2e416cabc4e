"""Live queries, stream tables, topics and event-time windows as batch queries over the events (L, T, S4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as V
from ..streaming import live, stream_tables, topics, windows
from . import query, table, total
from .scans import LOG, NOW, event_log, order_log

LIVE = NOW + "SELECT o_orderkey, o_totalprice, s AS seq FROM cur WHERE NOT del AND "


@query("l3_initial_snapshot", LIVE + "o_orderstatus = 'F' AND s > 50 AND s <= 1000400 ORDER BY s LIMIT 101")
def l3(spark, d):
    cur = V.resolve(order_log(spark, d), "o_orderkey")
    return live.initial_rows(cur, ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "F", 50, 1_000_400).withColumnRenamed(V.SEQ, "seq")


@query("l4_last_rows", LIVE + "o_orderstatus = 'O' ORDER BY s DESC LIMIT 20")
def l4(spark, d):
    cur = V.resolve(order_log(spark, d), "o_orderkey")
    return live.last_rows(cur, ["o_orderkey", "o_totalprice"], 20, F.col("o_orderstatus") == "O").withColumnRenamed(V.SEQ, "seq")


@query("l6_second_page", LIVE + "s > (SELECT s FROM cur WHERE NOT del ORDER BY s LIMIT 1 OFFSET 49) ORDER BY s LIMIT 51")
def l6(spark, d):
    cur = V.resolve(order_log(spark, d), "o_orderkey")
    last = live.initial_rows(cur, ["o_orderkey"], limit=49).agg(F.max(V.SEQ)).first()[0]
    return live.initial_rows(cur, ["o_orderkey", "o_totalprice"], since=last, limit=50).withColumnRenamed(V.SEQ, "seq")


CHANGES = """, fed AS (SELECT *, lag(del) OVER w AS odel, lag(o_totalprice) OVER w AS oprice FROM log WINDOW w AS (PARTITION BY o_orderkey ORDER BY c, s)),
ops AS (SELECT *, CASE WHEN del THEN CASE WHEN odel = false THEN 'delete' END WHEN odel = false THEN 'update' ELSE 'insert' END AS op FROM fed)
"""


@query("l8_change_payload", LOG.format(snap="").rstrip() + CHANGES + "SELECT op, o_orderkey, o_totalprice, CASE WHEN op = 'update' AND o_totalprice <> oprice THEN 'o_totalprice' ELSE '' END AS changed, oprice AS old_price FROM ops WHERE op IS NOT NULL")
def l8(spark, d):
    feed = V.changes(order_log(spark, d), "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return feed.select("op", "o_orderkey", "o_totalprice", F.array_join("changed", ",").alias("changed"), F.col("old.o_totalprice").alias("old_price"))


@query("l7_filtered_changes", LOG.format(snap="").rstrip() + CHANGES + "SELECT CASE WHEN op = 'delete' THEN 'delete' WHEN o_totalprice > 300000 AND coalesce(oprice > 300000, false) THEN 'update' WHEN o_totalprice > 300000 THEN 'insert' ELSE 'delete' END AS op, o_orderkey FROM ops WHERE op IS NOT NULL AND CASE WHEN op = 'delete' THEN oprice > 300000 ELSE o_totalprice > 300000 OR coalesce(oprice > 300000, false) END")
def l7(spark, d):
    feed = V.changes(order_log(spark, d), "o_orderkey", ["o_orderkey", "o_totalprice"])
    return live.filtered_changes(feed, F.col("o_totalprice") > 300000, ["o_orderkey", "o_totalprice"]).select("op", "o_orderkey")


@query("l15_stream_buckets", "SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS bucket_ms, count(*) AS n FROM events GROUP BY 1")
def l15(spark, d):
    """A stream that lives for a week is kept by days."""
    log = event_log(spark, d)
    return log.groupBy(stream_tables.bucket_start(F.col(V.SEQ), 7 * 86_400).alias("bucket_ms")).agg(F.count(F.lit(1)).alias("n"))


@query("l16_time_range", "SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) >= 1704500000000 AND (epoch_us(ts) // 1000) < 1705000000000")
def l16(spark, d):
    return stream_tables.time_range(event_log(spark, d), 1_704_500_000_000, 1_705_000_000_000).select("event_id")


def messages(spark, d):
    e = event_log(spark, d)
    key = (F.col("user_id") % 50).cast("string")
    return topics.routed(e, "events", 1, key, topics.payload("full", "event_id", ["event_id", "event_type"]), F.lit("insert"), F.col("user_id").cast("string"), [F.col("event_id")], {0: 5}, 7)


MESSAGES = """SELECT 'events' AS topic_id, 0 AS partition_id, row_number() OVER (ORDER BY event_id) + 4 AS "offset", CAST(user_id % 50 AS VARCHAR) AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload, CAST(7 AS BIGINT) AS timestamp_ms, CAST(user_id AS VARCHAR) AS user_id, 'insert' AS op FROM events"""


@query("t4_topic_messages", MESSAGES)
def t4(spark, d):
    return messages(spark, d).withColumn("payload", F.col("payload").cast("string"))


@query("t5_consume", f'SELECT "offset", key FROM ({MESSAGES}) m WHERE "offset" >= 100 ORDER BY "offset" LIMIT 50')
def t5(spark, d):
    return topics.consume(messages(spark, d), 100, 50).select("offset", "key")


@query("t3_partition_offsets", "SELECT true AS gapless, count(*) AS n FROM events")
def t3(spark, d):
    """Over four partitions by key, each partition's offsets are 0, 1, 2, ..."""
    e = event_log(spark, d)
    m = topics.routed(e, "events", 4, F.col("user_id").cast("string"), topics.payload("key", "event_id", ["event_id"]), F.lit("insert"), F.lit("x"), [F.col("event_id")])
    per = m.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("k"), F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    return per.agg(F.every((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("k") == F.col("n"))).alias("gapless"), F.sum("n").alias("n"))


@query("x_tumbling_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY ALL")
def x_tumbling(spark, d):
    w = windows.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), total("value").alias("s"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "s")


@query("x_sliding_windows", "SELECT strftime(w, '%Y-%m-%d %H') AS start, count(*) AS n FROM events, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) t(w) GROUP BY 1")
def x_sliding(spark, d):
    w = windows.sliding(table(spark, d, "events"), "ts", "12 hours", "6 hours", [], F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("start"), "n")


@query("x_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) t GROUP BY user_id, n")
def x_sessions(spark, d):
    w = windows.sessions(table(spark, d, "events"), "ts", "12 hours", ["user_id"], F.count(F.lit(1)).alias("n"))
    return w.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))
