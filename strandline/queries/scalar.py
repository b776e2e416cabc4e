"""Scalar functions: ids, JSON, strings, dates, numbers, arrays (F, FJ, FS, FD, FM, FA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import json as J
from . import query, table


def _doc():
    """A JSON document made from an event's columns, by string concatenation as in the SQL."""
    return F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","n":'), (F.col("event_id") % 7).cast("string"), F.lit(',"ok":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(',"items":['), (F.col("user_id")).cast("string"), F.lit(',2,3],"deep":{"k":"v'), (F.col("event_id") % 5).cast("string"), F.lit('"},"none":null}'))


DOC = """'{"type":"' || event_type || '","n":' || (event_id % 7) || ',"ok":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"items":[' || user_id || ',2,3],"deep":{"k":"v' || (event_id % 5) || '"},"none":null}'"""
SRC = f"(SELECT event_id, {DOC} AS doc FROM events) t"


@query("f1_snowflake_id", "SELECT count(*) AS n, count(*) AS ids FROM orders")
def f1(spark, d):
    """Every row gets an id of its own."""
    return table(spark, d, "orders").select(ids.snowflake_id().alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("f2_uuid_v7", "SELECT count(*) AS n, count(*) AS good FROM orders")
def f2(spark, d):
    u = table(spark, d, "orders").select(ids.uuid_v7().alias("u"))
    return u.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.col("u"))).alias("good"))


@query("f3_ulid", "SELECT count(*) AS n, count(*) AS good FROM orders")
def f3(spark, d):
    u = table(spark, d, "orders").select(ids.ulid().alias("u"))
    return u.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("u").rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), F.col("u"))).alias("good"))


@query("f4_current_user", "SELECT o_orderkey, '7' AS me FROM orders WHERE o_custkey = 7")
def f4(spark, d):
    """CURRENT_USER() is a literal of the session's user, put in before planning."""
    from ..plans.select import rewrite_functions, strings_as_spark

    text = rewrite_functions("SELECT o_orderkey, CURRENT_USER() AS me FROM {orders} WHERE CAST(o_custkey AS STRING) = CURRENT_USER()", "7", "user")
    return spark.sql(strings_as_spark(text), orders=table(spark, d, "orders"))


@query("f5_current_role", "SELECT 'service' AS role")
def f5(spark, d):
    from ..plans.select import rewrite_functions

    return spark.sql(rewrite_functions("SELECT CURRENT_ROLE() AS role", "x", "service"))


@query("f7_now", "SELECT true AS sane")
def f7(spark, d):
    return spark.sql("SELECT now() >= timestamp'2024-01-01' AND current_timestamp() = now() AS sane")


@query("f_seq_time", "SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events")
def f_seq(spark, d):
    """A version id gives back its millisecond."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", ids.seq_ms(F.shiftleft(ms - ids.SEQ_EPOCH_MS, 22) + 4095).alias("ms"))


@query("fj1_text", f"SELECT event_id, doc->>'type' AS kind, doc->>'n' AS n, doc->>'none' AS none, doc->>'zzz' AS absent FROM {SRC}")
def fj1(spark, d):
    doc = _doc()
    return table(spark, d, "events").select("event_id", J.json_as_text(doc, "type").alias("kind"), J.json_as_text(doc, "n").alias("n"), J.json_as_text(doc, "none").alias("none"), J.json_as_text(doc, "zzz").alias("absent"))


@query("fj2_json", f"SELECT event_id, CAST(doc->'deep' AS VARCHAR) AS deep, doc->'deep'->>'k' AS k FROM {SRC}")
def fj2(spark, d):
    return table(spark, d, "events").select("event_id", J.json_get(_doc(), "deep").alias("deep"), J.json_as_text(_doc(), "deep", "k").alias("k"))


@query("fj3_array_element", f"SELECT event_id, doc->'items'->>0 AS first, doc->'items'->>9 AS beyond FROM {SRC}")
def fj3(spark, d):
    return table(spark, d, "events").select("event_id", J.json_as_text(_doc(), "items", 0).alias("first"), J.json_as_text(_doc(), "items", 9).alias("beyond"))


@query("fj4_contains", f"SELECT event_id, list_contains(json_keys(doc), 'none') AS has_null, list_contains(json_keys(doc), 'zzz') AS has_absent, list_contains(json_keys(doc, '$.deep'), 'k') AS has_deep FROM {SRC}")
def fj4(spark, d):
    return table(spark, d, "events").select("event_id", J.json_contains(_doc(), "none").alias("has_null"), J.json_contains(_doc(), "zzz").alias("has_absent"), J.json_contains(_doc(), "k", "deep").alias("has_deep"))


@query("fj5_as_text", f"SELECT event_id, doc->>'ok' AS ok FROM {SRC}")
def fj5(spark, d):
    return table(spark, d, "events").select("event_id", J.json_as_text(_doc(), "ok").alias("ok"))


@query("fj6_length", f"SELECT event_id, CAST(json_array_length(doc, '$.items') AS INT) AS items, len(json_keys(doc)) AS keys FROM {SRC}")
def fj6(spark, d):
    return table(spark, d, "events").select("event_id", J.json_length(_doc(), "items").alias("items"), J.json_length(_doc()).cast("bigint").alias("keys"))


@query("fj7_typed", f"SELECT event_id, CAST(doc->>'n' AS BIGINT) AS n, CAST(doc->>'ok' AS BOOLEAN) AS ok, CAST(doc->>'n' AS DOUBLE) AS x FROM {SRC}")
def fj7(spark, d):
    return table(spark, d, "events").select("event_id", J.json_get_int(_doc(), "n").alias("n"), J.json_get_bool(_doc(), "ok").alias("ok"), J.json_get_float(_doc(), "n").alias("x"))


@query("fj8_keys", f"SELECT event_id, array_to_string(json_keys(doc), ',') AS keys, array_to_string(json_keys(doc, '$.deep'), ',') AS deep FROM {SRC}")
def fj8(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(J.json_object_keys(_doc()), ",").alias("keys"), F.array_join(J.json_object_keys(_doc(), "deep"), ",").alias("deep"))


@query(
    "fs_strings",
    """SELECT p_partkey, concat(p_name, '-', p_brand) AS a, lower(p_brand) AS b, upper(p_name) AS c, length(p_name) AS d, substr(p_name, 2, 3) AS e, trim('  ' || p_name || ' ') AS f, ltrim('xx' || p_name, 'x') AS g, rtrim(p_name || 'yy', 'y') AS h,
    replace(p_name, ' ', '_') AS i, split_part(p_name, ' ', 2) AS j, strpos(p_name, 'i') AS k, starts_with(p_name, 'red') AS l, lpad(p_brand, 10, '.') AS m, rpad(p_brand, 10, '.') AS n, reverse(p_name) AS o, repeat(p_type, 2) AS p, regexp_replace(p_name, '[aeiou]', '*', 'g') AS q, regexp_matches(p_brand, '#1[0-9]$') AS r FROM part""",
)
def fs(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.concat(n, F.lit("-"), "p_brand").alias("a"), F.lower("p_brand").alias("b"), F.upper(n).alias("c"), F.length(n).cast("bigint").alias("d"), F.substring(n, 2, 3).alias("e"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("f"),
        F.ltrim(F.concat(F.lit("xx"), n), F.lit("x")).alias("g"), F.rtrim(F.concat(n, F.lit("yy")), F.lit("y")).alias("h"), F.replace(n, F.lit(" "), F.lit("_")).alias("i"), F.split_part(n, F.lit(" "), F.lit(2)).alias("j"), F.instr(n, "i").cast("bigint").alias("k"),
        F.startswith(n, F.lit("red")).alias("l"), F.lpad("p_brand", 10, ".").alias("m"), F.rpad("p_brand", 10, ".").alias("n"), F.reverse(n).alias("o"), F.repeat("p_type", F.lit(2)).alias("p"), F.regexp_replace(n, "[aeiou]", "*").alias("q"), F.rlike("p_brand", F.lit("#1[0-9]$")).alias("r"),
    )


@query(
    "fd_dates",
    """SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, CAST(date_part('dow', ts) AS INT) AS dow, CAST(extract('day' FROM ts) AS INT) AS day, strftime(CAST(ts AS DATE) + INTERVAL 3 DAY, '%Y-%m-%d') AS later, strftime(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bin,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events""",
)
def fd(spark, d):
    ts = F.col("ts")
    bin_ = F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) - F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(15 * 60 * 1_000_000)))
    stamp = "yyyy-MM-dd HH:mm:ss"
    return table(spark, d, "events").select(
        "event_id", F.date_format(F.date_trunc("hour", ts), stamp).alias("hour"), (F.dayofweek(ts) - 1).alias("dow"), F.dayofmonth(ts).alias("day"), F.date_format(F.date_add(F.to_date(ts), 3), "yyyy-MM-dd").alias("later"),
        F.date_format(bin_, stamp).alias("bin"), F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("bigint").alias("days"),
    )


@query(
    "fm_math",
    "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice / 7) AS BIGINT) AS b, CAST(floor(p_retailprice / 7) AS BIGINT) AS c, round(p_retailprice, 0) AS d, CAST(power(p_size, 2) AS DOUBLE) AS e, round(sqrt(p_size), 9) AS f, round(ln(p_retailprice), 9) AS g, round(log10(p_retailprice), 9) AS h, round(exp(p_size / 10.0), 6) AS i, p_partkey % 7 AS j, CAST(sign(p_size - 25) AS DOUBLE) AS k, greatest(p_size, 25) AS l, least(p_size, 25) AS m, nullif(p_size, 25) AS n, p_partkey // 7 AS o FROM part",
)
def fm(spark, d):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", F.abs(s - 25).alias("a"), F.ceil(r / 7).alias("b"), F.floor(r / 7).alias("c"), F.round(r, 0).alias("d"), F.pow(s, F.lit(2)).alias("e"), F.round(F.sqrt(s), 9).alias("f"), F.round(F.ln(r), 9).alias("g"), F.round(F.log10(r), 9).alias("h"),
        F.round(F.exp(s / F.lit(10.0)), 6).alias("i"), (F.col("p_partkey") % 7).alias("j"), F.signum(s - 25).alias("k"), F.greatest(s, F.lit(25)).alias("l"), F.least(s, F.lit(25)).alias("m"), F.nullif(s, F.lit(25)).alias("n"), F.expr("p_partkey div 7").alias("o"),
    )


@query(
    "fa_arrays",
    "SELECT p_partkey, len([p_size, 25, 7]) AS n, list_contains([p_size, 25, 7], 25) AS has, CAST(coalesce(list_position([p_size, 25, 7], 7), 0) AS BIGINT) AS at, array_to_string(list_sort([p_size, 25, 7]), ',') AS sorted, array_to_string(flatten([[p_size], [1, 2]]), ',') AS flat FROM part",
)
def fa(spark, d):
    a = F.array("p_size", F.lit(25), F.lit(7))
    text = lambda x: F.array_join(F.transform(x, lambda e: e.cast("string")), ",")
    return table(spark, d, "part").select("p_partkey", F.size(a).cast("bigint").alias("n"), F.array_contains(a, 25).alias("has"), F.array_position(a, F.lit(7)).alias("at"), text(F.sort_array(a)).alias("sorted"), text(F.flatten(F.array(F.array("p_size"), F.array(F.lit(1), F.lit(2))))).alias("flat"))


@query("fa_unnest", "SELECT p_partkey, unnest([p_size, p_size + 1]) AS v FROM part")
def fau(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.array("p_size", F.col("p_size") + 1)).alias("v"))


@query("fmap_maps", "SELECT p_partkey, p_size AS size, 'Brand' AS other, 2 AS n FROM part")
def fmap(spark, d):
    """Maps occur in expressions only, not as column types."""
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.split_part("p_brand", F.lit("#"), F.lit(1)))
    return table(spark, d, "part").select("p_partkey", F.element_at(m, "size").cast("int").alias("size"), F.element_at(m, "brand").alias("other"), F.size(F.map_keys(m)).alias("n"))
