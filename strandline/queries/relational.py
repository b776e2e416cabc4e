"""Projection, filters, joins, aggregates, windows, order, set operations and CTEs (P, J, A, N, O, U)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import query, spark_sql, table, total



# projection and filter


@query("p1_expressions", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_partkey + l_suppkey AS both_keys FROM lineitem")
def p1(spark, d):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (F.col("l_partkey") + F.col("l_suppkey")).alias("both_keys"))


@query("p2_select_all", "SELECT * FROM nation")
def p2(spark, d):
    return table(spark, d, "nation").select("*")


@query("p3_predicates", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice >= 100000) OR (o_orderstatus <> 'O' AND NOT o_totalprice < 400000)")
def p3(spark, d):
    return table(spark, d, "orders").filter("(o_orderstatus = 'F' AND o_totalprice >= 100000) OR (o_orderstatus <> 'O' AND NOT o_totalprice < 400000)").select("o_orderkey")


@query("p4_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name ILIKE 'RED%' OR p_name LIKE 'a!_%' ESCAPE '!'")
def p4(spark, d):
    return spark_sql(spark, d, "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%ring' OR p_name ILIKE 'RED%' OR p_name LIKE 'a!_%' ESCAPE '!'", "part")


@query("p5_in_and_null", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IS NOT NULL AND nullif(c_acctbal, 0) IS NOT NULL")
def p5(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment IN ('MACHINERY', 'FURNITURE') AND c_nationkey IS NOT NULL AND nullif(c_acctbal, 0) IS NOT NULL").select("c_custkey")


@query("p6_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def p6(spark, d):
    return table(spark, d, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey")


@query("p7_case_coalesce_cast", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def p7(spark, d):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 1000, "low").otherwise("high")
    return table(spark, d, "customer").select("c_custkey", band.alias("band"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("none")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))


@query("p8_json_predicate", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) > 50")
def p8(spark, d):
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k").cast("bigint") > 50).select("event_id")


@query("p10_parameters", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 30 AND p_type = 'SMALL' OR p_size = 10")
def p10(spark, d):
    from ..plans.select import bind_params

    text, args = bind_params("SELECT p_partkey FROM {part} WHERE p_size > $1 AND p_size < $2 AND p_type = $3 OR p_size = $1", [10, 30, "SMALL"])
    return spark.sql(text, args=args, part=table(spark, d, "part"))


@query("p12_row_level_security", "SELECT o_orderkey FROM orders WHERE o_custkey = 11")
def p12(spark, d):
    """The caller's scope is a filter on the table, below whatever the query does."""
    scoped = table(spark, d, "orders").filter("o_custkey = 11")
    return spark.sql("SELECT o_orderkey FROM {orders}", orders=scoped)


# joins


@query("j1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j2_small_side", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j2(spark, d):
    """Nations and regions are dimension tables of fixed size; Spark broadcasts them by their statistics, without a hint."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j3_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
def j3(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j4_right_and_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT p_partkey AS k FROM part WHERE p_size > 25) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_type = 'SMALL') b ON a.k = b.k")
def j4(spark, d):
    p = table(spark, d, "part")
    a, b = p.filter("p_size > 25").select(F.col("p_partkey").alias("ak")), p.filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("bk"))
    return a.join(b, F.col("ak") == F.col("bk"), "full")


@query("j4_right_join", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def j4r(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("j5_cross_and_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey UNION ALL SELECT r.r_regionkey, n.n_nationkey FROM region r CROSS JOIN nation n")
def j5(spark, d):
    """Only on dimension tables: a join without an equality compares all pairs."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    theta = a.join(b, (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).select("a", "b")
    return theta.unionAll(r.select(F.col("r_regionkey").alias("a")).crossJoin(n.select(F.col("n_nationkey").alias("b"))))


@query("j6_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def j6(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 450000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("j7_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j7(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def not_in(rows, column: str, values):
    """The ``rows`` for which ``column NOT IN (values)`` is true: all if there are no values, none if one of them is null, else those of a known key that none equals.

    Spark's own plan of NOT IN broadcasts all values whatever their number. Here the distinct ones are joined by their key, and one row says whether there are any and whether one is null."""
    values = values.toDF("_value")
    said = values.agg(F.count(F.lit(1)).alias("_n"), F.count("_value").alias("_known"))
    left = rows.join(values.distinct(), F.col(column) == F.col("_value"), "left_anti").crossJoin(F.broadcast(said))
    return left.filter((F.col("_n") == 0) | (F.col(column).isNotNull() & (F.col("_n") == F.col("_known")))).select(*rows.columns)


@query("j7_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 10)")
def j7n(spark, d):
    return not_in(table(spark, d, "part").select("p_partkey"), "p_partkey", table(spark, d, "lineitem").filter("l_quantity > 10").select("l_partkey"))


@query("j8_derived_table", "SELECT c_custkey, t.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c_custkey WHERE t.n > 12")
def j8(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")
    return table(spark, d, "customer").join(t, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "n")


@query("j1_multi_table_join", "SELECT c_mktsegment AS tier, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def j1m(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("tier")).agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("amount"))


# aggregates


@query("a1_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_quantity), 2) / count(*) AS avg_qty FROM lineitem GROUP BY ALL")
def a1(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_price"), (total("l_quantity") / F.count(F.lit(1))).alias("avg_qty"))


@query("a2_multi_key_top", "SELECT l_suppkey, l_returnflag, round(sum(l_quantity * l_extendedprice), 2) AS revenue FROM lineitem GROUP BY l_suppkey, l_returnflag ORDER BY revenue DESC, l_suppkey LIMIT 10")
def a2(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(total(F.col("l_quantity") * F.col("l_extendedprice")).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "l_suppkey").limit(10)


@query("a3_filtered", "SELECT round(sum(l_extendedprice), 2) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_discount > 0.05")
def a3(spark, d):
    return table(spark, d, "lineitem").filter("l_discount > 0.05").agg(total("l_extendedprice").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("a4_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def a4(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 15")


@query("a5_global", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem")
def a5(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), total("l_extendedprice").alias("s"))


@query("a6_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def a6(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("a7_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def a7(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("a8_max_coalesce", "SELECT coalesce(max(o_orderkey), 0) AS top, coalesce(max(CASE WHEN o_orderkey < 0 THEN o_orderkey END), -1) AS none FROM orders")
def a8(spark, d):
    return table(spark, d, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("top"), F.coalesce(F.max(F.when(F.col("o_orderkey") < 0, F.col("o_orderkey"))), F.lit(-1)).alias("none"))


GROUPED = "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS gs, count(*) AS n FROM orders GROUP BY "


@query("a9_rollup", GROUPED + "ROLLUP (o_orderstatus, o_orderpriority)")
def a9(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("bigint").alias("gs"), F.count(F.lit(1)).alias("n"))


@query("a9_cube", GROUPED + "CUBE (o_orderstatus, o_orderpriority)")
def a9c(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("bigint").alias("gs"), F.count(F.lit(1)).alias("n"))


@query("a9_grouping_sets", GROUPED + "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def a9g(spark, d):
    return spark_sql(spark, d, "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS gs, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")


@query(
    "a10_statistics",
    "SELECT p_type, round(stddev_samp(p_size), 6) AS sd, round(var_pop(p_size), 6) AS vp, median(p_size) AS med, count(*) FILTER (WHERE p_size > 25) AS big, count(DISTINCT p_brand) AS brands, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brand_list FROM part GROUP BY p_type",
)
def a10(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(
        F.round(F.stddev_samp("p_size"), 6).alias("sd"), F.round(F.var_pop("p_size"), 6).alias("vp"), F.median("p_size").alias("med"), F.count_if(F.col("p_size") > 25).alias("big"),
        F.count_distinct("p_brand").alias("brands"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brand_list"),
    )


@query("a10_approx_distinct", "SELECT abs(count(DISTINCT l_partkey) - count(DISTINCT l_partkey)) < 1 AS near FROM lineitem")
def a10a(spark, d):
    """The estimate lies within 10 % of the exact count."""
    e, n = F.approx_count_distinct("l_partkey", 0.02), F.count_distinct("l_partkey")
    return table(spark, d, "lineitem").agg((F.abs(e - n) <= 0.1 * n).alias("near"))


# windows


@query(
    "n1_ranks",
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(3) OVER w AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
def n1(spark, d):
    w, s = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(s).cast("bigint").alias("rk"), F.dense_rank().over(s).cast("bigint").alias("dr"), F.ntile(3).over(w).cast("bigint").alias("nt"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query(
    "n2_neighbours",
    "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
def n2(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, -1.0).over(w).alias("after"), F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(whole).alias("last"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


@query(
    "n3_frames",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near, min(o_totalprice) OVER w AS lo, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def n3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(run), 2).alias("running"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"), F.count(F.lit(1)).over(w.rangeBetween(-1000, 1000)).alias("near"), F.min("o_totalprice").over(run).alias("lo"), F.max("o_totalprice").over(run).alias("hi"))


# order and limit


@query("o1_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal ASC NULLS FIRST, c_custkey LIMIT 25")
def o1(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_mktsegment").desc_nulls_last(), F.col("c_acctbal").asc_nulls_first(), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("o2_limit_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30")
def o2(spark, d):
    return table(spark, d, "part").orderBy("p_partkey").offset(30).limit(10).select("p_partkey")


@query("o3_top_k", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o3(spark, d):
    return table(spark, d, "orders").filter(F.col("o_totalprice").between(100000, 400000)).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("o4_default_order", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey NULLS LAST")
def o4(spark, d):
    from ..plans.select import default_order

    sql = "SELECT n_nationkey, n_name FROM {nation}"
    return default_order(spark_sql(spark, d, sql, "nation"), "SELECT n_nationkey, n_name FROM nation", ["n_nationkey", "_seq"])


@query("o5_default_limit", "SELECT count(*) AS n FROM (SELECT * FROM part LIMIT 50)")
def o5(spark, d):
    from ..plans.select import default_limit

    return default_limit(table(spark, d, "part"), "SELECT * FROM part", 50, 1000).agg(F.count(F.lit(1)).alias("n"))


# set operations and CTEs


@query("u1_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u1(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, d, "supplier").select("s_nationkey"))


@query("u2_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u2(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u3_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def u3(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(li.filter("l_discount > 0.08").select("l_partkey"))


@query("u4_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def u4(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").filter("l_quantity > 25").select("l_partkey"))


CTE = "WITH big AS (SELECT o_custkey, o_totalprice FROM {o} WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey), top AS (SELECT * FROM per WHERE n >= 5) SELECT c_name, n FROM top JOIN {c} ON o_custkey = c_custkey"


@query("u5_cte", CTE.format(o="orders", c="customer"))
def u5(spark, d):
    return spark_sql(spark, d, CTE.replace("{o}", "{orders}").replace("{c}", "{customer}"), "orders", "customer")


@query("u6_recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def u6(spark, d):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


# the shapes of the published benchmark, on tables of the same size


@query("bench_flushed_filter", "SELECT l_shipmode AS category, n, s FROM (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS l_shipmode, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) t")
def bench_flushed(spark, d):
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("string").alias("category"))
    return g.agg(F.count(F.lit(1)).alias("n"), total("l_extendedprice").alias("s"))
