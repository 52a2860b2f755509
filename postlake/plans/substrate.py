"""Queries over the star schema: what Spark itself offers to users of this library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, round(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(24,4))), 2)::DOUBLE AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY ALL""")
def substrate_pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '2001-01-01'")
    revenue = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(24,4)")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.round(F.sum(revenue), 2).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(CAST(l_extendedprice AS DECIMAL(24,4))), 2)::DOUBLE AS price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND l_returnflag <> 'R' GROUP BY ALL ORDER BY price DESC, o_orderkey LIMIT 20""")
def substrate_shipping_priority(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    price = F.round(F.sum(F.col("l_extendedprice").cast("decimal(24,4)")), 2).cast("double").alias("price")
    return rows.groupBy("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(price).orderBy(F.desc("price"), "o_orderkey").limit(20)


@query("SELECT r_name, n_name, count(*) AS n, grouping(r_name) * 2 + grouping(n_name) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def substrate_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def substrate_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def substrate_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY ALL")
def substrate_pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "FOP"])


@query("SELECT p_partkey, unnest(['p_size', 'p_length']) AS name, unnest([CAST(p_size AS BIGINT), CAST(length(p_name) AS BIGINT)]) AS value FROM part")
def substrate_unpivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), F.length("p_name").cast("long").alias("p_length"))
    return p.unpivot("p_partkey", ["p_size", "p_length"], "name", "value")


@query("""SELECT c_custkey, rank() OVER w AS rk, dense_rank() OVER w AS dense, ntile(4) OVER w2 AS quarter, lag(c_custkey) OVER w2 AS before, first_value(c_custkey) OVER w2 AS leader,
    count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment), w2 AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def substrate_windows(spark, sf_dir):
    w, w2 = Window.partitionBy("c_nationkey").orderBy("c_mktsegment"), Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(w2).alias("quarter"), F.lag("c_custkey").over(w2).alias("before"),
        F.first("c_custkey").over(w2).alias("leader"), F.count(F.lit(1)).over(w2.rowsBetween(-2, 0)).alias("near"),
    )


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


@query(f"SELECT 'intersect' AS op, k, count(*) AS n FROM ({_A} INTERSECT ALL {_B}) GROUP BY ALL UNION ALL SELECT 'except', k, count(*) FROM ({_A} EXCEPT ALL {_B}) GROUP BY ALL UNION ALL SELECT 'union', k, count(*) FROM ({_A} UNION ALL {_B}) GROUP BY ALL")
def substrate_set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "k", "n") for op, df in (("intersect", a.intersectAll(b)), ("except", a.exceptAll(b)), ("union", a.union(b)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) SELECT c_custkey AS c, o.k AS o, n FROM customer c FULL JOIN o ON c_custkey = o.k""")
def substrate_full_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("o")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    return c.join(o, F.col("c") == F.col("o"), "full")


@query("SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') z ON c_custkey = z.o_custkey")
def substrate_semi_and_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    has = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(has("P"), "c_custkey", "left_semi").join(has("F"), "c_custkey", "left_anti")


@query("SELECT event_type, count(DISTINCT user_id) AS users, median(value) AS mid, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def substrate_distinct_and_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.median("value").alias("mid"), F.count(F.lit(1)).alias("n"))


@query()
def substrate_approximate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", [0.5, 0.99]).alias("quantiles"))
