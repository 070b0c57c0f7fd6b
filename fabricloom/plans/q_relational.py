"""Queries beyond the tile corpus, so that the driver's tables can be used: joins, cubes, as-of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .catalog import query


@query("revenue_by_nation", """
SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""")
def revenue_by_nation(spark, sf_dir):
    """Lines are summed by order before the joins, so that what is shuffled twice is one row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")).alias("rev"))
    t = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.sum("rev").alias("rev"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return t.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "y", F.col("rev").cast("double").alias("revenue"))


@query("pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")
    )


@query("segment_cube", """
SELECT c_mktsegment, c_nationkey % 5 AS part, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 5)
""")
def segment_cube(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_mktsegment", (F.col("c_nationkey") % 5).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    """Customers without any order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("asof_purchase", """
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view')
SELECT p.event_id, arg_max(v.value, (v.ts, v.event_id)) AS last_view FROM p LEFT JOIN v ON v.user_id = p.user_id AND (v.ts, v.event_id) < (p.ts, p.event_id) GROUP BY 1
""")
def asof_purchase(spark, sf_dir):
    """Each purchase with its user's last view before: both kinds in one ordered pass, no join of pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "view"))
    seen = F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w)
    return e.withColumn("last_view", seen).where("event_type = 'purchase'").select("event_id", "last_view")


@query("top_parts", """
SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3
""")
def top_parts(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("k", F.row_number().over(w)).where("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("union_first_wins", """
WITH u AS (SELECT c_nationkey AS k, 0 AS src, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey FROM supplier)
SELECT k, src, id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, id) = 1
""")
def union_first_wins(spark, sf_dir):
    """Union of two fetches with repeats; the first of each key stays."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(0).alias("src"), F.col("c_custkey").alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("src"), F.col("s_suppkey").alias("id"))
    best = a.unionByName(b).groupBy("k").agg(F.min(F.struct("src", "id")).alias("b"))
    return best.select("k", "b.src", "b.id")
