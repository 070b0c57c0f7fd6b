"""Statistics over metric tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats
from ..session import table
from .catalog import query


@query("w1_distance", """
WITH qs AS (SELECT i, 0.01 + i * (0.98 / 199) AS q FROM range(200) r(i)),
v AS (SELECT l_linestatus AS s, l_returnflag AS f, list_sort(list(l_extendedprice)) AS xs, count(*) AS n, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1, 2),
p AS (SELECT s, f, sd, i, xs[CAST(floor(q * (n - 1)) AS BIGINT) + 1] * (1 - (q * (n - 1) - floor(q * (n - 1)))) +
  xs[least(CAST(floor(q * (n - 1)) AS BIGINT) + 2, n)] * (q * (n - 1) - floor(q * (n - 1))) AS x FROM v, qs)
SELECT a.s AS l_linestatus, round(avg(abs(a.x - b.x)), 4) AS distance, round(avg(abs(a.x - b.x)) / max(CASE WHEN b.sd = 0 THEN 1 ELSE b.sd END), 6) AS relative
FROM p a JOIN p b ON a.s = b.s AND a.i = b.i WHERE a.f = 'R' AND b.f != 'R' AND b.f = (SELECT min(f) FROM v WHERE v.s = a.s AND f != 'R') GROUP BY 1
""")
def w1_distance(spark, sf_dir):
    """Prices of returned lines against those of the first other flag, by line status."""
    t = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_extendedprice")
    other = t.where("l_returnflag != 'R'").groupBy("l_linestatus").agg(F.min("l_returnflag").alias("other"))
    t = t.join(other, "l_linestatus")
    real = t.where("l_returnflag = other")
    d = stats.w1(t.where("l_returnflag = 'R'"), real, "l_linestatus", "l_extendedprice")
    out = d.join(real.groupBy("l_linestatus").agg(F.stddev_pop("l_extendedprice").alias("sd")), "l_linestatus")
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return out.select("l_linestatus", F.round("distance", 4).alias("distance"), F.round(F.col("distance") / sd, 6).alias("relative"))


@query("snapshot_best", """
WITH d AS (SELECT p_brand, p_size, round(abs(avg(p_retailprice) - 1400) / 100 + 1e-9, 6) AS distance FROM part GROUP BY 1, 2),
m AS (SELECT p_brand, avg(distance) AS mean_distance, arg_min(p_size, (distance, p_size)) AS best FROM d GROUP BY 1)
SELECT p_brand, round(mean_distance + 1e-9, 6) AS mean_distance, best, CASE WHEN mean_distance < 0.9 THEN 'close' WHEN mean_distance < 1.2 THEN 'usable' ELSE 'far' END AS verdict FROM m
""")
def snapshot_best(spark, sf_dir):
    d = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.round(F.abs(F.avg("p_retailprice") - 1400) / 100 + 1e-9, 6).alias("distance"))
    m = d.groupBy("p_brand").agg(F.avg("distance").alias("m"), F.min_by("p_size", F.struct("distance", "p_size")).alias("best"))
    verdict = F.when(F.col("m") < 0.9, "close").when(F.col("m") < 1.2, "usable").otherwise("far")
    return m.select("p_brand", F.round(F.col("m") + 1e-9, 6).alias("mean_distance"), "best", verdict.alias("verdict"))


@query("city_median_mae", """
WITH a AS (SELECT c_nationkey AS k, median(c_acctbal) AS m FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, median(s_acctbal) AS m FROM supplier GROUP BY 1)
SELECT count(*) AS cities, round(avg(abs(a.m - b.m)), 6) AS mae FROM a JOIN b USING (k)
""")
def city_median_mae(spark, sf_dir):
    a = stats.medians(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("a")), "k", "a")
    b = stats.medians(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b")), "k", "b")
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("cities"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mae"))


@query("corpus_standardise", """
WITH t AS (SELECT c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS n FROM customer)
SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM t)) / (SELECT stddev_pop(c_acctbal) FROM t), 6) AS c_acctbal,
  round((n - (SELECT avg(n) FROM t)) / (SELECT stddev_pop(n) FROM t), 6) AS n FROM t
""")
def corpus_standardise(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    return stats.standardise(t, ["c_acctbal", "n"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), F.round("n", 6).alias("n"))


@query("percentile_rank", """
WITH o AS (SELECT c_custkey, max(o_totalprice) AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, v, round(100.0 * (SELECT count(*) FROM orders WHERE o_totalprice < v) / (SELECT count(*) FROM orders), 1) AS percentile FROM o
""")
def percentile_rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    top = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.max("o_totalprice").alias("v"))
    return stats.percentile_rank(top, orders.select(F.col("o_totalprice").alias("v")), "c_custkey", "v")


@query("nearest_real", """
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, list_distance(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS distance FROM q, embeddings)
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 5
""")
def nearest_real(spark, sf_dir):
    """Every vector whose number 50 divides, against all vectors."""
    t = table(spark, sf_dir, "embeddings")
    q = t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return stats.nearest(q, t, 5, "query_id", "vec_id", "embedding")


@query("walk_monotone", """
WITH d AS (SELECT user_id, event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS d FROM events),
s AS (SELECT user_id, sum(d) AS t FROM d WHERE d IS NOT NULL GROUP BY 1)
SELECT user_id, round(t, 4) AS change, round(avg(CASE WHEN round(t, 9) = 0 THEN 0.0 WHEN sign(d) = sign(t) THEN 1.0 ELSE 0.0 END), 6) AS monotone
FROM d JOIN s USING (user_id) WHERE d IS NOT NULL GROUP BY user_id, t
""")
def walk_monotone(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return stats.walk(t, "user_id", "at", "value").withColumn("change", F.round("change", 4))


@query("bias_table", """
SELECT l_returnflag, round(avg(d), 6) AS bias, round(avg(abs(d)), 6) AS mae, round(arg_max(d, (abs(d), d)), 6) AS worst
FROM (SELECT l_returnflag, l_quantity * 1000 - l_extendedprice AS d FROM lineitem) GROUP BY 1
""")
def bias_table(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000 - F.col("l_extendedprice")).alias("d"))
    return t.groupBy("l_returnflag").agg(
        F.round(F.avg("d"), 6).alias("bias"), F.round(F.avg(F.abs("d")), 6).alias("mae"), F.round(F.max_by("d", F.struct(F.abs("d"), "d")), 6).alias("worst")
    )


@query("delivered", """
WITH t AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS hi, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS lo,
  max(o_totalprice) - min(o_totalprice) AS asked FROM orders GROUP BY 1)
SELECT o_orderpriority, round(CASE WHEN asked = 0 THEN 0 ELSE (hi - lo) / asked END, 8) AS delivered FROM t
""")
def delivered(spark, sf_dir):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    t = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.avg(F.when(status == "F", price)).alias("hi"), F.avg(F.when(status == "O", price)).alias("lo"), (F.max(price) - F.min(price)).alias("asked")
    )
    return t.select("o_orderpriority", F.round(F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("asked")), F.lit(0.0)), 8).alias("delivered"))


@query("sweep_verdict", """
WITH t AS (SELECT event_type, extract(day FROM ts) AS size, avg(value) AS v FROM events GROUP BY 1, 2),
e AS (SELECT event_type, arg_min(v, size) AS first, arg_max(v, size) AS last FROM t GROUP BY 1)
SELECT event_type, round(last / first, 6) AS rise, CASE WHEN last / first >= 2.5 THEN 'wired' ELSE 'flat' END AS wiring, last >= 50 AS usable FROM e
""")
def sweep_verdict(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("event_type", F.day("ts").alias("size")).agg(F.avg("value").alias("v"))
    e = t.groupBy("event_type").agg(F.min_by("v", "size").alias("first"), F.max_by("v", "size").alias("last"))
    rise = F.col("last") / F.col("first")
    return e.select("event_type", F.round(rise, 6).alias("rise"), F.when(rise >= 2.5, "wired").otherwise("flat").alias("wiring"), (F.col("last") >= 50).alias("usable"))


@query("repeat_spread", """
WITH t AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, q[CAST(round_even(0.1 * (n - 1), 0) AS INT) + 1] AS p10, q[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] AS p50,
  q[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] AS p90 FROM t
""")
def repeat_spread(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[stats.nearest_rank_quantile("l_quantity", q).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)]
    )


@query("loss_smoothing", """
WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
s AS (SELECT o_custkey, i, v AS e FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.i, 0.9 * s.e + (1 - 0.9) * o.v FROM s JOIN o ON o.o_custkey = s.o_custkey AND o.i = s.i + 1)
SELECT o_custkey, round(arg_max(e, i), 2) AS smoothed FROM s GROUP BY 1
""")
def loss_smoothing(spark, sf_dir):
    return stats.smoothed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 0.9).withColumn("smoothed", F.round("smoothed", 2))


@query("condition_normaliser", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) + 0.001, 6) AS deviation FROM events GROUP BY 1
""")
def condition_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value") + 0.001, 6).alias("deviation"))


@query("best_of_repeats", """
WITH s AS (SELECT l_orderkey, l_linenumber, sqrt(pow((l_quantity - 25) / 14, 2) + pow((l_discount - 0.05) / 0.03, 2)) AS d, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, arg_min(l_linenumber, (round(d, 9), l_linenumber)) AS best, round(min(d), 6) AS distance FROM s WHERE n > 1 GROUP BY 1
""")
def best_of_repeats(spark, sf_dir):
    """The repeat nearest to what was asked, where there are several."""
    d = F.sqrt(F.pow((F.col("l_quantity") - 25) / 14, 2) + F.pow((F.col("l_discount") - 0.05) / 0.03, 2))
    t = table(spark, sf_dir, "lineitem").withColumn("d", d)
    out = t.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(F.round("d", 9), "l_linenumber")).alias("best"), F.round(F.min("d"), 6).alias("distance"), F.count(F.lit(1)).alias("n"))
    return out.where("n > 1").drop("n")


@query("ridge_fit", """
WITH t AS (SELECT l_returnflag AS k, (l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w AS x, (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_pop(l_extendedprice) OVER w AS y
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag))
SELECT k AS l_returnflag, round(sum(x * y) / (sum(x * x) + 1.0), 6) AS slope, round(1 - sum(pow(y - x * b, 2)) / sum(y * y), 6) AS r2
FROM t JOIN (SELECT k, sum(x * y) / (sum(x * x) + 1.0) AS b FROM t GROUP BY 1) USING (k) GROUP BY 1
""")
def ridge_fit(spark, sf_dir):
    """One standardised feature and target: from sums alone, in one aggregate."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r")
    )
    b = F.col("n") * F.col("r") / (F.col("n") + 1.0)
    return s.select("l_returnflag", F.round(b, 6).alias("slope"), F.round(2 * b * F.col("r") - b * b, 6).alias("r2"))


@query("principal_components", None)
def principal_components(spark, sf_dir):
    """Share of variance of the first components of all vectors; the Gram matrix is summed part by part."""
    from ..operators.algebra import components

    return components(table(spark, sf_dir, "embeddings"), "embedding", 8)


@query("direction_fit", None)
def direction_fit(spark, sf_dir):
    """Ridge directions of two targets in the space of all vectors: R2, and after Gram-Schmidt in that order."""
    from ..operators.algebra import directions

    t = table(spark, sf_dir, "embeddings").select("embedding", F.col("label").cast("double").alias("label"), (F.col("vec_id") % 7).cast("double").alias("phase"))
    return directions(t, "embedding", ["label", "phase"], ridge=1.0)


@query("held_out_split", """
WITH s AS (SELECT source, row_number() OVER (ORDER BY md5('11:' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT k <= ceil(n / 10.0) AS held_out, count(*) AS docs, count(DISTINCT source) AS sources FROM documents JOIN s USING (source) GROUP BY 1
""")
def held_out_split(spark, sf_dir):
    """One source in ten is held out, by the order of a seeded hash."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    held = sources.withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("11:"), "source")), "source"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    held = held.select("source", (F.col("k") <= F.ceil(F.col("n") / 10)).alias("held_out"))
    return table(spark, sf_dir, "documents").join(held, "source").groupBy("held_out").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("source").alias("sources"))


@query("newton_targets", """
WITH RECURSIVE x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS k, l_quantity / 10 AS a, l_discount * 100 AS b, l_tax * 100 AS c, l_extendedprice / 10000 AS y, l_extendedprice / 10000 * (1 - l_discount) AS z FROM lineitem),
f AS MATERIALIZED (SELECT k, avg(y) - covar_pop(y, a) / var_pop(a) * avg(a) - covar_pop(y, b) / var_pop(b) * avg(b) - covar_pop(y, c) / var_pop(c) * avg(c) AS o1,
    avg(z) - covar_pop(z, a) / var_pop(a) * avg(a) - covar_pop(z, b) / var_pop(b) * avg(b) - covar_pop(z, c) / var_pop(c) * avg(c) AS o2,
    covar_pop(y, a) / var_pop(a) AS a1, covar_pop(y, b) / var_pop(b) AS b1, covar_pop(y, c) / var_pop(c) AS c1, covar_pop(z, a) / var_pop(a) AS a2, covar_pop(z, b) / var_pop(b) AS b2, covar_pop(z, c) / var_pop(c) AS c2 FROM x GROUP BY 1),
m AS MATERIALIZED (SELECT *, a1 * a1 + b1 * b1 + c1 * c1 + 0.001 AS aa, a2 * a2 + b2 * b2 + c2 * c2 + 0.001 AS bb, a1 * a2 + b1 * b2 + c1 * c2 AS ab FROM f),
w AS (SELECT l_orderkey, l_linenumber, k, a, b, c, 0 AS n, 6.0 - o1 - (a1 * a + b1 * b + c1 * c) AS p, 5.5 - o2 - (a2 * a + b2 * b + c2 * c) AS q FROM x JOIN m USING (k)
  UNION ALL SELECT l_orderkey, l_linenumber, k, a, b, c, n, 6.0 - o1 - (a1 * a + b1 * b + c1 * c), 5.5 - o2 - (a2 * a + b2 * b + c2 * c) FROM (
    SELECT l_orderkey, l_linenumber, k, o1, o2, a1, b1, c1, a2, b2, c2, a + da * g AS a, b + db * g AS b, c + dc * g AS c, n + 1 AS n FROM (
      SELECT *, least(1.0, coalesce(1.5 / nullif(sqrt(da * da + db * db + dc * dc), 0), 1.0)) AS g FROM (SELECT *, a1 * u + a2 * v AS da, b1 * u + b2 * v AS db, c1 * u + c2 * v AS dc FROM (
        SELECT *, (p * bb - q * ab) / (aa * bb - ab * ab) AS u, (q * aa - p * ab) / (aa * bb - ab * ab) AS v FROM w JOIN m USING (k) WHERE n < 8 AND greatest(abs(p), abs(q)) > 0.01) h) i) j) l)
SELECT l_orderkey, l_linenumber, count(*) AS lines, max(steps) AS steps, round(max(miss), 4) AS miss, round(sum(a), 4) AS a, round(sum(b), 4) AS b FROM (
  SELECT l_orderkey, l_linenumber, a, b, n AS steps, greatest(abs(p), abs(q)) AS miss FROM w WHERE n = 8 OR greatest(abs(p), abs(q)) <= 0.01) z GROUP BY 1, 2
""")
def newton_targets(spark, sf_dir):
    """Each order line's quantity, discount and tax moved until the metrics that they drive (slopes by return flag) reach two targets."""
    from ..operators import newton

    t = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("k"), (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"),
        (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_extendedprice") / 10000 * (1 - F.col("l_discount"))).alias("z"),
    )
    slope = {(m, v): F.covar_pop(m, v) / F.var_pop(v) for m in "yz" for v in "abc"}
    fitted = t.groupBy("k").agg(*[(F.avg(m) - slope[m, "a"] * F.avg("a") - slope[m, "b"] * F.avg("b") - slope[m, "c"] * F.avg("c")).alias(f"o_{m}") for m in "yz"], *[F.array(*[slope[m, v] for v in "abc"]).alias(f"j_{m}") for m in "yz"])
    options = t.join(F.broadcast(fitted), "k")  # one row a return flag
    options = options.select("l_orderkey", "l_linenumber", F.array("a", "b", "c").alias("w0"), F.lit(6.0).alias("t_y"), F.lit(5.5).alias("t_z"), "o_y", "o_z", "j_y", "j_z")
    out = newton.towards(options, "w0", ("t_y", "t_z"), ("o_y", "o_z"), ("j_y", "j_z"), 0.001, 1.5, 0.01, 8)
    return out.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("lines"), F.max("steps").alias("steps"), F.round(F.max("miss"), 4).alias("miss"), F.round(F.sum(F.get("w", F.lit(0))), 4).alias("a"), F.round(F.sum(F.get("w", F.lit(1))), 4).alias("b")
    )
