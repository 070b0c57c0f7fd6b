"""Design-space queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import space
from ..session import table
from .catalog import query

_AXES = [("coverage", 10.0, 40.0, 4), ("height", 6.0, 30.0, 3), ("green", 0.0, 20.0, 3), ("seed", 1.0, 3.0, 3)]


@query("param_grid", """
SELECT s_suppkey, ((a.i * 3 + b.i) * 3 + c.i) * 3 + d.i + 1 AS option, lpad(CAST(((a.i * 3 + b.i) * 3 + c.i) * 3 + d.i + 1 AS VARCHAR), 3, '0') AS name,
  10.0 + a.i * 10.0 + s_suppkey % 5 AS coverage, 6.0 + b.i * 12.0 AS height, c.i * 10.0 AS green, CAST(1 + d.i AS DOUBLE) AS seed FROM supplier, range(4) a(i), range(3) b(i), range(3) c(i), range(3) d(i)
""")
def param_grid(spark, sf_dir):
    """The options of each supplier, whose coverage starts at its own."""
    axes = {n: space.axis(lo, hi, k, n == "seed") for n, lo, hi, k in _AXES}
    axes["coverage"] = F.transform(axes["coverage"], lambda x: x + F.col("s_suppkey") % 5)
    t = space.grid(spark, axes, table(spark, sf_dir, "supplier").select("s_suppkey"))
    return t.withColumn("name", space.option_name(F.col("option"), 108))


def _options(spark):
    t = space.grid(spark, {n: space.axis(lo, hi, k, n == "seed") for n, lo, hi, k in _AXES})
    return t.withColumn("name", space.option_name(F.col("option"), 108))


@query("payload_route", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS target_coverage, p_retailprice AS dir_height, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS pca, 1 AS base FROM part
""")
def payload_route(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    keys = F.when(even, F.array(*map(F.lit, ["target:coverage", "dir:height", "seed", "pca2"]))).otherwise(F.array(*map(F.lit, ["target:coverage", "dir:height", "seed", "psi"])))
    values = F.array(F.col("p_size").cast("double"), "p_retailprice", F.lit(1.0), F.lit(0.5))
    t = table(spark, sf_dir, "part").select("p_partkey", space.route(F.map_from_arrays(keys, values)).alias("q"))
    base = F.when(F.map_contains_key("q.base", "seed"), 1).otherwise(0)
    return t.select("p_partkey", F.col("q.targets")["coverage"].alias("target_coverage"), F.col("q.directions")["height"].alias("dir_height"), F.size("q.pca").alias("pca"), base.alias("base"))


@query("resume_todo", "SELECT DISTINCT user_id AS name FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def resume_todo(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), "event_type", "value")
    return space.resume(e.select("name").distinct(), e.where("event_type = 'purchase' and value > 95"))


@query("schema_union", """
SELECT n_nationkey AS name, c.bal AS customer_balance, CAST(NULL AS DOUBLE) AS supplier_balance FROM nation JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey, NULL, s.bal FROM nation JOIN (SELECT s_nationkey, round(sum(s_acctbal), 2) AS bal FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
""")
def schema_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("name")).agg(F.round(F.sum("c_acctbal"), 2).alias("customer_balance"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.round(F.sum("s_acctbal"), 2).alias("supplier_balance"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"))
    return space.tables(names, [a, b]).where("customer_balance is not null or supplier_balance is not null")


@query("run_statistics", """
SELECT event_type, count(*) AS options, count_if(value < 5) AS failed, round(sum(value), 2) AS seconds, round(count(*) / sum(value), 6) AS rate FROM events GROUP BY 1
""")
def run_statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("options"), F.count_if(F.col("value") < 5).alias("failed"), F.round(F.sum("value"), 2).alias("seconds"), F.round(F.count(F.lit(1)) / F.sum("value"), 6).alias("rate")
    )


@query("keep_last_six", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6")
def keep_last_six(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 6").select("user_id", "event_id")


@query("stub_space", """
WITH p AS (SELECT ((a.i * 3 + b.i) * 3 + c.i) * 3 + d.i + 1 AS option, lpad(CAST(((a.i * 3 + b.i) * 3 + c.i) * 3 + d.i + 1 AS VARCHAR), 3, '0') AS name,
  10.0 + a.i * 10.0 AS coverage, 6.0 + b.i * 12.0 AS height, c.i * 10.0 AS green, CAST(1 + d.i AS DOUBLE) AS seed FROM range(4) a(i), range(3) b(i), range(3) c(i), range(3) d(i)),
m AS (SELECT tile_id, round(100.0 * avg(CASE WHEN cls = 'building' THEN 1 ELSE 0 END), 6) AS coverage_pct, round(coalesce(sum(h) FILTER (cls = 'building'), 0) / (3.0 * count(*)), 6) AS far_proxy FROM full_cells GROUP BY 1)
SELECT option, name, coverage, height, green, seed, CASE WHEN option % 10 != 0 THEN CAST(option % 8 AS INT) END AS tile_id,
  CASE WHEN option % 10 = 0 THEN 'ValueError: no tile for option ' || option END AS error, coverage_pct, far_proxy FROM p LEFT JOIN m ON option % 10 != 0 AND m.tile_id = option % 8
""", cells=True)
def stub_space(spark, sf_dir):
    """The whole grid through a stub model that picks a tile of the pool and fails for every tenth option, and the
    readings of the tiles."""
    from ..operators.metrics import tile_metrics
    from ..sources.cells import SIDE, full_cells

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        bad = batch.loc[batch["option"] % 10 == 0, "option"]
        if len(bad):
            raise ValueError(f"no tile for option {bad.iloc[0]}")
        return batch.assign(tile_id=batch["option"] % 8, error=None)

    columns = "coverage double, height double, green double, seed double, option bigint, name string, tile_id int, error string"
    made = space.generate(_options(spark), model, columns)
    read = tile_metrics(full_cells(spark, sf_dir), 400.0, SIDE).select("tile_id", "coverage_pct", "far_proxy")
    return made.join(read, "tile_id", "left")
