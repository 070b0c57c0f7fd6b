"""Queries over requests, crops, names and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, requests
from ..session import table
from ..sources.cells import SIDE, full_cells
from .catalog import query

_OPTIONS = "map_from_entries([('axis', p_brand), ('hstep_m', CAST(p_size AS VARCHAR)), ('secret', 'x'), (CASE WHEN p_partkey % 2 = 0 THEN 'max_gap_m' ELSE 'colour' END, CAST(p_partkey % 9 AS VARCHAR))])"


def _options(spark, sf_dir):
    k = F.col("p_partkey")
    keys = F.array(F.lit("axis"), F.lit("hstep_m"), F.lit("secret"), F.when(k % 2 == 0, "max_gap_m").otherwise("colour"))
    values = F.array("p_brand", F.col("p_size").cast("string"), F.lit("x"), (k % 9).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.map_from_arrays(keys, values).alias("options"))


@query("option_whitelist", f"""
SELECT p_partkey, array_to_string(list_transform(list_filter(map_entries({_OPTIONS}), lambda e: e.key IN ('axis', 'hstep_m', 'max_gap_m')), lambda e: e.key || '=' || e.value), ';') AS kept FROM part
""")
def option_whitelist(spark, sf_dir):
    kept = requests.whitelisted(F.col("options"), ["axis", "hstep_m", "max_gap_m"])
    text = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _options(spark, sf_dir).select("p_partkey", text.alias("kept"))


@query("option_overlay", """
SELECT p_partkey, 'axis=' || p_brand || ';hstep_m=' || p_size || ';max_gap_m=' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 9 AS VARCHAR) ELSE '40' END || ';secret=x'
  || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ';colour=' || p_partkey % 9 END AS options FROM part
""")
def option_overlay(spark, sf_dir):
    """Options over defaults: a key that both have takes the later value."""
    base = F.create_map(*map(F.lit, ["axis", "auto", "hstep_m", "3", "max_gap_m", "40"]))
    laid = requests.overlay(base, F.col("options"))
    text = F.array_join(F.transform(F.map_entries(laid), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _options(spark, sf_dir).select("p_partkey", text.alias("options"))


@query("public_columns", "SELECT p_partkey, p_name FROM part")
def public_columns(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").alias("_size"), F.col("p_brand").alias("engine"))
    return requests.public(t, ["engine"])


@query("unknown_metrics", """
SELECT DISTINCT n AS name FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'coverage_pct' WHEN 1 THEN 'far_proxy' WHEN 2 THEN 'beauty' WHEN 3 THEN 'gfa_m2' WHEN 4 THEN 'noise_' || p_size % 3 ELSE 'mean_height_m' END AS n FROM part)
WHERE n NOT IN ('coverage_pct', 'far_proxy', 'gfa_m2', 'mean_height_m')
""")
def unknown_metrics(spark, sf_dir):
    """Metrics asked for that aren't registered."""
    k = F.col("p_partkey") % 6
    n = F.when(k == 0, "coverage_pct").when(k == 1, "far_proxy").when(k == 2, "beauty").when(k == 3, "gfa_m2").when(k == 4, F.concat(F.lit("noise_"), (F.col("p_size") % 3).cast("string"))).otherwise("mean_height_m")
    known = spark.createDataFrame([(x,) for x in metrics.REGISTRY], "name string")
    return requests.unknown_names(table(spark, sf_dir, "part").select(n.alias("name")), known, "name")


@query("registered_metrics", """
SELECT tile_id, round(100.0 * avg(CASE WHEN cls = 'building' THEN 1 ELSE 0 END), 2) AS coverage_pct, round(100.0 * avg(CASE WHEN cls = 'green' THEN 1 ELSE 0 END), 2) AS green_pct,
  round(coalesce(sum(h) FILTER (cls = 'building'), 0) / (3.0 * count(*)), 3) AS far_proxy FROM full_cells GROUP BY 1
""", cells=True)
def registered_metrics(spark, sf_dir):
    """Metrics by their registered names, to their registered places."""
    return metrics.measure(full_cells(spark, sf_dir), ["coverage_pct", "green_pct", "far_proxy"], 400.0, SIDE)


@query("request_clamps", """
SELECT event_id, greatest(1, least(50, event_id % 90 - 10)) AS steps, CASE WHEN event_id % 11 > 0 THEN greatest(0.0, least(0.9, value / 80.0)) END AS strength FROM events
""")
def request_clamps(spark, sf_dir):
    i = F.col("event_id")
    strength = F.when(i % 11 > 0, F.col("value") / 80.0)
    return table(spark, sf_dir, "events").select("event_id", requests.clamped(i % 90 - 10, 1, 50).alias("steps"), requests.clamped(strength, 0.0, 0.9).alias("strength"))


@query("axis_columns", """
SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'target_coverage' WHEN 1 THEN 'dir_height' WHEN 2 THEN 'pca' || p_size % 3 ELSE 'seed' END AS column_name FROM part
""")
def axis_columns(spark, sf_dir):
    k = F.col("p_partkey") % 4
    axis = F.when(k == 0, "target:coverage").when(k == 1, "dir:height").when(k == 2, F.concat(F.lit("pca"), (F.col("p_size") % 3).cast("string"))).otherwise("seed")
    return table(spark, sf_dir, "part").select(requests.axis_column(axis).alias("column_name")).distinct()


@query("option_cap", """
SELECT user_id, event_id, greatest(0, n - 4) AS beyond FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= 4
""")
def option_cap(spark, sf_dir):
    """The first four options of each run, and how many the cap leaves out."""
    return requests.capped(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 4)


@query("listed_names", """
WITH n AS (SELECT DISTINCT c_mktsegment AS segment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey), k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n_name) AS k, count(*) OVER (PARTITION BY segment) AS n FROM n)
SELECT segment, string_agg(n_name, ', ' ORDER BY n_name) FILTER (k <= 20) || CASE WHEN max(n) > 20 THEN ' (+' || max(n) - 20 || ' more)' ELSE '' END AS names FROM k GROUP BY 1
""")
def listed_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return requests.listed(c.select(F.col("c_mktsegment").alias("segment"), "n_name").distinct(), "segment", "n_name", 20)


@query("report_lines", """
SELECT lpad(n_name, 16, ' ') || '  ' || lpad(CAST(count(*) AS VARCHAR), 6, ' ') || '  ' || lpad(printf('%.1f', round(100.0 * count_if(c_acctbal < 0) / count(*), 1)), 5, ' ') || ' %' AS line
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name
""")
def report_lines(spark, sf_dir):
    """A fixed-width report line for each nation."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = c.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("c_acctbal") < 0) / F.count(F.lit(1)), 1).alias("p"))
    cell = lambda x, w: F.lpad(x, w, " ")
    return t.select(F.concat(cell(F.col("n_name"), 16), F.lit("  "), cell(F.col("n").cast("string"), 6), F.lit("  "), cell(F.format_string("%.1f", "p"), 5), F.lit(" %")).alias("line"))


@query("border_margin", "SELECT tile_id, cls, count(*) AS n FROM full_cells WHERE r BETWEEN 5 AND 26 AND c BETWEEN 5 AND 26 GROUP BY 1, 2", cells=True)
def border_margin(spark, sf_dir):
    """Cells at least five from a tile's border."""
    from ..operators import masks

    return masks.interior(full_cells(spark, sf_dir), 5, SIDE).groupBy("tile_id", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("crop_content", """
WITH k AS (SELECT event_id AS crop, CAST(event_id % 8 AS INT) AS tile_id, event_id * 7 % 24 AS r0, event_id * 11 % 24 AS c0 FROM events),
s AS (SELECT k.tile_id, crop, avg(CASE WHEN cls != 'open' THEN 1 ELSE 0 END) AS content FROM k JOIN full_cells f ON f.tile_id = k.tile_id AND r >= r0 AND r < r0 + 8 AND c >= c0 AND c < c0 + 8 GROUP BY 1, 2),
n AS (SELECT *, content >= 0.7 AS good, count(*) FILTER (content >= 0.7) OVER (PARTITION BY tile_id) AS n, row_number() OVER (PARTITION BY tile_id, content >= 0.7 ORDER BY crop) AS i FROM s)
SELECT tile_id, crop, content, NOT good AS filled_in FROM n WHERE good OR i <= 6 - n
""", cells=True)
def crop_content(spark, sf_dir):
    """Crops with enough in them; a tile with fewer than six gets its first others. Crops of one place share its content, so
    what meets the cells, and is broadcast, is at most 24 x 24 places a tile."""
    i = F.col("event_id")
    rows = F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))
    k = table(spark, sf_dir, "events").select(i.alias("crop"), (i % 8).cast("int").alias("tile_id"), (i * 7 % 24).alias("r0"), (i * 11 % 24).alias("c0")).distinct()
    at = ["tile_id", "r0", "c0"]
    places = k.select(*at).distinct().withColumn("a", F.explode(rows)).withColumn("b", F.explode(rows))
    places = places.select(*at, (F.col("r0") + F.col("a")).cast("int").alias("r"), (F.col("c0") + F.col("b")).cast("int").alias("c"))
    content = places.join(full_cells(spark, sf_dir), ["tile_id", "r", "c"]).groupBy(*at).agg(F.avg((F.col("cls") != "open").cast("int")).alias("content"))
    t = k.join(F.broadcast(content), at).select("tile_id", "crop", "content")
    return requests.with_fallback(t, "tile_id", F.col("content") >= 0.7, ["crop"], 6)


@query("ramps", """
SELECT event_id, i AS step, round(0.001 * least(1.0, (i + 1) / 40.0), 9) AS warm_up, round(0.1 * (0.5 - 0.5 * cos(pi() * least(1.0, (1 - p) / 0.25))) * least(1.0, p / 0.05 + 1e-6), 9) AS rate,
  round(0.05 * pow(greatest(0.0, 1 - p / 0.75), 2), 9) AS noise FROM (SELECT event_id, event_id % 200 AS i, event_id % 200 / 199.0 AS p FROM events)
""")
def ramps(spark, sf_dir):
    rate, noise = requests.projector_ramp(F.col("p"), 0.1)
    step = F.col("event_id") % 200
    t = table(spark, sf_dir, "events").select("event_id", step.alias("step"), (step / 199.0).alias("p"))
    return t.select("event_id", "step", F.round(requests.warm_up(F.col("step"), 0.001, 40), 9).alias("warm_up"), F.round(rate, 9).alias("rate"), F.round(noise, 9).alias("noise"))


@query("class_spread", """
WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS place FROM embeddings),
m AS (SELECT label, place, avg(x) AS mean, var_pop(x) AS v FROM e GROUP BY 1, 2)
SELECT label, CAST(place AS INT) AS place, round(mean, 5) AS mean, round(sqrt(sum(v) OVER (PARTITION BY label)), 5) AS spread FROM m
""")
def class_spread(spark, sf_dir):
    t = requests.class_spread(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return t.select("label", "place", F.round("mean", 5).alias("mean"), F.round("spread", 5).alias("spread"))


@query("quad_split", """
WITH p AS (SELECT CAST(c_nationkey AS BIGINT) AS box, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 1000 AS DOUBLE) AS y FROM customer),
q AS (SELECT *, CAST(CAST(x >= 500 AS INT) + 2 * CAST(y >= 500 AS INT) AS VARCHAR) AS a, CAST(CAST(x % 500 >= 250 AS INT) + 2 * CAST(y % 500 >= 250 AS INT) AS VARCHAR) AS b FROM p),
l0 AS (SELECT CAST(n_nationkey AS BIGINT) AS box, '' AS path, count(q.box) AS load FROM nation LEFT JOIN q ON q.box = n_nationkey GROUP BY 1),
l1 AS (SELECT l0.box, CAST(k.i AS VARCHAR) AS path, count(q.box) AS load FROM l0, range(4) k(i) LEFT JOIN q ON q.box = l0.box AND q.a = CAST(k.i AS VARCHAR) WHERE l0.load > 5 GROUP BY 1, 2),
l2 AS (SELECT l1.box, l1.path || k.i AS path, count(q.box) AS load FROM l1, range(4) k(i) LEFT JOIN q ON q.box = l1.box AND q.a || q.b = l1.path || k.i WHERE l1.load > 5 GROUP BY 1, 2)
SELECT box, path, load FROM l0 WHERE load <= 5 UNION ALL SELECT * FROM l1 WHERE load <= 5 UNION ALL SELECT * FROM l2
""")
def quad_split(spark, sf_dir):
    """Boxes with more than five points split in four, twice at most."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("box"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 1000).cast("double").alias("y"))
    zero, side = F.lit(0.0), F.lit(1000.0)
    boxes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("box"), zero.alias("x0"), zero.alias("y0"), side.alias("x1"), side.alias("y1"))
    return requests.quad_boxes(boxes, points, 5).select("box", "path", "load")
