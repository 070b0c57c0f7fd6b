"""Vector queries: customers' rectangles as rings, events and lines as street graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector
from ..session import table
from .catalog import query

_RINGS = """rings AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS place, CAST(i AS INT) AS seq, x0 + CASE WHEN i IN (1, 2) THEN w ELSE 0 END AS x, y0 + CASE WHEN i >= 2 THEN d ELSE 0 END AS y, h
  FROM (SELECT *, c_custkey * 7 % 380.0 AS x0, c_custkey * 13 % 380.0 AS y0, 5.0 + c_custkey % 11 AS w, 5.0 + c_custkey % 7 AS d, 4.0 + c_custkey % 23 AS h FROM customer), range(4) k(i))"""


def _rings(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").cast("long").alias("place"), (k * 7 % 380).cast("double").alias("x0"), (k * 13 % 380).cast("double").alias("y0"),
        (5.0 + k % 11).alias("w"), (5.0 + k % 7).alias("d"), (4.0 + k % 23).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"),
    )
    i = F.col("seq")
    return t.select("id", "place", "seq", (F.col("x0") + F.when(i.isin(1, 2), F.col("w")).otherwise(0)).alias("x"), (F.col("y0") + F.when(i >= 2, F.col("d")).otherwise(0)).alias("y"), "h")


@query("ring_area", f"""
WITH {_RINGS}, s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY id ORDER BY seq))
SELECT id, round(sum(x * y2 - x2 * y) / 2, 6) AS area, round(sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))), 6) AS length FROM s GROUP BY 1
""")
def ring_area(spark, sf_dir):
    return vector.ring_facts(_rings(spark, sf_dir), ["id"])


@query("point_in_ring", f"""
WITH {_RINGS}, box AS (SELECT id, place, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM rings GROUP BY 1, 2),
p AS (SELECT s_suppkey AS p, CAST(s_nationkey AS BIGINT) AS place, s_suppkey * 31 % 390 + 0.37 AS px, s_suppkey * 17 % 390 + 0.53 AS py FROM supplier)
SELECT p.place, p, id FROM p JOIN box ON p.place = box.place AND px > xa AND px < xb AND py > ya AND py < yb
""")
def point_in_ring(spark, sf_dir):
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("p"), F.col("s_nationkey").cast("long").alias("place"), (k * 31 % 390 + 0.37).alias("px"), (k * 17 % 390 + 0.53).alias("py"))
    return vector.points_in_rings(points, _rings(spark, sf_dir), ["id"], "place")


@query("facade_samples", f"""
WITH {_RINGS}, s AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY id ORDER BY seq)),
l AS (SELECT *, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS len FROM s), n AS (SELECT *, greatest(1, CAST(ceil(round(len / 4.0, 9)) AS INT)) AS n, greatest(1, CAST(floor(h / 3.0) AS INT)) AS lv FROM l WHERE len > 0)
SELECT id, count(*) AS points, round(sum(len / n * h / lv), 4) AS area, round(sum(x + (x2 - x) * (i + 0.5) / n + (y2 - y) / len * 1.5), 4) AS sx, round(sum((j + 0.5) * h / lv), 4) AS sz
FROM n, range(4) a(i), range(10) b(j) WHERE i < n AND j < lv GROUP BY 1
""")
def facade_samples(spark, sf_dir):
    t = vector.facade_samples(_rings(spark, sf_dir), ["id"], "h", 4.0, 3.0, 1.5)
    return t.groupBy("id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("area"), 4).alias("area"), F.round(F.sum("px"), 4).alias("sx"), F.round(F.sum("pz"), 4).alias("sz"))


@query("clip_to_window", f"""
WITH {_RINGS}, box AS (SELECT id, greatest(min(x), 100.0) AS xa, least(max(x), 300.0) AS xb, greatest(min(y), 50.0) AS ya, least(max(y), 250.0) AS yb FROM rings GROUP BY 1)
SELECT id, round((xb - xa) * (yb - ya), 6) AS area FROM box WHERE xb > xa AND yb > ya
""")
def clip_to_window(spark, sf_dir):
    clipped = vector.clip_rows(_rings(spark, sf_dir).select("id", "seq", "x", "y"), ["id"], 100.0, 50.0, 300.0, 250.0)
    return vector.ring_facts(clipped, ["id"]).where("area > 0").select("id", "area")


@query("graph_degree", "SELECT node, count(*) AS degree FROM (SELECT user_id AS node FROM events UNION ALL SELECT event_id % 97 FROM events) GROUP BY 1")
def graph_degree(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 97).alias("other"))
    return vector.degrees(e, "user_id", "other")


@query("parallel_edge_dedupe", "SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, min(l_extendedprice) AS length, count(*) AS parallel FROM lineitem GROUP BY 1, 2")
def parallel_edge_dedupe(spark, sf_dir):
    return vector.shortest_parallel(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_extendedprice")


@query("nearest_segment", """
WITH p AS (SELECT c_custkey AS p, CAST(c_nationkey AS BIGINT) AS place, c_custkey * 7 % 380.0 AS px, c_custkey * 13 % 380.0 AS py FROM customer),
r AS (SELECT s_suppkey AS run, CAST(s_nationkey AS BIGINT) AS place, s_suppkey * 31 % 390.0 AS ax, s_suppkey * 17 % 390.0 AS ay, s_suppkey * 31 % 390.0 + 60 AS bx, s_suppkey * 17 % 390.0 + s_suppkey % 40 AS by_ FROM supplier),
u AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS u FROM p JOIN r USING (place)),
d AS (SELECT place, p, run, sqrt(pow(px - ax - u * (bx - ax), 2) + pow(py - ay - u * (by_ - ay), 2)) AS d FROM u)
SELECT place, p, run, round(d, 6) AS distance FROM d WHERE d <= 100 QUALIFY row_number() OVER (PARTITION BY place, p ORDER BY d, run) = 1
""")
def nearest_segment(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(k.alias("p"), F.col("c_nationkey").cast("long").alias("place"), (k * 7 % 380).cast("double").alias("px"), (k * 13 % 380).cast("double").alias("py"))
    ax, ay = (s * 31 % 390).cast("double"), (s * 17 % 390).cast("double")
    runs = table(spark, sf_dir, "supplier").select(s.alias("run"), F.col("s_nationkey").cast("long").alias("place"), ax.alias("ax"), ay.alias("ay"), (ax + 60).alias("bx"), (ay + s % 40).alias("by"))
    return vector.nearest_segment(points, runs, "place", 100.0)


@query("ring_geojson", f"""
WITH {_RINGS}, p AS (SELECT id, any_value(h) AS h, list('[' || x || ',' || y || ']' ORDER BY seq) AS p FROM rings GROUP BY 1)
SELECT id, '{{"type":"Feature","properties":{{"id":' || id || ',"h":' || h || '}},"geometry":{{"type":"Polygon","coordinates":[[' || array_to_string(list_append(p, p[1]), ',') || ']]}}}}' AS feature FROM p
""")
def ring_geojson(spark, sf_dir):
    return vector.geojson(_rings(spark, sf_dir), ["id"], ["id", "h"])


_DIAMONDS = """g AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS place, c_custkey * 7 % 380 + 10.3713 AS x, c_custkey * 13 % 380 + 9.2119 AS y, 6.0 + c_custkey % 11 AS w, 5.0 + c_custkey % 7 AS d, 4 + c_custkey % 23 AS h, c_custkey % 3 = 0 AS yard FROM customer)"""


def _diamonds(spark, sf_dir):
    """Customers as diamonds, every third with a yard in the middle, as rings."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").cast("long").alias("place"), (k * 7 % 380 + 10.3713).alias("x"), (k * 13 % 380 + 9.2119).alias("y"), (6.0 + k % 11).alias("w"), (5.0 + k % 7).alias("d"),
        (4 + k % 23).alias("h"), F.explode(F.when(k % 3 == 0, F.array(F.lit(1.0), F.lit(0.4))).otherwise(F.array(F.lit(1.0)))).alias("size"),
    )
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate([(-1, 0), (0, -1), (1, 0), (0, 1)])]))
    t = t.select("*", corners.alias("k")).withColumn("ring", (F.col("size") < 1).cast("int"))
    return t.select("place", "id", "ring", "k.seq", (F.col("x") + F.col("k.a") * F.col("w") * F.col("size")).alias("x"), (F.col("y") + F.col("k.b") * F.col("d") * F.col("size")).alias("y"), "h")


@query("scanline_cells", f"""
WITH {_DIAMONDS}, p AS (SELECT place, i AS line, j AS point, max(h) AS h FROM g, range(CAST(floor(y - d) AS INT), CAST(ceil(y + d) AS INT) + 1) a(i), range(CAST(floor(x - w) AS INT), CAST(ceil(x + w) AS INT) + 1) b(j)
  WHERE i BETWEEN 0 AND 399 AND j BETWEEN 0 AND 399 AND abs(j + 0.5 - x) / w + abs(i + 0.5 - y) / d < 1 AND NOT (yard AND abs(j + 0.5 - x) / w + abs(i + 0.5 - y) / d < 0.4) GROUP BY 1, 2, 3)
SELECT place, CAST(line // 4 AS INT) AS r, CAST(point // 4 AS INT) AS c, count(*) / 16.0 AS share, round(sum(h) / count(*), 6) AS h FROM p GROUP BY ALL
""")
def scanline_cells(spark, sf_dir):
    """Polygons with holes drawn onto cells of 4 m, each of 4 x 4 points; where they overlap the tallest wins."""
    from ..operators import scanline

    t = scanline.rasterise(_diamonds(spark, sf_dir), ["place"], "id", "h", 4.0, 100, 4)
    return t.select("place", "r", "c", "share", F.round("h", 6).alias("h"))
