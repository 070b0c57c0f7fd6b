"""Form, view shares, projection, crossings, mask algebra, progress and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection
from ..operators import metrics, raster, solar, tiles_np, vector
from ..session import table
from ..sources.cells import SIDE, full_cells
from .catalog import query
from .q_raster import _reach
from .q_solar import _RAYS

_LAST = "SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL"


@query("form_metrics", _reach("building", "abs(a.r - b.r) + abs(a.c - b.c) = 1").replace(_LAST, """,
l AS (SELECT m.tile_id, count(DISTINCT x.label) AS n FROM m JOIN (SELECT w.tile_id, w.a, min(w.b) AS label FROM w GROUP BY ALL) x ON x.tile_id = m.tile_id AND x.a = m.i GROUP BY 1),
b AS (SELECT * FROM full_cells WHERE cls = 'building'),
s AS (SELECT a.tile_id, a.h, 4 - count(k.r) AS walls FROM b a LEFT JOIN b k ON k.tile_id = a.tile_id AND abs(k.r - a.r) + abs(k.c - a.c) = 1 AND k.h = a.h GROUP BY a.tile_id, a.r, a.c, a.h),
f AS (SELECT tile_id, count(*) AS foot, sum(greatest(1.0, round_even(h / 3.0, 0))) AS floors, sum(walls * h) AS walls FROM s GROUP BY 1)
SELECT CAST(t.i AS INT) AS tile_id, round(coalesce(floors, 0) / 1024, 3) AS far, round(coalesce(floors, 0) * 156.25, 1) AS gfa_m2, round(100.0 * coalesce(foot, 0) / 1024, 2) AS coverage_pct,
  round(coalesce((1024 - foot) / floors, 0), 3) AS open_space_ratio, round(coalesce(walls, 0) * 12.5, 1) AS facade_area_m2, round(coalesce(walls * 12.5 / (floors * 156.25), 0), 3) AS facade_to_floor,
  coalesce(n, 0) AS building_count, round(coalesce(foot * 156.25 / n, 0), 1) AS mean_footprint_m2 FROM range(8) t(i) LEFT JOIN f ON f.tile_id = t.i LEFT JOIN l ON l.tile_id = t.i
"""))
def form_metrics(spark, sf_dir):
    grid = full_cells(spark, sf_dir)
    return metrics.form_metrics(grid, tiles_np.components(grid, F.col("cls") == "building", False, SIDE), 400.0, SIDE)


@query("view_shares", """
WITH e AS (SELECT tile_id, r * 32 + c AS eye, r, c, h + 1.6 AS z, h FROM full_cells WHERE cls = 'building' AND h > 0),
d AS (SELECT * FROM (VALUES (0, 0, 1, 0.0), (1, 1, 0, 0.3), (2, 1, 1, -0.2), (3, -1, 0, 0.1)) v(ray, dr, dc, rise)),
k AS (SELECT e.tile_id, eye, ray, r + i * dr AS r, c + i * dc AS c, sqrt(dr * dr + dc * dc) * 12.5 * i AS far, z + sqrt(dr * dr + dc * dc) * 12.5 * i * rise AS lvl FROM e, d, range(1, 21) t(i)),
m AS (SELECT k.tile_id, eye, ray, arg_min(CASE WHEN h > 0.5 THEN 'building' ELSE cls END, far) AS sees, min(far) AS far FROM k JOIN full_cells f ON f.tile_id = k.tile_id AND f.r = k.r AND f.c = k.c
  WHERE (lvl <= h OR lvl <= 0) AND far <= 250 GROUP BY ALL),
a AS (SELECT e.tile_id, coalesce(sees, CASE WHEN rise > 0 THEN 'sky' ELSE 'open' END) AS sees, round(far, 6) AS far, e.h * (4 - d.ray) * 0.1 AS w FROM e CROSS JOIN d LEFT JOIN m ON m.tile_id = e.tile_id AND m.eye = e.eye AND m.ray = d.ray)
SELECT tile_id, round(100.0 * sum(CASE WHEN sees = 'sky' THEN w ELSE 0 END) / sum(w), 4) AS view_sky_pct, round(100.0 * sum(CASE WHEN sees = 'building' THEN w ELSE 0 END) / sum(w), 4) AS view_building_pct,
  round(100.0 * sum(CASE WHEN sees = 'green' THEN w ELSE 0 END) / sum(w), 4) AS view_green_pct, round(100.0 * sum(CASE WHEN sees = 'street' THEN w ELSE 0 END) / sum(w), 4) AS view_street_pct,
  round(100.0 * sum(CASE WHEN sees = 'open' THEN w ELSE 0 END) / sum(w), 4) AS view_open_pct, round(100.0 * sum(CASE WHEN sees = 'building' AND far <= 25 THEN w ELSE 0 END) / sum(w), 4) AS view_overlooked_pct,
  round(sum(w * far) / sum(w) FILTER (far IS NOT NULL), 4) AS view_obstruction_m FROM a GROUP BY 1
""", cells=True)
def view_shares(spark, sf_dir):
    """What walls look at, weighted by height and ray, on whole views."""
    grid = full_cells(spark, sf_dir)
    eyes = grid.where("cls = 'building' and h > 0").select("tile_id", (F.col("r") * 32 + F.col("c")).alias("eye"), "r", "c", (F.col("h") + 1.6).alias("z"), "h")
    hits = solar.first_hit(eyes.drop("h"), grid, _RAYS, 12.5).join(eyes.select("tile_id", "eye", "h"), ["tile_id", "eye"])
    return solar.view_shares(hits.withColumn("w", F.col("h") * (4 - F.col("ray")) * 0.1), "w")


_TM = """p AS (SELECT c_custkey, (c_custkey * 37 % 1600) / 10.0 - 80 AS lat, (c_custkey * 53 % 3600) / 10.0 - 180 AS lon FROM customer),
z AS (SELECT *, CAST(floor((lon + 180) / 6) % 60 + 1 AS INT) AS zone, (1 / 298.257223563) / (2 - 1 / 298.257223563) AS n FROM p),
t AS (SELECT *, radians(lon) - radians(zone * 6 - 183) AS d, sinh(atanh(sin(radians(lat))) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(radians(lat)))) AS t, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) * 0.9996 AS k FROM z),
q AS (SELECT *, atan2(t, cos(d)) AS x, atanh(sin(d) / sqrt(1 + t * t)) AS e, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 AS a, 13 * n * n / 48 - 3 * pow(n, 3) / 5 AS b, 61 * pow(n, 3) / 240 AS c FROM t)"""


@query("transverse_mercator", f"""
WITH {_TM}
SELECT c_custkey, zone, round(500000 + k * (e + a * cos(2 * x) * sinh(2 * e) + b * cos(4 * x) * sinh(4 * e) + c * cos(6 * x) * sinh(6 * e)), 3) AS east,
  round(k * (x + a * sin(2 * x) * cosh(2 * e) + b * sin(4 * x) * cosh(4 * e) + c * sin(6 * x) * cosh(6 * e)), 3) AS north, round(lat, 6) AS lat, round(lon, 6) AS lon FROM q
""")
def transverse_mercator(spark, sf_dir):
    """Places to metres in their zone, and back to degrees."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 1600) / 10.0 - 80).alias("lat"), ((k * 53 % 3600) / 10.0 - 180).alias("lon"))
    t = t.withColumn("zone", projection.zone(F.col("lon")))
    east, north = projection.forward(F.col("lat"), F.col("lon"), F.col("zone"))
    t = t.select("c_custkey", "zone", east.alias("east"), north.alias("north"))
    lat, lon = projection.inverse(F.col("east"), F.col("north"), F.col("zone"))
    return t.select("c_custkey", "zone", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_BOW = """pts AS (SELECT c_custkey AS id, CAST(i AS INT) AS seq, CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 10.0 WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE 10.0 END ELSE CASE WHEN c_custkey % 3 = 0 THEN 10.0 ELSE 0.0 END END AS x,
  CASE WHEN i < 2 THEN 0.0 ELSE 5.0 + c_custkey % 4 END AS y FROM customer, range(4) k(i)),
seg AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM pts WINDOW w AS (PARTITION BY id ORDER BY seq))"""


@query("ring_crossings", f"""
WITH {_BOW}, o AS (SELECT a.id, (a.x2 - a.x) * (b.y - a.y) - (a.y2 - a.y) * (b.x - a.x) AS p, (a.x2 - a.x) * (b.y2 - a.y) - (a.y2 - a.y) * (b.x2 - a.x) AS q,
  (b.x2 - b.x) * (a.y - b.y) - (b.y2 - b.y) * (a.x - b.x) AS r, (b.x2 - b.x) * (a.y2 - b.y) - (b.y2 - b.y) * (a.x2 - b.x) AS s FROM seg a JOIN seg b ON a.id = b.id AND a.seq < b.seq)
SELECT id, count(*) AS crossings FROM o WHERE p * q < 0 AND r * s < 0 GROUP BY 1
""")
def ring_crossings(spark, sf_dir):
    """Rings that cross themselves, and how often."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq"))
    bow, i = F.col("id") % 3 == 0, F.col("seq")
    x = F.when(i == 0, 0.0).when(i == 1, 10.0).when(i == 2, F.when(bow, 0.0).otherwise(10.0)).otherwise(F.when(bow, 10.0).otherwise(0.0))
    t = t.select("id", "seq", x.alias("x"), F.when(i < 2, 0.0).otherwise(5.0 + F.col("id") % 4).alias("y"))
    return vector.self_crossings(t, ["id"])


@query("cross_dilation", """
SELECT f.tile_id, f.r, f.c, CAST(max(CASE WHEN g.cls = 'green' THEN 1 ELSE 0 END) AS INT) AS v FROM full_cells f JOIN full_cells g ON g.tile_id = f.tile_id AND abs(g.r - f.r) + abs(g.c - f.c) <= 1 GROUP BY ALL
""", cells=True)
def cross_dilation(spark, sf_dir):
    """Greens widened by the four cells beside each."""
    t = full_cells(spark, sf_dir).withColumn("v", (F.col("cls") == "green").cast("int"))
    return raster.dilate_cross(t, "v").select("tile_id", "r", "c", "v")


@query("mask_algebra", """
WITH t AS (SELECT tile_id, r, c, cls = 'building' AS a, r BETWEEN 8 AND 20 AND c BETWEEN 5 AND 25 AS b FROM full_cells)
SELECT tile_id, count_if(a OR b) AS union_, count_if(a AND b) AS both, count_if(a AND NOT b) AS only_a, count_if(NOT a) AS rest FROM t GROUP BY 1
""", cells=True)
def mask_algebra(spark, sf_dir):
    """Two masks as sets of cells: what is in either, in both, in the first alone, and in neither first."""
    grid = full_cells(spark, sf_dir)
    cells = ["tile_id", "r", "c"]
    a, b, all_ = grid.where("cls = 'building'").select(cells), grid.where("r between 8 and 20 and c between 5 and 25").select(cells), grid.select(cells)
    sets = {"union_": a.union(b).distinct(), "both": a.intersect(b), "only_a": a.exceptAll(b), "rest": all_.exceptAll(a)}
    out = None
    for name, s in sets.items():
        one = s.select("tile_id", F.lit(name).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tile_id").agg(*[F.count_if(F.col("k") == n).alias(n) for n in sets])


@query("two_discoveries", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def two_discoveries(spark, sf_dir):
    """Names found in either of two places, each once."""
    n = table(spark, sf_dir, "nation")
    a = n.join(table(spark, sf_dir, "customer").where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    b = n.join(table(spark, sf_dir, "supplier").where("s_acctbal > 8000"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return a.select(F.col("n_name").alias("name")).union(b.select("n_name")).distinct()


@query("progress_eta", """
WITH t AS (SELECT event_type, count(*) AS n, count_if(value < 60) AS done, sum(value) FILTER (value < 60) AS seconds FROM events GROUP BY 1)
SELECT event_type, n AS total, done, round(100.0 * done / n, 4) AS done_pct, round(done / seconds, 6) AS rate, round((n - done) * seconds / done, 2) AS eta FROM t WHERE done > 0
""")
def progress_eta(spark, sf_dir):
    """How far runs have come, their rate, and the time that is left at it."""
    done = F.col("value") < 60
    t = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"), F.sum(F.when(done, F.col("value"))).alias("s")).where("done > 0")
    return t.select("event_type", "total", "done", F.round(100.0 * F.col("done") / F.col("total"), 4).alias("done_pct"), F.round(F.col("done") / F.col("s"), 6).alias("rate"), F.round((F.col("total") - F.col("done")) * F.col("s") / F.col("done"), 2).alias("eta"))


@query("weighted_loss", """
SELECT l_returnflag, round(sum(pow(l_quantity - 25, 2) * l_discount) / sum(l_discount), 6) AS loss, round(avg(pow(l_quantity - 25, 2)) FILTER (l_orderkey % 10 = 0), 6) AS validation FROM lineitem GROUP BY 1
""")
def weighted_loss(spark, sf_dir):
    """Squared errors weighted row by row, and their plain mean over held-out rows."""
    e, w = F.pow(F.col("l_quantity") - 25, F.lit(2.0)), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(e * w) / F.sum(w), 6).alias("loss"), F.round(F.avg(F.when(F.col("l_orderkey") % 10 == 0, e)), 6).alias("validation")
    )


@query("json_requests", """
SELECT p_partkey, p_size AS steps, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS strength, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS keys FROM part
""")
def json_requests(spark, sf_dir):
    """Requests as JSON text, parsed with keys that may be missing."""
    even = F.col("p_partkey") % 2 == 0
    text = F.to_json(F.struct(F.col("p_size").alias("steps"), F.when(even, F.col("p_retailprice")).alias("strength")))
    t = table(spark, sf_dir, "part").select("p_partkey", text.alias("j"))
    r = F.from_json("j", "steps int, strength double")
    return t.select("p_partkey", r["steps"].alias("steps"), r["strength"].alias("strength"), F.size(F.json_object_keys("j")).alias("keys"))
