"""Neighbourhood operators over the stand-in grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, tiles_np
from ..sources.cells import SIDE, cells, full_cells
from .catalog import query


def _on(spark, sf_dir, cls="building"):
    return full_cells(spark, sf_dir).withColumn("v", (F.col("cls") == cls).cast("int"))


@query("smooth3", """
SELECT tile_id, r, c, 0.25 * coalesce(lag(h) OVER w, 0) + 0.5 * h + 0.25 * coalesce(lead(h) OVER w, 0) AS h FROM full_cells WINDOW w AS (PARTITION BY tile_id, r ORDER BY c)
""", cells=True)
def smooth3(spark, sf_dir):
    return raster.smooth3(full_cells(spark, sf_dir), "h").select("tile_id", "r", "c", "h")


@query("box_blur", """
WITH a AS (SELECT tile_id, r, c, (coalesce(lag(h) OVER w, h) + h + coalesce(lead(h) OVER w, h)) / 3.0 AS h FROM full_cells WINDOW w AS (PARTITION BY tile_id, r ORDER BY c))
SELECT tile_id, r, c, round((coalesce(lag(h) OVER w, h) + h + coalesce(lead(h) OVER w, h)) / 3.0, 6) AS h FROM a WINDOW w AS (PARTITION BY tile_id, c ORDER BY r)
""", cells=True)
def box_blur(spark, sf_dir):
    return raster.box_blur(full_cells(spark, sf_dir), "h").select("tile_id", "r", "c", F.round("h", 6).alias("h"))


@query("box_open_close", """
WITH g AS (SELECT tile_id, r, c, CASE WHEN cls = 'building' THEN 1 ELSE 0 END AS v FROM full_cells),
n AS (SELECT a.i AS dr, b.i AS dc FROM range(-1, 2) a(i), range(-1, 2) b(i)),
d AS (SELECT g.tile_id, g.r, g.c, max(coalesce(k.v, 0)) AS v FROM g, n LEFT JOIN g k ON k.tile_id = g.tile_id AND k.r = g.r + dr AND k.c = g.c + dc GROUP BY ALL)
SELECT d.tile_id, d.r, d.c, CAST(min(coalesce(k.v, 0)) AS INT) AS v FROM d, n LEFT JOIN d k ON k.tile_id = d.tile_id AND k.r = d.r + dr AND k.c = d.c + dc GROUP BY ALL
""", cells=True)
def box_open_close(spark, sf_dir):
    """Closing by a 3 x 3 square."""
    return raster.open_close(_on(spark, sf_dir), "v", 0, 1, SIDE).select("tile_id", "r", "c", "v")


@query("row_strips", """
WITH m AS (SELECT tile_id, r, c, c - row_number() OVER (PARTITION BY tile_id, r ORDER BY c) AS i FROM full_cells WHERE cls = 'green')
SELECT tile_id, r, min(c) AS c0, max(c) AS c1 FROM m GROUP BY tile_id, r, i
""", cells=True)
def row_strips(spark, sf_dir):
    return raster.strips(full_cells(spark, sf_dir).where("cls = 'green'"))


@query("mask_iou", """
WITH a AS (SELECT r, c, tile_id, cls = 'building' AS x FROM full_cells)
SELECT a.tile_id, coalesce(count_if(a.x AND b.x) / nullif(count_if(a.x OR b.x), 0), 1.0) AS iou FROM a JOIN a b ON b.tile_id = (a.tile_id + 1) % 8 AND a.r = b.r AND a.c = b.c GROUP BY 1
""", cells=True)
def mask_iou(spark, sf_dir):
    """Each tile's buildings against the next tile's."""
    a = full_cells(spark, sf_dir).select("tile_id", "r", "c", (F.col("cls") == "building").alias("a"))
    b = a.select(((F.col("tile_id") + 7) % 8).alias("tile_id"), "r", "c", F.col("a").alias("b"))
    return a.join(b, ["tile_id", "r", "c"]).groupBy("tile_id").agg(raster.iou(F.col("a"), F.col("b")).alias("iou"))


@query("shift_search", """
WITH m AS (SELECT tile_id, r, c FROM full_cells WHERE cls = 'street'), d AS (SELECT CAST(i AS INT) AS i FROM range(-2, 3) t(i)),
s AS (SELECT m.tile_id, a.i AS dr, b.i AS dc, count(k.r) AS hit FROM m, d a, d b LEFT JOIN m k ON k.tile_id = (m.tile_id + 1) % 8 AND k.r = m.r + a.i AND k.c = m.c + b.i GROUP BY ALL)
SELECT tile_id, dr, dc, hit FROM s QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY hit DESC, dr, dc) = 1
""", cells=True)
def shift_search(spark, sf_dir):
    """The offset at which each tile's streets meet most of the next tile's."""
    m = full_cells(spark, sf_dir).where("cls = 'street'").select("tile_id", "r", "c")
    other = m.select(((F.col("tile_id") + 7) % 8).alias("tile_id"), "r", "c")
    hits = raster.shifts(m, 2).join(other, ["tile_id", "r", "c"]).groupBy("tile_id", "dr", "dc").agg(F.count(F.lit(1)).alias("hit"))
    best = hits.groupBy("tile_id").agg(F.min(F.struct((-F.col("hit")).alias("n"), "dr", "dc")).alias("b"))
    return best.select("tile_id", "b.dr", "b.dc", (-F.col("b.n")).alias("hit"))


@query("supersample_down", """
SELECT tile_id, CAST(r // 2 AS INT) AS r, CAST(c // 2 AS INT) AS c, avg(CASE WHEN cls = 'building' THEN 1 ELSE 0 END) AS share, max(h) AS top,
  round(avg(h) FILTER (cls = 'building'), 6) AS mean FROM full_cells GROUP BY 1, 2, 3
""", cells=True)
def supersample_down(spark, sf_dir):
    return raster.downsample(full_cells(spark, sf_dir), 2)


@query("adjacency_strength", """
WITH p AS (SELECT a.tile_id, least(a.cls, b.cls) AS a, greatest(a.cls, b.cls) AS b, least(a.h, b.h) AS s FROM full_cells a JOIN full_cells b
  ON a.tile_id = b.tile_id AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)) WHERE a.cls != b.cls)
SELECT tile_id, a, b, count(*) AS edges, max(s) AS strength FROM p GROUP BY ALL
""", cells=True)
def adjacency_strength(spark, sf_dir):
    return raster.adjacency(full_cells(spark, sf_dir), "cls", "h")


@query("boundary_edges", """
WITH m AS (SELECT tile_id, r, c FROM full_cells WHERE cls = 'building'),
e AS (SELECT tile_id, r, c, 'c' AS along FROM m UNION ALL SELECT tile_id, r + 1, c, 'c' FROM m UNION ALL SELECT tile_id, r, c, 'r' FROM m UNION ALL SELECT tile_id, r, c + 1, 'r' FROM m)
SELECT tile_id, r, c, along FROM e GROUP BY ALL HAVING count(*) = 1
""", cells=True)
def boundary_edges(spark, sf_dir):
    return raster.boundary_edges(full_cells(spark, sf_dir).where("cls = 'building'"))


_HOLE = "r BETWEEN 8 AND 23 AND c BETWEEN 6 AND 25"


@query("hole_metrics", f"""
WITH b AS (SELECT DISTINCT x.tile_id, x.r, x.c FROM full_cells x JOIN full_cells y ON x.tile_id = y.tile_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 WHERE y.cls != 'building'),
t AS (SELECT f.*, b.r IS NOT NULL AS edge FROM full_cells f LEFT JOIN b USING (tile_id, r, c))
SELECT tile_id, round(count_if(cls = 'building') / count(*), 6) AS coverage, round(count_if(cls = 'green') / count(*), 6) AS green,
  round(count_if(cls = 'street') / count(*), 6) AS street, round(coalesce(avg(h) FILTER (cls = 'building'), 0), 6) AS mean_height_m,
  round(coalesce(sum(h) FILTER (cls = 'building'), 0) / (3.0 * count(*)), 6) AS far,
  round(coalesce(4.0 * count_if(cls = 'building') * 12.5 / nullif(count_if(cls = 'building' AND edge), 0), 0), 6) AS building_size_m
FROM t WHERE {_HOLE} GROUP BY 1
""", cells=True)
def hole_metrics(spark, sf_dir):
    return raster.hole_metrics(full_cells(spark, sf_dir), F.expr(_HOLE), 12.5)


@query("soft_hole_metrics", f"""
WITH s AS (SELECT tile_id, h, 1 / (1 + exp(-12.0 * ((v % 100) / 50.0 - 1))) AS s FROM classed WHERE {_HOLE})
SELECT tile_id, round(100.0 * avg(s), 6) AS coverage_pct, round(sum(s * h) / sum(s), 6) AS mean_height_m FROM s GROUP BY 1
""", cells=True)
def soft_hole_metrics(spark, sf_dir):
    t = cells(spark, sf_dir).where(_HOLE)
    return raster.soft_coverage(t, (F.col("v") % 100) / 50.0 - 1)


_REACH = """
WITH RECURSIVE {cells}, m AS (SELECT tile_id, r, c, r * 32 + c + 1 AS i FROM full_cells WHERE cls = '{cls}'),
e AS (SELECT a.tile_id, a.i AS a, b.i AS b FROM m a JOIN m b ON a.tile_id = b.tile_id AND {near}),
w AS (SELECT tile_id, i AS a, i AS b FROM m UNION SELECT w.tile_id, w.a, e.b FROM w JOIN e ON e.tile_id = w.tile_id AND e.a = w.b)
SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL
"""


def _reach(cls: str, near: str) -> str:
    from .catalog import CELLS_SQL

    return _REACH.format(cells=CELLS_SQL, cls=cls, near=near)


@query("components4", _reach("building", "abs(a.r - b.r) + abs(a.c - b.c) = 1"))
def components4(spark, sf_dir):
    return tiles_np.components(full_cells(spark, sf_dir), F.col("cls") == "building", False, SIDE)


@query("components8", _reach("green", "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"))
def components8(spark, sf_dir):
    return tiles_np.components(full_cells(spark, sf_dir), F.col("cls") == "green", True, SIDE)


@query("signed_distance", """
WITH g AS (SELECT tile_id, r, c, cls = 'building' AS b FROM full_cells),
d AS (SELECT x.tile_id, x.r, x.c, x.b, min(sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2))) FILTER (x.b != y.b) AS d FROM g x JOIN g y ON x.tile_id = y.tile_id GROUP BY ALL)
SELECT tile_id, r, c, round(CASE WHEN d IS NULL THEN CASE WHEN b THEN 8.0 ELSE -8.0 END WHEN b THEN least(8.0, d - 0.5) ELSE greatest(-8.0, 0.5 - d) END, 6) AS distance FROM d
""", cells=True)
def signed_distance(spark, sf_dir):
    out = tiles_np.distances(full_cells(spark, sf_dir), F.col("cls") == "building", SIDE)
    return out.withColumn("distance", F.round("distance", 6))


@query("axis_vote", """
WITH b AS (SELECT tile_id, r, c, cls = 'building' AS b FROM full_cells),
d AS (SELECT x.tile_id, x.r, x.c, x.b, min(sqrt(pow(x.r - y.r, 2) + pow(x.c - y.c, 2))) FILTER (x.b != y.b) AS d FROM b x JOIN b y ON x.tile_id = y.tile_id GROUP BY ALL),
f AS (SELECT tile_id, r, c, CASE WHEN d IS NULL THEN CASE WHEN b THEN 8.0 ELSE -8.0 END WHEN b THEN least(8.0, d - 0.5) ELSE greatest(-8.0, 0.5 - d) END AS h FROM d),
g AS (SELECT tile_id, h, CASE WHEN lag(h) OVER a IS NULL THEN lead(h) OVER a - h WHEN lead(h) OVER a IS NULL THEN h - lag(h) OVER a ELSE (lead(h) OVER a - lag(h) OVER a) / 2.0 END AS gr,
  CASE WHEN lag(h) OVER b IS NULL THEN lead(h) OVER b - h WHEN lead(h) OVER b IS NULL THEN h - lag(h) OVER b ELSE (lead(h) OVER b - lag(h) OVER b) / 2.0 END AS gc
  FROM f WINDOW a AS (PARTITION BY tile_id, c ORDER BY r), b AS (PARTITION BY tile_id, r ORDER BY c)),
s AS (SELECT tile_id, sum(sqrt(gr * gr + gc * gc) * sin(4 * atan2(gr, gc))) AS s, sum(sqrt(gr * gr + gc * gc) * cos(4 * atan2(gr, gc))) AS c, sum(sqrt(gr * gr + gc * gc)) AS w, count(*) AS votes
  FROM g WHERE abs(h) < 1.5 AND sqrt(gr * gr + gc * gc) > 0.25 GROUP BY 1)
SELECT tile_id, CASE WHEN votes >= 6 THEN round(atan2(round(s, 6), round(c, 6)) / 4, 5) ELSE 0.0 END AS axis, CASE WHEN votes >= 6 THEN round(sqrt(s * s + c * c) / w, 6) ELSE 0.0 END AS confidence, votes FROM s
""", cells=True)
def axis_vote(spark, sf_dir):
    """Edges of buildings, through their signed distance field."""
    field = tiles_np.distances(full_cells(spark, sf_dir), F.col("cls") == "building", SIDE)
    return raster.axis_vote(field, "distance")


@query("dihedral8", """
WITH t AS (SELECT tile_id, k, r, CASE WHEN k >= 4 THEN 31 - c ELSE c END AS c, h FROM full_cells, range(8) q(k) WHERE cls = 'building')
SELECT tile_id, CAST(k AS INT) AS k, CASE k % 4 WHEN 0 THEN r WHEN 1 THEN 31 - c WHEN 2 THEN 31 - r ELSE c END AS r,
  CASE k % 4 WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 31 - c ELSE 31 - r END AS c, h FROM t
""", cells=True)
def dihedral8(spark, sf_dir):
    return raster.dihedral(full_cells(spark, sf_dir).where("cls = 'building'").select("tile_id", "r", "c", "h"), SIDE)


@query("padded_crop", """
SELECT t.i AS tile_id, CAST(a.i AS INT) AS r, CAST(b.i AS INT) AS c, coalesce(h, -1) AS h FROM range(8) t(i), range(24) a(i), range(24) b(i)
LEFT JOIN full_cells f ON f.tile_id = t.i AND f.r = a.i - 6 AND f.c = b.i + 20
""", cells=True)
def padded_crop(spark, sf_dir):
    out = raster.padded_crop(full_cells(spark, sf_dir), -6, 20, 24, "h", -1)
    return out.select(F.col("tile_id").cast("long").alias("tile_id"), "r", "c", "h")


@query("bilinear_samples", """
WITH p AS (SELECT CAST(event_id % 8 AS INT) AS tile_id, event_id AS p, (event_id * 37 % 3100) / 100.0 AS x, (event_id * 53 % 3100) / 100.0 AS y FROM events),
k AS (SELECT p.*, floor(x) + a.i AS c, floor(y) + b.i AS r FROM p, range(2) a(i), range(2) b(i)),
w AS (SELECT *, (1 - abs(x - c)) * (1 - abs(y - r)) AS w FROM k)
SELECT w.tile_id, p, round(sum(w * h) / sum(w), 6) AS h FROM w JOIN full_cells f ON f.tile_id = w.tile_id AND f.r = w.r AND f.c = w.c WHERE w > 0 GROUP BY 1, 2
""", cells=True)
def bilinear_samples(spark, sf_dir):
    from ..session import table

    i = F.col("event_id")
    points = table(spark, sf_dir, "events").select(
        (i % 8).cast("int").alias("tile_id"), i.alias("p"), ((i * 37 % 3100) / 100.0).alias("x"), ((i * 53 % 3100) / 100.0).alias("y")
    )
    return raster.bilinear(points, full_cells(spark, sf_dir), "h")


@query("tile_metrics_full", None)
def tile_metrics_full(spark, sf_dir):
    """All metrics of each tile: aggregates, components, street lines, blocks."""
    from ..operators.metrics import tile_metrics

    from ..session import written

    grid = written(full_cells(spark, sf_dir), "grid")  # read by the aggregates and by the grouped map
    return tile_metrics(grid, 400.0, SIDE).join(tiles_np.tile_facts(grid, 400.0 / SIDE, SIDE), "tile_id", "left")
