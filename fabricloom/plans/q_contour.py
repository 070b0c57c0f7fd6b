"""Contours of built regions, with their loops walked edge by edge in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contour, tiles_np
from ..sources.cells import SIDE, full_cells
from .catalog import CELLS_SQL, query

_LOOPS = f"""
WITH RECURSIVE {CELLS_SQL}, m AS (SELECT tile_id, r, c, r * 32 + c + 1 AS i FROM full_cells WHERE cls = 'building'),
e AS (SELECT a.tile_id, a.i AS a, b.i AS b FROM m a JOIN m b ON a.tile_id = b.tile_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
w AS (SELECT tile_id, i AS a, i AS b FROM m UNION SELECT w.tile_id, w.a, e.b FROM w JOIN e ON e.tile_id = w.tile_id AND e.a = w.b),
l AS (SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL),
s AS (SELECT l.tile_id, l.label, d, l.c + x AS x, l.r + y AS y, l.c + x + dx AS x1, l.r + y + dy AS y1, ((l.r + y) * 33 + l.c + x) * 4 + d AS id
  FROM l, (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 0, 1, 1, 0), (2, 1, 1, -1, 0, 0, 1), (3, 0, 1, 0, -1, -1, 0)) v(d, x, y, dx, dy, nc, nr)
  LEFT JOIN l n ON n.tile_id = l.tile_id AND n.label = l.label AND n.r = l.r + nr AND n.c = l.c + nc WHERE n.r IS NULL),
nx AS (SELECT a.tile_id, a.label, a.id, arg_min(b.id, CASE (b.d - a.d + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS nxt, min(CASE (b.d - a.d + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) != 1 AS bends
  FROM s a JOIN s b ON a.tile_id = b.tile_id AND a.label = b.label AND b.x = a.x1 AND b.y = a.y1 GROUP BY ALL),
k AS (SELECT tile_id, label, id AS start, id AS here, 0 AS seq FROM nx
  UNION ALL SELECT k.tile_id, k.label, k.start, nx.nxt, k.seq + 1 FROM k JOIN nx ON nx.tile_id = k.tile_id AND nx.label = k.label AND nx.id = k.here WHERE nx.nxt != k.start),
f AS (SELECT tile_id, label, start, min(here) AS low FROM k GROUP BY ALL),
o AS (SELECT k.tile_id, k.label, k.start AS loop, k.seq, s.x, s.y, s.x1, s.y1, p.bends AS corner FROM k JOIN f USING (tile_id, label, start)
  JOIN s ON s.tile_id = k.tile_id AND s.label = k.label AND s.id = k.here JOIN nx p ON p.tile_id = k.tile_id AND p.label = k.label AND p.nxt = k.here WHERE f.low = k.start)
"""


def _loops(spark, sf_dir):
    labels = tiles_np.components(full_cells(spark, sf_dir), F.col("cls") == "building", False, SIDE)
    return contour.loops(labels.select("tile_id", "label", "r", "c"), SIDE)


@query("contour_loops", _LOOPS + "SELECT tile_id, label, CAST(loop AS BIGINT) AS loop, CAST(seq AS BIGINT) AS seq, x, y FROM o")
def contour_loops(spark, sf_dir):
    """The closed contours of every built region, point by point."""
    return _loops(spark, sf_dir).select("tile_id", "label", "loop", "seq", "x", "y")


@query("contour_facts", _LOOPS + """
SELECT tile_id, label, CAST(loop AS BIGINT) AS loop, count(*) AS edges, count_if(corner) AS corners, sum(x * y1 - x1 * y) / 2 AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1
FROM o GROUP BY tile_id, label, loop
""")
def contour_facts(spark, sf_dir):
    """Length, corners, area and box of each contour; holes have negative areas."""
    return contour.loop_facts(_loops(spark, sf_dir))


@query("contour_corners", _LOOPS + """
SELECT tile_id, label, CAST(loop AS BIGINT) AS loop, row_number() OVER (PARTITION BY tile_id, label, loop ORDER BY seq) - 1 AS seq, x, y FROM o WHERE corner
""")
def contour_corners(spark, sf_dir):
    """Contours without the points that lie between two others on a straight line."""
    from pyspark.sql import Window

    corners = _loops(spark, sf_dir).where("corner")
    seq = F.row_number().over(Window.partitionBy("tile_id", "label", "loop").orderBy("seq")).cast("long") - 1
    return corners.withColumn("seq", seq).select("tile_id", "label", "loop", "seq", "x", "y")
