"""Street-graph queries: graphs of thin cells, split loops, trimmed edges, simplified lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, planar, regions
from ..session import table, written
from ..sources.cells import SIDE, full_cells
from .catalog import CELLS_SQL, query
from .q_vector import _RINGS, _rings

_LINES = "(r % 5 = 2 OR c % 5 = 3) AND (cls = 'street' OR (r * 7 + c * 3 + tile_id) % 9 < 6)"


def _lines(spark, sf_dir):
    """Broken lines of cells on every fifth row and column."""
    return written(full_cells(spark, sf_dir).where(_LINES).select("tile_id", "r", "c"), "thin")


_GRAPH = f"""
WITH RECURSIVE {CELLS_SQL}, m AS (SELECT tile_id, r, c, r * 32 + c + 1 AS i FROM full_cells WHERE {_LINES}),
nb AS (SELECT a.tile_id, a.i AS a, b.i AS b FROM m a JOIN m b ON a.tile_id = b.tile_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.i != b.i),
d AS (SELECT m.*, count(nb.b) AS n FROM m LEFT JOIN nb ON nb.tile_id = m.tile_id AND nb.a = m.i GROUP BY ALL),
same AS (SELECT nb.* FROM nb JOIN d x ON x.tile_id = nb.tile_id AND x.i = nb.a JOIN d y ON y.tile_id = nb.tile_id AND y.i = nb.b WHERE (x.n >= 3) = (y.n >= 3)),
w AS (SELECT tile_id, i AS a, i AS b FROM d UNION SELECT w.tile_id, w.a, same.b FROM w JOIN same ON same.tile_id = w.tile_id AND same.a = w.b),
l AS (SELECT d.tile_id, d.r, d.c, d.i, d.n >= 3 AS junction, min(w.b) AS label FROM d JOIN w ON w.tile_id = d.tile_id AND w.a = d.i GROUP BY ALL)"""


@query("graph_nodes", _GRAPH + """
SELECT tile_id, CAST(label AS INT) AS node, round(avg(c) + 0.5, 6) AS x, round(avg(r) + 0.5, 6) AS y, count(*) AS cells FROM l WHERE junction GROUP BY 1, 2
""")
def graph_nodes(spark, sf_dir):
    """Junctions: cells with three neighbours or more, those that touch taken together."""
    nodes, _, cells = graph.skeleton_parts(_lines(spark, sf_dir), SIDE)
    count = cells.groupBy("tile_id", "node").agg(F.count(F.lit(1)).alias("cells"))
    return nodes.join(count, ["tile_id", "node"]).select("tile_id", "node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cells")


_EDGES = _GRAPH + """,
e AS (SELECT l.tile_id, l.label AS path, l.i, count(s.b) AS k FROM l LEFT JOIN same s ON s.tile_id = l.tile_id AND s.a = l.i WHERE NOT junction GROUP BY ALL),
p AS (SELECT tile_id, path, count(*) AS n, min(i) FILTER (k <= 1) AS s, max(i) FILTER (k <= 1) AS t, min(i) AS low FROM e GROUP BY ALL),
q AS (SELECT p.tile_id, path, n, coalesce(s, low) AS s, coalesce(t, (SELECT arg_max(b, (abs((b - 1) // 32 - (p.low - 1) // 32) + abs((b - 1) % 32 - (p.low - 1) % 32)) * 4096 + b) FROM same WHERE same.tile_id = p.tile_id AND same.a = p.low)) AS t FROM p),
j AS (SELECT nb.tile_id, nb.a AS i, list_sort(list(DISTINCT l.label)) AS js FROM nb JOIN l ON l.tile_id = nb.tile_id AND l.i = nb.b WHERE l.junction GROUP BY ALL),
z AS (SELECT q.*, coalesce(x.js[1], s - 1 + 1024) AS a, coalesce(y.js, []) AS js FROM q LEFT JOIN j x ON x.tile_id = q.tile_id AND x.i = q.s LEFT JOIN j y ON y.tile_id = q.tile_id AND y.i = q.t),
ed AS (SELECT tile_id, CAST(path AS INT) AS edge, CAST(a AS INT) AS a, CAST(coalesce(list_filter(js, lambda g: g != a)[1], CASE WHEN n > 1 THEN js[1] END, t - 1 + CASE WHEN n = 1 THEN 2048 ELSE 1024 END) AS INT) AS b, CAST(n AS INT) AS points FROM z)
"""


@query("graph_edges", _EDGES + "SELECT * FROM ed")
def graph_edges(spark, sf_dir):
    """The paths between junctions and free ends, with the points of each in order."""
    nodes, paths, cells = graph.skeleton_parts(_lines(spark, sf_dir), SIDE)
    _, edges = graph.skeleton_edges(nodes, paths, cells, SIDE)
    return edges.select("tile_id", "edge", "a", "b", F.size("points").alias("points"))


@query("graph_loops", f"""
WITH {_RINGS}, o AS (SELECT * FROM rings WHERE seq = 0), d AS (SELECT rings.id, rings.place, rings.seq, sqrt(pow(rings.x - o.x, 2) + pow(rings.y - o.y, 2)) AS d, rings.x, rings.y FROM rings JOIN o USING (id) WHERE rings.seq > 0),
f AS (SELECT id, place, arg_max(seq, (round(d, 9), -seq)) AS k, max(d) AS d FROM d GROUP BY 1, 2)
SELECT CAST(place AS INT) AS tile_id, CAST(id * 2 + h AS INT) AS edge, CAST(CASE WHEN h = 0 THEN id ELSE -id END AS INT) AS a, CAST(CASE WHEN h = 0 THEN -id ELSE id END AS INT) AS b, CAST(CASE WHEN h = 0 THEN k - 1 ELSE 3 - k END AS INT) AS points
FROM f, range(2) x(h) WHERE d >= 12
""")
def graph_loops(spark, sf_dir):
    """Customers' rings as loops at their first corner, split at the farthest one; small ones go."""
    t = _rings(spark, sf_dir).select(F.col("place").cast("int").alias("tile_id"), F.col("id").cast("int").alias("edge"), F.col("seq").cast("int").alias("seq"), "x", "y")
    nodes = t.where("seq = 0").select("tile_id", F.col("edge").alias("node"), "x", "y")
    points = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    edges = t.where("seq > 0").groupBy("tile_id", "edge").agg(points.alias("points"))  # three points a ring
    edges = edges.select("tile_id", "edge", F.col("edge").alias("a"), F.col("edge").alias("b"), "points")
    _, out = graph.split_loops(nodes, edges, 12.0)
    return out.select("tile_id", "edge", "a", "b", F.size("points").alias("points"))


@query("graph_trim", """
WITH e AS (SELECT CAST(l_orderkey % 8 AS INT) AS tile_id, CAST(l_orderkey * 10 + l_linenumber AS INT) AS edge, CAST(l_partkey AS INT) AS a, CAST(l_suppkey + 100000 AS INT) AS b, l_extendedprice AS length FROM lineitem WHERE l_quantity < 9),
n AS (SELECT tile_id, node, count(*) AS d FROM (SELECT tile_id, a AS node FROM e UNION ALL SELECT tile_id, b FROM e) GROUP BY 1, 2)
SELECT e.tile_id, edge, length FROM e JOIN n x ON x.tile_id = e.tile_id AND x.node = a JOIN n y ON y.tile_id = e.tile_id AND y.node = b
WHERE NOT ((x.d = 1 AND y.d = 1 AND length < 9000) OR ((x.d = 1) != (y.d = 1) AND length < 5000))
""")
def graph_trim(spark, sf_dir):
    """Lines of orders as edges of a graph: one round without short spurs and short edges that stand alone."""
    i = F.col("l_orderkey")
    e = table(spark, sf_dir, "lineitem").where("l_quantity < 9").select(
        (i % 8).cast("int").alias("tile_id"), (i * 10 + F.col("l_linenumber")).cast("int").alias("edge"), F.col("l_partkey").cast("int").alias("a"),
        (F.col("l_suppkey") + 100000).cast("int").alias("b"), F.col("l_extendedprice").alias("length"), F.array().cast(graph.POINTS).alias("points"),
    )
    return graph.trimmed(e, 5000.0, 9000.0, 0.0).select("tile_id", "edge", "length")


@query("line_simplify", """
WITH RECURSIVE p AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq, event_id, value AS y FROM events),
k AS (SELECT user_id, seq, CAST(seq AS DOUBLE) AS x, y FROM p),
s AS (SELECT user_id, min(seq) AS i, max(seq) AS j FROM k GROUP BY 1
  UNION ALL SELECT user_id, CASE WHEN h.h = 0 THEN i ELSE m END, CASE WHEN h.h = 0 THEN m ELSE j END FROM (
    SELECT s.user_id, i, j, arg_max(q.seq, (round(abs((b.x - a.x) * (a.y - q.y) - (b.y - a.y) * (a.x - q.x)) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 9), -q.seq)) AS m,
      max(round(abs((b.x - a.x) * (a.y - q.y) - (b.y - a.y) * (a.x - q.x)) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 9)) AS d
    FROM s JOIN k a ON a.user_id = s.user_id AND a.seq = i JOIN k b ON b.user_id = s.user_id AND b.seq = j JOIN k q ON q.user_id = s.user_id AND q.seq > i AND q.seq < j GROUP BY s.user_id, i, j), range(2) h(h) WHERE d > 6.0)
SELECT DISTINCT user_id, unnest([i, j]) AS seq FROM s
""")
def line_simplify(spark, sf_dir):
    """Users' values over time as lines, without points nearer than six to a chord."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    t = table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), seq.cast("double").alias("x"), F.col("value").alias("y"))
    return graph.simplified(t, ["user_id"], 6.0).select("user_id", "seq")


_NET = "cls IN ('street', 'open')"
_FACES = f"""
WITH RECURSIVE {CELLS_SQL}, m AS (SELECT tile_id, r, c, r * 32 + c + 1 AS i FROM full_cells WHERE {_NET}),
h AS (SELECT x.tile_id, x.i AS a, y.i AS b, x.c AS ax, x.r AS ay, y.c AS bx, y.r AS "by", CAST(x.i AS BIGINT) * 2147483648 + y.i AS id, atan2(y.r - x.r, y.c - x.c) AS angle
  FROM m x JOIN m y ON x.tile_id = y.tile_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1),
o AS (SELECT *, coalesce(lag(id) OVER (PARTITION BY tile_id, a ORDER BY angle), last_value(id) OVER (PARTITION BY tile_id, a ORDER BY angle ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev FROM h),
nx AS MATERIALIZED (SELECT tile_id, CAST(b AS BIGINT) * 2147483648 + a AS id, prev AS nxt FROM o),
k AS (SELECT tile_id, id AS start, id AS here, 0 AS seq FROM nx UNION ALL SELECT k.tile_id, k.start, nx.nxt, k.seq + 1 FROM k JOIN nx ON nx.tile_id = k.tile_id AND nx.id = k.here WHERE nx.nxt != k.start AND k.start <= nx.nxt),
w AS (SELECT k.tile_id, k.start FROM k JOIN nx ON nx.tile_id = k.tile_id AND nx.id = k.here WHERE nx.nxt = k.start),
f AS MATERIALIZED (SELECT k.tile_id, k.start AS face, h.a, h.b, h.ax * h."by" - h.bx * h.ay AS cross_ FROM k JOIN w USING (tile_id, start) JOIN h ON h.tile_id = k.tile_id AND h.id = k.here),
fa AS MATERIALIZED (SELECT tile_id, face, count(*) AS edges, sum(cross_) / 2 AS area FROM f GROUP BY 1, 2)
"""


def _net(spark, sf_dir):
    """Open ground as a planar graph: its cells and the links between those that share an edge."""
    cells = written(full_cells(spark, sf_dir).where(_NET).select("tile_id", "r", "c"), "net")
    nodes = cells.select("tile_id", (F.col("r") * SIDE + F.col("c") + 1).cast("long").alias("node"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return nodes, written(regions.cell_links(cells, SIDE), "net-links")


@query("graph_faces", _FACES + "SELECT tile_id, face, edges, CAST(area AS DOUBLE) AS area FROM fa")
def graph_faces(spark, sf_dir):
    """The faces of the open ground's graph, with their lengths and areas; what lies around has areas of 0 and below."""
    t = planar.faces(*_net(spark, sf_dir))
    return t.groupBy("tile_id", "face").agg(F.count(F.lit(1)).alias("edges"), F.max("area").alias("area"))


@query("collapsed_faces", _FACES + """,
e1 AS MATERIALIZED (SELECT f.tile_id, a, b FROM f JOIN fa USING (tile_id, face) WHERE area > 0 AND area < 3),
e AS MATERIALIZED (SELECT * FROM e1 UNION SELECT tile_id, b, a FROM e1),
j AS (SELECT tile_id, i AS a, i AS b FROM m UNION SELECT j.tile_id, j.a, e.b FROM j JOIN e ON e.tile_id = j.tile_id AND e.a = j.b),
t AS (SELECT tile_id, a AS i, min(b) AS label FROM j GROUP BY 1, 2),
g AS (SELECT t.tile_id, label AS node, round(avg(c), 6) AS x, round(avg(r), 6) AS y, count(*) AS nodes FROM t JOIN m USING (tile_id, i) GROUP BY 1, 2),
q AS (SELECT DISTINCT h.tile_id, x.label AS a, y.label AS b FROM h JOIN t x ON x.tile_id = h.tile_id AND x.i = h.a JOIN t y ON y.tile_id = h.tile_id AND y.i = h.b WHERE x.label != y.label)
SELECT g.tile_id, CAST(node AS BIGINT) AS node, x, y, nodes, count(q.b) AS edges FROM g LEFT JOIN q ON q.tile_id = g.tile_id AND q.a = g.node GROUP BY ALL
""")
def collapsed_faces(spark, sf_dir):
    """The open ground's graph with faces of under three cells drawn together, and how many edges each node has left."""
    nodes, edges = planar.collapsed(*_net(spark, sf_dir), 3.0)
    degree = regions.both_ways(edges).groupBy("tile_id", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    t = nodes.join(degree, ["tile_id", "node"], "left")
    return t.select("tile_id", "node", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


_RUNS = _EDGES + """,
sm AS (SELECT tile_id, label AS path, count(*) AS n, CAST(sum(c) AS DOUBLE) AS x, CAST(sum(r) AS DOUBLE) AS y, CAST(sum(c * c) AS DOUBLE) AS xx, CAST(sum(r * r) AS DOUBLE) AS yy, CAST(sum(c * r) AS DOUBLE) AS xy FROM l WHERE NOT junction GROUP BY 1, 2),
sp AS (SELECT *, n * xx - x * x AS va, n * yy - y * y AS vb, n * xy - x * y AS vc FROM sm),
rn AS (SELECT tile_id, path, n, x / n AS cx, y / n AS cy, atan2(2 * vc, va - vb) / 2 AS angle, sqrt(greatest((va + vb - sqrt(pow(va - vb, 2) + 4 * vc * vc)) / 2, 0.0)) / n AS rms FROM sp),
ax AS (SELECT tile_id, round(atan2(round(sum(n * sin(4 * angle)), 6), round(sum(n * cos(4 * angle)), 6)) / 4, 9) AS axis FROM rn GROUP BY 1),
of_ AS (SELECT rn.*, axis, angle - axis - round_even(round((angle - axis) / (pi() / 2), 9), 0) * (pi() / 2) AS off FROM rn JOIN ax USING (tile_id)),
sn AS (SELECT *, CASE WHEN n >= 2 AND abs(off) < radians(12) THEN angle - off ELSE angle END AS turned FROM of_)
"""


def _runs(spark, sf_dir):
    nodes, paths, cells = graph.skeleton_parts(_lines(spark, sf_dir), SIDE)
    fitted = planar.straight_runs(paths.select("tile_id", "path", F.col("c").alias("x"), F.col("r").alias("y")), ["tile_id", "path"])
    return nodes, paths, cells, planar.snapped(fitted, 12.0)


@query("straight_runs", _RUNS + "SELECT tile_id, CAST(path AS INT) AS path, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(turned, 6) AS angle, round(rms, 6) AS rms, round(axis, 6) AS axis FROM sn")
def straight_runs(spark, sf_dir):
    """The line through each path of the street graph, turned onto the tile's main direction where it nearly lies on it."""
    *_, runs = _runs(spark, sf_dir)
    return runs.select("tile_id", "path", "n", *[F.round(v, 6).alias(v) for v in ("cx", "cy", "angle", "rms", "axis")])


@query("placed_nodes", _RUNS + """,
ic AS (SELECT tile_id, node, sn.n, cx + 0.5 AS cx, cy + 0.5 AS cy, turned AS angle FROM (SELECT tile_id, edge, a AS node FROM ed UNION ALL SELECT tile_id, edge, b FROM ed) u JOIN sn USING (tile_id) WHERE sn.path = u.edge),
sx AS (SELECT tile_id, node, sum(w * nx * nx) AS aa, sum(w * nx * ny) AS ab, sum(w * ny * ny) AS bb, sum(w * nx * (nx * cx + ny * cy)) AS p, sum(w * ny * (nx * cx + ny * cy)) AS q, 0.08 * sum(w) + 1e-6 AS l
  FROM (SELECT *, -sin(angle) AS nx, cos(angle) AS ny, least(CAST(n AS DOUBLE), 20.0) AS w FROM ic) v GROUP BY 1, 2),
nd AS (SELECT tile_id, label AS node, avg(c) + 0.5 AS x, avg(r) + 0.5 AS y FROM l WHERE junction GROUP BY 1, 2),
mv AS (SELECT nd.*, ((p + l * x) * (bb + l) - (q + l * y) * ab) / ((aa + l) * (bb + l) - ab * ab) - x AS dx, ((q + l * y) * (aa + l) - (p + l * x) * ab) / ((aa + l) * (bb + l) - ab * ab) - y AS dy FROM nd LEFT JOIN sx USING (tile_id, node))
SELECT tile_id, CAST(node AS INT) AS node, round(x + coalesce(dx * least(1.0, 1.5 / nullif(sqrt(dx * dx + dy * dy), 0)), 0), 5) AS x, round(y + coalesce(dy * least(1.0, 1.5 / nullif(sqrt(dx * dx + dy * dy), 0)), 0), 5) AS y FROM mv
""")
def placed_nodes(spark, sf_dir):
    """Junctions moved to where the straight runs that end there meet best, by at most 1.5 cells."""
    nodes, paths, cells, runs = _runs(spark, sf_dir)
    _, edges = graph.skeleton_edges(nodes, paths, cells, SIDE)
    ends = edges.select("tile_id", F.col("edge").alias("path"), F.explode(F.array("a", "b")).alias("node"))
    incident = ends.join(runs, ["tile_id", "path"]).select("tile_id", "node", "n", (F.col("cx") + 0.5).alias("cx"), (F.col("cy") + 0.5).alias("cy"), "angle")
    out = planar.placed(nodes, incident, 1.5)
    return out.select("tile_id", "node", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))
