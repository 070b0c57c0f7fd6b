"""Flooding, necks and small plateaus; SQL goes one link, or one region, at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, regions, tiles_np
from ..session import written
from ..sources.cells import SIDE, full_cells
from .catalog import CELLS_SQL, query
from .q_codec import _MAJORITY

_LAND = "cls != 'street'"

# distance of land to the nearest street, to thousandths, and the peaks that floods start from
_FLOOD = f"""
WITH RECURSIVE {CELLS_SQL}, m AS (SELECT tile_id, r, c, r * 32 + c + 1 AS i FROM full_cells WHERE {_LAND}),
d AS MATERIALIZED (SELECT m.tile_id, m.r, m.c, m.i, CAST(round(1000 * min(sqrt(pow(m.r - f.r, 2) + pow(m.c - f.c, 2)))) AS BIGINT) AS value FROM m JOIN full_cells f ON f.tile_id = m.tile_id AND f.cls = 'street' GROUP BY ALL),
x AS (SELECT d.tile_id, d.r, d.c, d.i, d.value, max(n.value) AS top FROM d JOIN d n ON n.tile_id = d.tile_id AND abs(n.r - d.r) <= 2 AND abs(n.c - d.c) <= 2 GROUP BY ALL),
p AS (SELECT * FROM x WHERE value >= top - 300 AND value >= 1200),
pe AS (SELECT a.tile_id, a.i AS a, b.i AS b FROM p a JOIN p b ON a.tile_id = b.tile_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
pw AS (SELECT tile_id, i AS a, i AS b FROM p UNION SELECT w.tile_id, w.a, e.b FROM pw w JOIN pe e ON e.tile_id = w.tile_id AND e.a = w.b),
mk AS (SELECT tile_id, a AS i, min(b) AS label FROM pw GROUP BY ALL),
e AS (SELECT x.tile_id, x.i AS a, y.i AS b, row_number() OVER (PARTITION BY x.tile_id ORDER BY least(x.value, y.value) DESC, x.i, y.i) AS k FROM d x JOIN d y ON x.tile_id = y.tile_id AND ((x.r = y.r AND y.c = x.c + 1) OR (x.c = y.c AND y.r = x.r + 1))),
n AS (SELECT tile_id, i, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY i) AS INT) AS pos FROM d),
ep AS MATERIALIZED (SELECT e.tile_id, CAST(e.k AS INT) AS k, x.pos AS pa, y.pos AS pb FROM e JOIN n x ON x.tile_id = e.tile_id AND x.i = e.a JOIN n y ON y.tile_id = e.tile_id AND y.i = e.b),
s AS (SELECT tile_id, 0 AS k, list(CAST(coalesce(-mk.label, d.i) AS INT) ORDER BY d.i) AS trees FROM d LEFT JOIN mk USING (tile_id, i) GROUP BY 1
  UNION ALL SELECT tile_id, k, CASE WHEN ta = tb OR (ta < 0 AND tb < 0) THEN trees ELSE list_transform(trees, lambda t: CASE WHEN t = greatest(ta, tb) THEN least(ta, tb) ELSE t END) END
    FROM (SELECT s.tile_id, ep.k, trees, trees[pa] AS ta, trees[pb] AS tb FROM s JOIN ep ON ep.tile_id = s.tile_id AND ep.k = s.k + 1)),
last AS (SELECT tile_id, arg_max(trees, k) AS trees FROM s GROUP BY 1),
z AS (SELECT n.tile_id, n.i, trees[pos] AS tree FROM n JOIN last USING (tile_id)),
fl AS MATERIALIZED (SELECT d.tile_id, d.r, d.c, d.value, CASE WHEN tree < 0 THEN -tree END AS label FROM z JOIN d USING (tile_id, i))
"""


def _land(spark, sf_dir):
    """Land flooded from its peaks of distance to a street."""
    grid = written(full_cells(spark, sf_dir).select("tile_id", "r", "c", "cls"), "flood-cells")
    near = tiles_np.nearest(grid, F.col("cls") == "street", SIDE).withColumn("value", F.round(1000 * F.sqrt(F.pow(F.col("r") - F.col("nr"), 2) + F.pow(F.col("c") - F.col("nc"), 2))).cast("long"))
    land = written(grid.where(_LAND).select("tile_id", "r", "c").join(near.select("tile_id", "r", "c", "value"), ["tile_id", "r", "c"]), "flood-land")
    peaks = land.join(_highest(land, 2), ["tile_id", "r", "c"]).where("value >= top - 300 AND value >= 1200")
    marks = tiles_np.components(peaks.withColumn("on", F.lit(True)), F.col("on"), True, SIDE).select("tile_id", "r", "c", "label")
    return regions.flood(land, marks, SIDE).join(land, ["tile_id", "r", "c"])


def _highest(cells, reach):
    """The highest value of cells in a square around each."""
    o = F.sequence(F.lit(-reach), F.lit(reach))
    near = cells.select("tile_id", "r", "c", "value", F.explode(o).alias("a")).select("tile_id", (F.col("r") + F.col("a")).alias("r"), "c", "value", F.explode(o).alias("b"))
    return near.groupBy("tile_id", "r", (F.col("c") + F.col("b")).alias("c")).agg(F.max("value").alias("top"))


@query("flood_regions", _FLOOD + "SELECT tile_id, r, c, CAST(label AS BIGINT) AS label FROM fl")
def flood_regions(spark, sf_dir):
    """Land by the peak that floods it first, highest distances from streets first; null where there is no peak."""
    return _land(spark, sf_dir).select("tile_id", "r", "c", "label")



@query("neck_regions", _FLOOD + """,
rg AS (SELECT * FROM fl WHERE label IS NOT NULL),
pk AS (SELECT tile_id, label, max(value) AS peak FROM rg GROUP BY 1, 2),
nk AS (SELECT x.tile_id, x.label AS a, y.label AS b, max(greatest(x.value, y.value)) AS neck FROM rg x JOIN rg y ON x.tile_id = y.tile_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1 AND x.label != y.label GROUP BY ALL),
wd AS (SELECT nk.tile_id, a, b FROM nk JOIN pk p ON p.tile_id = nk.tile_id AND p.label = a JOIN pk q ON q.tile_id = nk.tile_id AND q.label = b WHERE neck >= 0.75 * least(p.peak, q.peak)),
jn AS (SELECT tile_id, label AS a, label AS b FROM pk UNION SELECT jn.tile_id, jn.a, wd.b FROM jn JOIN wd ON wd.tile_id = jn.tile_id AND wd.a = jn.b),
to_ AS MATERIALIZED (SELECT tile_id, a AS label, min(b) AS part FROM jn GROUP BY 1, 2),
st AS (SELECT tile_id, 0 AS k, r, c, part, false AS done FROM rg JOIN to_ USING (tile_id, label)
  UNION ALL (WITH now AS (SELECT * FROM st), sz AS (SELECT tile_id, part, count(*) AS n FROM now GROUP BY 1, 2),
    bd AS (SELECT x.tile_id, x.part AS a, y.part AS b, count(*) AS n FROM now x JOIN now y ON x.tile_id = y.tile_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1 AND x.part != y.part GROUP BY ALL),
    go AS (SELECT DISTINCT ON (tile_id) sz.tile_id, sz.part FROM sz JOIN bd ON bd.tile_id = sz.tile_id AND bd.a = sz.part WHERE sz.n < 6 ORDER BY sz.tile_id, sz.n, sz.part),
    pk2 AS (SELECT go.tile_id, go.part, arg_max(b, (n, -b)) AS into_ FROM go JOIN bd ON bd.tile_id = go.tile_id AND bd.a = go.part GROUP BY ALL)
    SELECT now.tile_id, k + 1, r, c, CASE WHEN now.part = pk2.part THEN into_ ELSE now.part END, false FROM now JOIN pk2 ON pk2.tile_id = now.tile_id))
SELECT tile_id, r, c, CAST(part AS BIGINT) AS label FROM st QUALIFY k = max(k) OVER (PARTITION BY tile_id)
""")
def neck_regions(spark, sf_dir):
    """Flooded land without borders that are no necks, and without parts of under six cells that have a neighbour."""
    parts = regions.merge_necks(written(_land(spark, sf_dir).where("label IS NOT NULL"), "flooded"), 0.75, SIDE)
    return regions.absorb(written(parts, "necks"), 6, SIDE).select("tile_id", "r", "c", "label")


@query("absorbed_plateaus", f"""
WITH RECURSIVE {CELLS_SQL}, q AS (SELECT tile_id, r, c, CAST(round_even(h / 12.0, 0) AS INT) AS b FROM full_cells WHERE cls = 'building'),
{_MAJORITY.format(out='m1', from_='q')}, {_MAJORITY.format(out='m2', from_='m1')},
pe AS (SELECT x.tile_id, x.r * 32 + x.c + 1 AS a, y.r * 32 + y.c + 1 AS b FROM m2 x JOIN m2 y ON x.tile_id = y.tile_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1 AND x.b = y.b),
pw AS (SELECT tile_id, r * 32 + c + 1 AS a, r * 32 + c + 1 AS b FROM m2 UNION SELECT w.tile_id, w.a, e.b FROM pw w JOIN pe e ON e.tile_id = w.tile_id AND e.a = w.b),
rg AS (SELECT tile_id, a AS i, min(b) AS label FROM pw GROUP BY ALL),
st AS (SELECT rg.tile_id, 0 AS k, r, c, label AS part FROM rg JOIN m2 ON m2.tile_id = rg.tile_id AND m2.r * 32 + m2.c + 1 = rg.i
  UNION ALL (WITH now AS (SELECT * FROM st), sz AS (SELECT tile_id, part, count(*) AS n FROM now GROUP BY 1, 2),
    bd AS (SELECT x.tile_id, x.part AS a, y.part AS b, count(*) AS n FROM now x JOIN now y ON x.tile_id = y.tile_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1 AND x.part != y.part GROUP BY ALL),
    go AS (SELECT DISTINCT ON (tile_id) sz.tile_id, sz.part FROM sz JOIN bd ON bd.tile_id = sz.tile_id AND bd.a = sz.part WHERE sz.n < 4 ORDER BY sz.tile_id, sz.n, sz.part),
    pk2 AS (SELECT go.tile_id, go.part, arg_max(b, (n, -b)) AS into_ FROM go JOIN bd ON bd.tile_id = go.tile_id AND bd.a = go.part GROUP BY ALL)
    SELECT now.tile_id, k + 1, r, c, CASE WHEN now.part = pk2.part THEN into_ ELSE now.part END FROM now JOIN pk2 ON pk2.tile_id = now.tile_id)),
z AS (SELECT * FROM st QUALIFY k = max(k) OVER (PARTITION BY tile_id))
SELECT z.tile_id, CAST(part AS BIGINT) AS label, count(*) AS cells, CAST(m.b AS INT) AS plateau FROM z JOIN m2 m ON m.tile_id = z.tile_id AND m.r * 32 + m.c + 1 = z.part GROUP BY ALL
""")
def absorbed_plateaus(spark, sf_dir):
    """Plateaus of heights in steps of 12 m, those of under four cells taken in by the neighbour that they share most edges with."""
    b = full_cells(spark, sf_dir).where("cls = 'building'").select("tile_id", "r", "c", F.rint(F.col("h") / 12.0).cast("int").alias("plateau"))
    bins = written(codec.majority(codec.majority(b, "plateau"), "plateau"), "plateaus")
    whole = regions.absorb(written(regions.same_value_regions(bins, "plateau", SIDE), "plateau-regions"), 4, SIDE)
    own = bins.select("tile_id", (F.col("r") * SIDE + F.col("c") + 1).cast("long").alias("label"), F.col("plateau").alias("_own"))
    return whole.groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("cells")).join(own, ["tile_id", "label"]).select("tile_id", "label", "cells", F.col("_own").alias("plateau"))
