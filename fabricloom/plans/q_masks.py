"""Mask queries over the stand-in grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, tiles_np
from ..sources.cells import SIDE, full_cells
from .catalog import query
from .q_raster import _reach


def _grow(first: str, steps: int) -> str:
    """SQL of so many flood passes by squares of two over a table with m and free, named f0, f1 and so on."""
    out = first
    for k in range(steps):
        out += f""",
w{k} AS (SELECT *, max(m) OVER (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM f{k}),
f{k + 1} AS (SELECT tile_id, r, c, cls, free, free * max(a) OVER (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM w{k})"""
    return out


@query("geodesic_flood", "WITH " + _grow("""f0 AS (SELECT tile_id, r, c, cls, CASE WHEN cls != 'street' THEN 1 ELSE 0 END AS free,
  CASE WHEN r = 16 AND c = 12 + tile_id AND cls != 'street' THEN 1 ELSE 0 END AS m FROM full_cells)""", 5) + """
SELECT tile_id, r, c, CAST(m AS INT) AS m FROM f5 WHERE m = 1
""", cells=True)
def geodesic_flood(spark, sf_dir):
    """What ten cells' growth reaches from a cell without crossing streets."""
    free = (F.col("cls") != "street").cast("int")
    t = full_cells(spark, sf_dir).withColumn("free", free).withColumn("m", F.expr("cast(r = 16 and c = 12 + tile_id and cls != 'street' as int)"))
    return masks.flood(t, "m", "free", 10, SIDE).where("m = 1").select("tile_id", "r", "c", "m")


@query("interior_clip", "SELECT tile_id, count(*) AS n, min(r) AS top, max(c) AS right_ FROM full_cells WHERE cls = 'green' AND r BETWEEN 6 AND 25 AND c BETWEEN 6 AND 25 GROUP BY 1", cells=True)
def interior_clip(spark, sf_dir):
    inside = masks.interior(full_cells(spark, sf_dir).where("cls = 'green'"), 6, SIDE)
    return inside.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("top"), F.max("c").alias("right_"))


@query("mask_fallback", """
WITH t AS (SELECT tile_id, r, c, CASE WHEN tile_id = 0 THEN 1 WHEN tile_id = 1 THEN 0 WHEN cls = 'green' THEN 1 ELSE 0 END AS m, CASE WHEN r BETWEEN 8 AND 20 AND c BETWEEN 8 AND 15 THEN 1 ELSE 0 END AS o FROM full_cells),
s AS (SELECT *, avg(m) OVER (PARTITION BY tile_id) AS s FROM t)
SELECT tile_id, CAST(sum(CASE WHEN s BETWEEN 0.004 AND 0.92 THEN m ELSE o END) AS BIGINT) AS n FROM s GROUP BY 1
""", cells=True)
def mask_fallback(spark, sf_dir):
    """Full and empty masks give way to a rectangle."""
    m = F.when(F.col("tile_id") == 0, 1).when(F.col("tile_id") == 1, 0).otherwise((F.col("cls") == "green").cast("int"))
    o = F.expr("cast(r between 8 and 20 and c between 8 and 15 as int)")
    t = masks.with_fallback(full_cells(spark, sf_dir).withColumns({"m": m, "o": o}), "m", "o")
    return t.groupBy("tile_id").agg(F.sum("m").alias("n"))


def _draw(what: str, below: str) -> str:
    return f"(CAST('0x' || substr(md5(tile_id || ':7:{what}'), 1, 8) AS BIGINT) % ({below}))"


def _rect(what: str, low: int, high: int) -> str:
    parts = []
    for axis in ("r", "c"):
        size = f"({low} + {_draw(f'{what}:{axis}:size', str(high - low + 1))})"
        first = f"(3 + {_draw(f'{what}:{axis}:first', '1048576')} % (32 - 6 - {size} + 1))"
        parts.append(f"{axis} >= {first} AND {axis} < {first} + {size}")
    return "(" + " AND ".join(parts) + ")"


@query("random_masks", "WITH " + _grow(f"""f0 AS (SELECT tile_id, r, c, cls, CASE WHEN cls != 'street' THEN 1 ELSE 0 END AS free,
  CASE WHEN cls != 'street' AND r = 3 + {_draw('seed:r', '26')} AND c = 3 + {_draw('seed:c', '26')} THEN 1 ELSE 0 END AS m FROM full_cells)""", 4) + f""",
k AS (SELECT *, {_draw('kind', '100')} AS roll, {_rect('a', 8, 16)} AS rect, {_rect('b', 4, 10)} AS other FROM f4),
q AS (SELECT *, CASE WHEN roll < 30 THEN 'rect' WHEN roll < 50 THEN 'multirect' WHEN roll < 70 THEN 'plots' ELSE 'quarters' END AS kind FROM k),
x AS (SELECT *, CASE WHEN NOT (r BETWEEN 3 AND 28 AND c BETWEEN 3 AND 28) THEN 0 WHEN kind = 'rect' THEN CAST(rect AS INT) WHEN kind = 'multirect' THEN CAST(rect OR other AS INT)
  WHEN kind = 'plots' THEN CAST(rect AND free = 1 AS INT) ELSE CAST(m AS INT) END AS mask FROM q),
y AS (SELECT *, avg(mask) OVER (PARTITION BY tile_id) AS s FROM x)
SELECT tile_id, kind, CAST(sum(v) AS BIGINT) AS cells, CAST(sum(v * (r * 32 + c)) AS BIGINT) AS places FROM (SELECT *, CASE WHEN s BETWEEN 0.004 AND 0.92 THEN mask ELSE CAST(rect AS INT) END AS v FROM y) GROUP BY 1, 2
""", cells=True)
def random_masks(spark, sf_dir):
    t = masks.random_masks(full_cells(spark, sf_dir), 7, 3, SIDE)
    return t.groupBy("tile_id", "kind").agg(F.sum("mask").alias("cells"), F.sum(F.col("mask") * (F.col("r") * SIDE + F.col("c"))).alias("places"))


_LABELS = ",\nl AS (SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL)\n"
_LAST = "SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL"


@query("fill_holes", _reach("green", "abs(a.r - b.r) + abs(a.c - b.c) = 1").replace(_LAST, _LABELS + """
SELECT tile_id, r, c FROM l JOIN (SELECT tile_id, label FROM l GROUP BY ALL HAVING count(*) < 6 AND min(r) > 0 AND min(c) > 0 AND max(r) < 31 AND max(c) < 31) USING (tile_id, label)
"""))
def fill_holes(spark, sf_dir):
    """Small holes, which greens leave in all else, that don't touch the border."""
    return tiles_np.holes(full_cells(spark, sf_dir), F.col("cls") != "green", 6, SIDE)
