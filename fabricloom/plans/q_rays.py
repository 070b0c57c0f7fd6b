"""Horizon and view on the bilinear field in any direction; SQL goes step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rays, solar
from ..sources.cells import SIDE, full_cells
from .catalog import query

#: Altitude, azimuth and hours of suns of a day.
_SUNS = [(8.0, 97.5, 1.5), (21.0, 121.0, 1.5), (33.5, 150.0, 1.5), (38.0, 180.0, 1.5), (33.5, 210.0, 1.5), (21.0, 239.0, 1.5), (8.0, 262.5, 1.5)]


def _moved(out: str, from_: str, k: int, own: bool) -> str:
    corners = [("(1 - ty) * (1 - tx)", 0, 0), ("(1 - ty) * tx", 0, 1), ("ty * (1 - tx)", 1, 0), ("ty * tx", 1, 1)]
    joins = " ".join(f"LEFT JOIN {from_} k{i} ON k{i}.tile_id = t.tile_id AND k{i}.sun = t.sun AND k{i}.r = t.r + fy + {a} AND k{i}.c = t.c + fx + {b}" for i, (_, a, b) in enumerate(corners))
    value = " + ".join(f"CASE WHEN {w} > 0 THEN {w} * k{i}.m ELSE 0 END" for i, (w, _, _) in enumerate(corners))
    ahead = f"{value} - {k} * t.dz"
    return f"""{out} AS (SELECT t.tile_id, t.sun, t.r, t.c, t.dr, t.dc, t.dz, {f'greatest(t.m, {ahead})' if own else ahead} AS m
  FROM (SELECT *, round({k} * dr, 9) - floor(round({k} * dr, 9)) AS ty, round({k} * dc, 9) - floor(round({k} * dc, 9)) AS tx, CAST(floor(round({k} * dr, 9)) AS INT) AS fy, CAST(floor(round({k} * dc, 9)) AS INT) AS fx FROM {from_}) t {joins})"""


_HORIZON = """
WITH s AS (SELECT sun, radians(altitude) AS alt, radians(azimuth) AS az, hours FROM (VALUES {suns}) v(sun, altitude, azimuth, hours)),
x AS (SELECT tile_id, max(h) AS top FROM full_cells GROUP BY 1),
w AS (SELECT tile_id, sun, greatest(12.5, greatest(least(top / tan(alt) + 12.5, sqrt(2048.0) * 12.5), 12.5) / 128) AS len, alt, az FROM x, s),
f AS (SELECT tile_id, sun, r, c, -cos(az) * len / 12.5 AS dr, sin(az) * len / 12.5 AS dc, tan(alt) * len AS dz, CAST(h AS DOUBLE) AS m FROM full_cells JOIN w USING (tile_id)),
{rounds}
""".format(
    suns=", ".join(f"({i}, {a}, {z}, {h})" for i, (a, z, h) in enumerate(_SUNS)),
    rounds=",\n".join([_moved("f0", "f", 1, False)] + [_moved(f"f{n + 1}", f"f{n}", 1 << n, True) for n in range(6)]),
)


@query("horizon_field", _HORIZON + "SELECT tile_id, CAST(sun AS INT) AS sun, r, c, round(greatest(m, 0), 5) AS shade FROM f6", cells=True)
def horizon_field(spark, sf_dir):
    """How high shade stands over each cell under seven suns, from the bilinear field by doubling."""
    t = rays.horizon_field(full_cells(spark, sf_dir), [s[:2] for s in _SUNS], 12.5, SIDE)
    return t.select("tile_id", "sun", "r", "c", F.round(F.greatest("shade", F.lit(0.0)), 5).alias("shade"))


@query("sun_hours_field", _HORIZON + """,
h AS (SELECT tile_id, r, c, sum(CASE WHEN coalesce(m, 0) <= 0.05 THEN hours ELSE 0 END) AS hours FROM f6 JOIN s USING (sun) GROUP BY ALL)
SELECT tile_id, cls, round(CAST(avg(hours) AS DOUBLE), 6) AS mean, round(100.0 * avg(CASE WHEN hours >= 2 THEN 1 ELSE 0 END), 6) AS above_pct FROM h JOIN full_cells USING (tile_id, r, c) WHERE cls != 'building' GROUP BY 1, 2
""", cells=True)
def sun_hours_field(spark, sf_dir):
    """Hours of sun on open ground over a day of suns, by class."""
    grid = full_cells(spark, sf_dir)
    lit = rays.horizon_field(grid, [s[:2] for s in _SUNS], 12.5, SIDE)
    hours = F.element_at(F.array(*[F.lit(s[2]) for s in _SUNS]), F.col("sun") + 1)
    lit = lit.groupBy("tile_id", "r", "c").agg(F.sum(F.when(F.coalesce("shade", F.lit(0.0)) <= solar.SHADE, hours).otherwise(0.0)).alias("hours"))
    t = lit.join(grid.where("cls != 'building'").select("tile_id", "r", "c", "cls"), ["tile_id", "r", "c"]).withColumn("w", F.lit(1.0))
    return t.groupBy("tile_id", "cls").agg(*solar.weighted("hours", "w", 2.0))


_RAYS = [(20.0, -8.0), (75.0, 2.0), (133.0, 12.0), (180.0, -3.0), (250.0, 30.0), (311.0, 0.0)]


@query("view_march", f"""
WITH e AS (SELECT tile_id, r * 32 + c AS eye, CAST(r AS DOUBLE) AS "row", CAST(c AS DOUBLE) AS col, h + 1.6 AS z FROM full_cells WHERE cls = 'building' AND h > 0),
d AS (SELECT ray, -cos(radians(az)) * cos(radians(alt)) * 6.25 / 12.5 AS dr, sin(radians(az)) * cos(radians(alt)) * 6.25 / 12.5 AS dc, sin(radians(alt)) * 6.25 AS dz
  FROM (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_RAYS))}) v(ray, az, alt)),
p AS (SELECT tile_id, eye, ray, k, "row" + dr * k AS y, col + dc * k AS x, z + dz * k AS z FROM e, d, range(1, 41) t(k)),
q AS (SELECT *, least(greatest(y, 0), 31.0) AS v, least(greatest(x, 0), 31.0) AS u FROM p WHERE y BETWEEN -0.5 AND 31.5 AND x BETWEEN -0.5 AND 31.5),
b AS (SELECT q.*, (1 - (v - floor(v))) * (1 - (u - floor(u))) * k0.h + (1 - (v - floor(v))) * (u - floor(u)) * coalesce(k1.h, 0) + (v - floor(v)) * (1 - (u - floor(u))) * coalesce(k2.h, 0) + (v - floor(v)) * (u - floor(u)) * coalesce(k3.h, 0) AS h
  FROM q JOIN full_cells k0 ON k0.tile_id = q.tile_id AND k0.r = floor(v) AND k0.c = floor(u) LEFT JOIN full_cells k1 ON k1.tile_id = q.tile_id AND k1.r = floor(v) AND k1.c = floor(u) + 1
  LEFT JOIN full_cells k2 ON k2.tile_id = q.tile_id AND k2.r = floor(v) + 1 AND k2.c = floor(u) LEFT JOIN full_cells k3 ON k3.tile_id = q.tile_id AND k3.r = floor(v) + 1 AND k3.c = floor(u) + 1),
hit AS (SELECT * FROM b WHERE z <= h QUALIFY row_number() OVER (PARTITION BY tile_id, eye, ray ORDER BY k) = 1)
SELECT e.tile_id, e.eye, CAST(d.ray AS INT) AS ray, CASE WHEN hit.k IS NULL THEN CASE WHEN dz > 0 THEN 'sky' ELSE 'open' END WHEN hit.h > 0.5 THEN 'building' ELSE n.cls END AS sees, hit.k * 6.25 AS far
FROM e CROSS JOIN d LEFT JOIN hit ON hit.tile_id = e.tile_id AND hit.eye = e.eye AND hit.ray = d.ray
LEFT JOIN full_cells n ON n.tile_id = hit.tile_id AND n.r = round_even(v, 0) AND n.c = round_even(u, 0)
""", cells=True)
def view_march(spark, sf_dir):
    """What rays from above every building meet first within 250 m, in six directions off the grid's axes."""
    grid = full_cells(spark, sf_dir)
    eyes = grid.where("cls = 'building' and h > 0").select("tile_id", (F.col("r") * SIDE + F.col("c")).alias("eye"), F.col("r").cast("double").alias("row"), F.col("c").cast("double").alias("col"), (F.col("h") + 1.6).alias("z"))
    ray = F.explode(F.array(*[F.struct(F.lit(i).alias("ray"), F.lit(a).alias("azimuth"), F.lit(b).alias("altitude")) for i, (a, b) in enumerate(_RAYS)]))
    out = rays.march(eyes, grid, eyes.select("tile_id", "eye", ray.alias("d")).select("tile_id", "eye", "d.*"), 12.5, SIDE, solar.VIEW, 6.25)
    return out
