"""Sun, shadow and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import day_length as length
from ..operators import solar
from ..session import table
from ..sources.cells import full_cells
from .catalog import query

_PLACES = """places AS (SELECT n_nationkey AS place, (n_nationkey - 12) * 5.0 AS lat, CASE d WHEN 0 THEN 0.0 WHEN 1 THEN 23.44 * CASE WHEN n_nationkey >= 12 THEN 1 ELSE -1 END
  ELSE -23.44 * CASE WHEN n_nationkey >= 12 THEN 1 ELSE -1 END END AS decl, d FROM nation, range(3) k(d)),
half AS (SELECT *, CASE WHEN -tan(radians(lat)) * tan(radians(decl)) >= 1 THEN 0.0 WHEN -tan(radians(lat)) * tan(radians(decl)) <= -1 THEN pi()
  ELSE acos(-tan(radians(lat)) * tan(radians(decl))) END AS half FROM places)"""


def _places(spark, sf_dir):
    day = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(n).alias("day")) for i, n in enumerate(("equinox", "summer", "winter"))]))
    lat = ((F.col("n_nationkey") - 12) * 5.0).alias("lat")
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), lat, day.alias("k")).select("place", "lat", "k.*")
    return t.withColumn("decl", solar.declination(F.col("day"), F.col("lat")))


@query("day_length", f"WITH {_PLACES} SELECT place, CAST(d AS INT) AS d, round(2 * half * 12 / pi(), 6) AS hours FROM half")
def day_length(spark, sf_dir):
    return _places(spark, sf_dir).select("place", "d", F.round(length(F.col("lat"), F.col("decl")), 6).alias("hours"))


@query("solar_positions", f"""
WITH {_PLACES}, n AS (SELECT *, greatest(1, CAST(round_even(round(2 * half * 12 / pi() * 60 / 30.0, 9), 0) AS INT)) AS n FROM half WHERE half > 0),
w AS (SELECT place, d, lat, decl, half, n, i, -half + (i + 0.5) * 2 * half / n AS w FROM n, range(48) r(i) WHERE i < n)
SELECT place, CAST(d AS INT) AS d, CAST(i AS INT) AS i,
  round(degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(radians(decl)) + cos(radians(lat)) * cos(radians(decl)) * cos(w))))), 5) AS altitude,
  round(2 * half * 12 / pi() / n, 6) AS hours FROM w
WHERE sin(radians(lat)) * sin(radians(decl)) + cos(radians(lat)) * cos(radians(decl)) * cos(w) > 0
""")
def solar_positions(spark, sf_dir):
    t = _places(spark, sf_dir)
    both = t.select(F.struct("place", "d").alias("place"), "lat", "decl")
    return solar.positions(both).select("place.place", "place.d", "i", F.round("altitude", 5).alias("altitude"), F.round("hours", 6).alias("hours"))


_SHADE = """s AS (SELECT f.tile_id, f.r, f.c, f.cls, coalesce(max(g.h - k * {drop}) FILTER (g.h - k * {drop} > 0), 0.0) AS shade
  FROM full_cells f CROSS JOIN range(1, 9) t(k) LEFT JOIN full_cells g ON g.tile_id = f.tile_id AND g.r = f.r + k * {dr} AND g.c = f.c + k * {dc} AND g.h > 0 GROUP BY ALL)"""


@query("horizon_nearest", "WITH " + _SHADE.format(drop="12.5 * 0.5", dr=1, dc=0) + " SELECT tile_id, r, c, round(shade, 6) AS shade FROM s", cells=True)
def horizon_nearest(spark, sf_dir):
    """Shade from the south under a sun that drops half a metre a metre."""
    return solar.horizon(full_cells(spark, sf_dir), 1, 0, 12.5, 0.5, 8).select("tile_id", "r", "c", F.round("shade", 6).alias("shade"))


_SUNS = [(0, 1, 0.25, 2.0), (1, 0, 0.5, 4.0), (0, -1, 0.25, 2.0)]


@query("sun_hours", "WITH " + ", ".join(
    _SHADE.format(drop=f"12.5 * {s}", dr=a, dc=b).replace("s AS", f"s{i} AS", 1) for i, (a, b, s, _) in enumerate(_SUNS)
) + """, h AS (SELECT tile_id, r, c, cls, sum(CASE WHEN shade <= 0.05 THEN hours ELSE 0 END) AS hours FROM (
  SELECT *, 2.0 AS hours FROM s0 UNION ALL SELECT *, 4.0 FROM s1 UNION ALL SELECT *, 2.0 FROM s2) WHERE cls != 'building' GROUP BY ALL)
SELECT tile_id, cls, round(CAST(avg(hours) AS DOUBLE), 6) AS mean, round(100.0 * avg(CASE WHEN hours >= 2 THEN 1 ELSE 0 END), 6) AS above_pct FROM h GROUP BY 1, 2
""", cells=True)
def sun_hours(spark, sf_dir):
    grid = full_cells(spark, sf_dir)
    hours = solar.sun_hours(grid, _SUNS, 12.5, 8).withColumn("w", F.lit(1.0))
    return hours.groupBy("tile_id", "cls").agg(*solar.weighted("hours", "w", 2.0))


_RAYS = [(0, 1, 0.0), (1, 0, 0.3), (1, 1, -0.2), (-1, 0, 0.1)]


@query("view_first_hit", """
WITH e AS (SELECT tile_id, r * 32 + c AS eye, r, c, h + 1.6 AS z FROM full_cells WHERE cls = 'building' AND h > 0),
d AS (SELECT * FROM (VALUES (0, 0, 1, 0.0), (1, 1, 0, 0.3), (2, 1, 1, -0.2), (3, -1, 0, 0.1)) v(ray, dr, dc, rise)),
k AS (SELECT e.tile_id, eye, ray, CAST(rise AS DOUBLE) AS rise, r + i * dr AS r, c + i * dc AS c, sqrt(dr * dr + dc * dc) * 12.5 * i AS far, z + sqrt(dr * dr + dc * dc) * 12.5 * i * rise AS lvl FROM e, d, range(1, 13) t(i)),
m AS (SELECT k.tile_id, eye, ray, arg_min(CASE WHEN h > 0.5 THEN 'building' ELSE cls END, far) AS sees, min(far) AS far FROM k JOIN full_cells f ON f.tile_id = k.tile_id AND f.r = k.r AND f.c = k.c
  WHERE lvl <= h OR lvl <= 0 GROUP BY ALL)
SELECT e.tile_id, e.eye, CAST(d.ray AS INT) AS ray, coalesce(sees, CASE WHEN rise > 0 THEN 'sky' ELSE 'open' END) AS sees, round(far, 6) AS far
FROM e CROSS JOIN d LEFT JOIN m ON m.tile_id = e.tile_id AND m.eye = e.eye AND m.ray = d.ray
""", cells=True)
def view_first_hit(spark, sf_dir):
    grid = full_cells(spark, sf_dir)
    eyes = grid.where("cls = 'building' and h > 0").select("tile_id", (F.col("r") * 32 + F.col("c")).alias("eye"), "r", "c", (F.col("h") + 1.6).alias("z"))
    return solar.first_hit(eyes, grid, _RAYS, 12.5, 12)


# The three queries above march 8 and 12 cells, as their SQL says; these march as far as heights and views reach.
_WHOLE_SHADE = """s AS (SELECT f.tile_id, f.r, f.c, f.cls, coalesce(max(g.h - k * {drop}) FILTER (g.h - k * {drop} > 0), 0.0) AS shade
  FROM full_cells f CROSS JOIN range(1, 32) t(k) LEFT JOIN full_cells g ON g.tile_id = f.tile_id AND g.r = f.r + k * {dr} AND g.c = f.c + k * {dc} AND g.h > 0 GROUP BY ALL)"""


@query("horizon_nearest_whole", "WITH " + _WHOLE_SHADE.format(drop="12.5 * 0.5", dr=1, dc=0) + " SELECT tile_id, r, c, round(shade, 6) AS shade FROM s", cells=True)
def horizon_nearest_whole(spark, sf_dir):
    """horizon_nearest with the shade of every building, however far it falls within the tile."""
    return solar.horizon(full_cells(spark, sf_dir), 1, 0, 12.5, 0.5).select("tile_id", "r", "c", F.round("shade", 6).alias("shade"))


@query("sun_hours_whole", "WITH " + ", ".join(
    _WHOLE_SHADE.format(drop=f"12.5 * {s}", dr=a, dc=b).replace("s AS", f"s{i} AS", 1) for i, (a, b, s, _) in enumerate(_SUNS)
) + """, h AS (SELECT tile_id, r, c, cls, sum(CASE WHEN shade <= 0.05 THEN hours ELSE 0 END) AS hours FROM (
  SELECT *, 2.0 AS hours FROM s0 UNION ALL SELECT *, 4.0 FROM s1 UNION ALL SELECT *, 2.0 FROM s2) WHERE cls != 'building' GROUP BY ALL)
SELECT tile_id, cls, round(CAST(avg(hours) AS DOUBLE), 6) AS mean, round(100.0 * avg(CASE WHEN hours >= 2 THEN 1 ELSE 0 END), 6) AS above_pct FROM h GROUP BY 1, 2
""", cells=True)
def sun_hours_whole(spark, sf_dir):
    hours = solar.sun_hours(full_cells(spark, sf_dir), _SUNS, 12.5).withColumn("w", F.lit(1.0))
    return hours.groupBy("tile_id", "cls").agg(*solar.weighted("hours", "w", 2.0))


@query("view_first_hit_whole", """
WITH e AS (SELECT tile_id, r * 32 + c AS eye, r, c, h + 1.6 AS z FROM full_cells WHERE cls = 'building' AND h > 0),
d AS (SELECT * FROM (VALUES (0, 0, 1, 0.0), (1, 1, 0, 0.3), (2, 1, 1, -0.2), (3, -1, 0, 0.1)) v(ray, dr, dc, rise)),
k AS (SELECT e.tile_id, eye, ray, CAST(rise AS DOUBLE) AS rise, r + i * dr AS r, c + i * dc AS c, sqrt(dr * dr + dc * dc) * 12.5 * i AS far, z + sqrt(dr * dr + dc * dc) * 12.5 * i * rise AS lvl FROM e, d, range(1, 21) t(i)),
m AS (SELECT k.tile_id, eye, ray, arg_min(CASE WHEN h > 0.5 THEN 'building' ELSE cls END, far) AS sees, min(far) AS far FROM k JOIN full_cells f ON f.tile_id = k.tile_id AND f.r = k.r AND f.c = k.c
  WHERE (lvl <= h OR lvl <= 0) AND far <= 250 GROUP BY ALL)
SELECT e.tile_id, e.eye, CAST(d.ray AS INT) AS ray, coalesce(sees, CASE WHEN rise > 0 THEN 'sky' ELSE 'open' END) AS sees, round(far, 6) AS far
FROM e CROSS JOIN d LEFT JOIN m ON m.tile_id = e.tile_id AND m.eye = e.eye AND m.ray = d.ray
""", cells=True)
def view_first_hit_whole(spark, sf_dir):
    grid = full_cells(spark, sf_dir)
    eyes = grid.where("cls = 'building' and h > 0").select("tile_id", (F.col("r") * 32 + F.col("c")).alias("eye"), "r", "c", (F.col("h") + 1.6).alias("z"))
    return solar.first_hit(eyes, grid, _RAYS, 12.5)


@query("view_directions", """
WITH s AS (SELECT s_suppkey, 4 + s_suppkey % 9 AS n, 2 + s_suppkey % 6 + (s_suppkey % 6) % 2 AS m FROM supplier)
SELECT s_suppkey, round(-90 + (i + 0.5) * 180.0 / n, 6) AS azimuth, round(degrees(asin(-1 + (j + 0.5) * 2.0 / m)), 6) AS altitude FROM s, range(12) a(i), range(8) b(j) WHERE i < n AND j < m
""")
def view_directions(spark, sf_dir):
    """Rays over a half of the sky, as many around and up as each supplier asks for."""
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(solar.view_rays(4 + k % 9, 2 + k % 6)))
    return t.select("s_suppkey", F.round("azimuth", 6).alias("azimuth"), F.round("altitude", 6).alias("altitude"))
