"""Sun, shadow and view readings of height grids, as joins of cells along directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sunset_angle

#: Declination of the solstices, floor of the sun's altitude, height of shade that still counts as sun,
#: metres that a view goes.
SOLSTICE, LOWEST_SUN, SHADE, VIEW = 23.44, 0.25, 0.05, 250.0


def declination(day: Column, latitude: Column) -> Column:
    """Of a named day; summer and winter change sides south of the equator."""
    north = F.when(latitude >= 0, 1.0).otherwise(-1.0)
    return F.when(day == "summer", SOLSTICE * north).when(day == "winter", -SOLSTICE * north).otherwise(0.0)


def positions(places: DataFrame, step_min: float = 30.0) -> DataFrame:
    """Sun positions of each (place, lat, decl): i, altitude and azimuth in degrees, weight in hours.

    The day is cut into equal parts, each seen at its middle; a polar night has none, a midnight sun the whole day.
    """
    half = sunset_angle(F.col("lat"), F.col("decl"))
    hours = 2 * half * 12 / math.pi
    n = F.greatest(F.lit(1.0), F.rint(F.round(hours * 60 / step_min, 9))).cast("int")
    t = places.withColumn("half", half).withColumn("n", n).where("half > 0")
    t = t.select("place", "lat", "decl", "half", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    w = -F.col("half") + (F.col("i") + 0.5) * 2 * F.col("half") / F.col("n")
    phi, d = F.radians("lat"), F.radians("decl")
    t = t.withColumn("w", w)
    s = F.sin(phi) * F.sin(d) + F.cos(phi) * F.cos(d) * F.cos("w")
    alt = F.asin(F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)))
    east, north = -F.cos(d) * F.sin("w"), F.cos(phi) * F.sin(d) - F.sin(phi) * F.cos(d) * F.cos("w")
    az = F.degrees(F.atan2(east, north))
    return t.where(alt > 0).select("place", "i", F.degrees(alt).alias("altitude"), F.when(az < 0, az + 360).otherwise(az).alias("azimuth"), (2 * F.col("half") * 12 / math.pi / F.col("n")).alias("hours"))


def horizon(cells: DataFrame, dr: int, dc: int, cell_m: float, slope: float, reach: int | None = None) -> DataFrame:
    """The height of shade over each cell from the cells towards the sun, one step (dr, dc) after another:
    what stands k steps on, less k times the drop of the ray. An equi-join on moved cells, then a maximum.

    Without a reach each cell shades as many steps as its own height needs, at most the side of the largest grid.
    """
    drop = math.hypot(dr, dc) * cell_m * slope
    tall = cells.where("h > 0").select("tile_id", "r", "c", "h")
    steps = F.lit(reach)
    if reach is None:
        sides = cells.groupBy("tile_id").agg(F.greatest(F.max("r") - F.min("r"), F.max("c") - F.min("c")).alias("side"))
        tall = tall.crossJoin(F.broadcast(sides.agg(F.max("side").alias("side"))))
        steps = F.least(F.ceil(F.try_divide(F.col("h"), F.lit(drop))), F.col("side")).cast("int")
    tall = tall.withColumn("steps", steps).where("steps >= 1").select("tile_id", "r", "c", "h", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("k"))
    shade = tall.select("tile_id", (F.col("r") - dr * F.col("k")).alias("r"), (F.col("c") - dc * F.col("k")).alias("c"), (F.col("h") - F.col("k") * drop).alias("z")).where("z > 0")
    top = shade.groupBy("tile_id", "r", "c").agg(F.max("z").alias("shade"))
    return cells.join(top, ["tile_id", "r", "c"], "left").withColumn("shade", F.coalesce("shade", F.lit(0.0)))


def sun_hours(cells: DataFrame, suns: list[tuple[int, int, float, float]], cell_m: float, reach: int | None = None) -> DataFrame:
    """Hours of sun on the ground of each cell: suns are (dr, dc, slope of the ray, hours); reach as in horizon."""
    out = None
    for dr, dc, slope, hours in suns:
        one = horizon(cells, dr, dc, cell_m, slope, reach).where("cls != 'building'")
        one = one.select("tile_id", "cls", "r", "c", F.when(F.col("shade") <= SHADE, hours).otherwise(0.0).alias("hours"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("tile_id", "cls", "r", "c").agg(F.sum("hours").alias("hours"))


def weighted(value: str, weight: str, least: float) -> list[Column]:
    """Weighted mean, and percent of weight at or above a value; null over nothing."""
    w = F.sum(weight)
    return [
        F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), w), 6).alias("mean"),
        F.round(100.0 * F.try_divide(F.sum(F.when(F.col(value) >= least, F.col(weight)).otherwise(0.0)), w), 6).alias("above_pct"),
    ]


def first_hit(eyes: DataFrame, cells: DataFrame, directions: list[tuple[int, int, float]], cell_m: float, reach: int | None = None) -> DataFrame:
    """What each ray from an eye (tile_id, eye, r, c, z) meets first: its class and distance.

    directions are (dr, dc, rise in metres a metre). A cell is met where the ray is not above it; one taller than
    half a metre counts as building. Rays that meet nothing see the sky if they rise, else open ground. Without a
    reach rays go VIEW metres, whatever their direction.
    """
    ray = F.explode(F.array(*[F.struct(F.lit(i).alias("ray"), F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(s)).alias("rise")) for i, (a, b, s) in enumerate(directions)]))
    rays = eyes.select("tile_id", "eye", "r", "c", "z", ray.alias("d")).select("tile_id", "eye", "r", "c", "z", "d.*")
    step = F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * cell_m
    steps = F.lit(reach) if reach is not None else F.floor(F.lit(VIEW) / step + 1e-9).cast("int")
    t = rays.withColumn("steps", steps).where("steps >= 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    length = F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) * cell_m * F.col("k")
    t = t.select("tile_id", "eye", "ray", (F.col("r") + F.col("k") * F.col("dr")).alias("r"), (F.col("c") + F.col("k") * F.col("dc")).alias("c"), length.alias("far"), (F.col("z") + length * F.col("rise")).alias("at"))
    met = t.join(cells.select("tile_id", "r", "c", "cls", "h"), ["tile_id", "r", "c"]).where("at <= h or at <= 0")
    seen = F.when(F.col("h") > 0.5, "building").otherwise(F.col("cls"))
    first = met.groupBy("tile_id", "eye", "ray").agg(F.min_by(F.struct(seen.alias("cls"), "far"), "far").alias("m"))
    out = rays.select("tile_id", "eye", "ray", "rise").join(first, ["tile_id", "eye", "ray"], "left")
    return out.select("tile_id", "eye", "ray", F.coalesce("m.cls", F.when(F.col("rise") > 0, "sky").otherwise("open")).alias("sees"), F.round("m.far", 6).alias("far"))


def view_rays(around: int | Column, up: int | Column, spread: float = 180.0) -> Column:
    """Directions over a sector to either side of a wall, of equal solid angle: azimuth and altitude in degrees."""
    around, up = (F.lit(x) if isinstance(x, int) else x for x in (around, up))
    up = up + up % 2  # no band on the horizon itself
    az = F.transform(F.sequence(F.lit(0).cast("long"), (around - 1).cast("long")), lambda i: -spread / 2 + (i + 0.5) * spread / around)
    alt = F.transform(F.sequence(F.lit(0).cast("long"), (up - 1).cast("long")), lambda j: F.degrees(F.asin(-1 + (j + 0.5) * 2.0 / up)))
    return F.flatten(F.transform(az, lambda a: F.transform(alt, lambda b: F.struct(a.alias("azimuth"), b.alias("altitude")))))


#: Metres within which a view of a building counts as overlooked.
OVERLOOKED = 25.0


def view_shares(hits: DataFrame, weight: str) -> DataFrame:
    """Weighted shares of what rays (tile_id, sees, far, and a weight of wall area and solid angle) meet, the share that
    is overlooked, and the mean distance of what stands in the way (null where nothing does)."""
    w, total = F.col(weight), F.sum(weight)

    def share(which: Column) -> Column:
        return F.round(100.0 * F.sum(F.when(which, w).otherwise(0.0)) / total, 4)

    blocked = F.col("far").isNotNull()
    seen = {f"view_{k}_pct": share(F.col("sees") == k) for k in ("sky", "building", "green", "street", "open")}
    near = (F.col("sees") == "building") & (F.col("far") <= OVERLOOKED)
    distance = F.try_divide(F.sum(F.when(blocked, w * F.col("far"))), F.sum(F.when(blocked, w)))
    return hits.groupBy("tile_id").agg(*[v.alias(k) for k, v in seen.items()], share(near).alias("view_overlooked_pct"), F.round(distance, 4).alias("view_obstruction_m"))
