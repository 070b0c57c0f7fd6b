"""Horizon and first hits on the bilinear height field, in any direction.

The horizon doubles: a field that knows the highest obstacle over k steps towards the sun, moved by k steps, knows it over 2k.
Rays go through a pyramid of block maxima: a stretch of a ray that stays above all blocks it passes is left out as a
whole, and only what may hit is looked at more closely.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .solar import LOWEST_SUN

#: Digits that offsets on the grid are rounded to, so that a sun due east has no trace of north.
PLACES = 9
#: The weights of the four cells around a point that lies _ty and _tx beyond the first, and their places.
CORNERS = [("(1 - _ty) * (1 - _tx)", 0, 0), ("(1 - _ty) * _tx", 0, 1), ("_ty * (1 - _tx)", 1, 0), ("_ty * _tx", 1, 1)]


def horizon_field(cells: DataFrame, suns: list[tuple[float, float]], cell_m: float, side: int, steps: int = 128) -> DataFrame:
    """The least height, per cell (tile_id, r, c, h) and sun (altitude, azimuth from north clockwise, in degrees), from which
    the sun can be seen: tile_id, sun, r, c, shade, null where no obstacle is met. Beyond a tile nothing stands in the way.

    A step is a cell, or more where a tile's tallest cell casts shade farther than `steps` cells. All suns go through the
    same rounds, and all rounds through one exchange by tile and sun. cells are whole tiles of side x side.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("sun"), F.lit(math.radians(max(a, LOWEST_SUN))).alias("alt"), F.lit(math.radians(z)).alias("az")) for i, (a, z) in enumerate(suns)]))
    reach = F.least(F.col("top") / F.tan("alt") + cell_m, F.lit(math.hypot(side, side) * cell_m))
    length = F.greatest(F.lit(float(cell_m)), F.greatest(reach, F.lit(float(cell_m))) / steps)
    way = cells.groupBy("tile_id").agg(F.max("h").alias("top")).select("tile_id", "top", kinds.alias("k")).select("tile_id", "top", "k.*")
    way = way.select("tile_id", "sun", (-F.cos("az") * length / cell_m).alias("dr"), (F.sin("az") * length / cell_m).alias("dc"), (F.tan("alt") * length).alias("dz"))
    t = cells.select("tile_id", "r", "c", F.col("h").cast("double").alias("h")).join(way, "tile_id").repartition("tile_id", "sun")
    field = t.select("tile_id", "sun", "r", "c", F.struct("dr", "dc", "dz").alias("way"), F.col("h").alias("m"))
    field = _beyond(field, 1, side, own=False)
    k = 1
    while k < min(steps, 2 * side):  # no ray crosses more than side * sqrt(2) cells
        field = _beyond(field, k, side, own=True)
        k *= 2
    return field.select("tile_id", "sun", "r", "c", F.col("m").alias("shade"))


def _beyond(field: DataFrame, k: int, side: int, own: bool) -> DataFrame:
    """The field k steps on, lowered by k drops; with own the higher of that and of the field itself. A point is known where
    all cells around it that weigh are."""
    t = field.withColumns({"_y": F.round(k * F.col("way.dr"), PLACES), "_x": F.round(k * F.col("way.dc"), PLACES)})
    t = t.withColumns({"_fy": F.floor("_y").cast("int"), "_fx": F.floor("_x").cast("int")})
    t = t.withColumns({"_ty": F.col("_y") - F.col("_fy"), "_tx": F.col("_x") - F.col("_fx")})
    parts = F.array(*[
        F.struct(F.lit(i).alias("i"), F.expr(f"r - _fy - {a}").alias("r"), F.expr(f"c - _fx - {b}").alias("c"), F.expr(w).alias("w"), F.expr(f"({w}) * m").alias("v"))
        for i, (w, a, b) in enumerate(CORNERS)
    ])
    inside = f"p.w > 0 AND p.r BETWEEN 0 AND {side - 1} AND p.c BETWEEN 0 AND {side - 1}"
    needed = F.expr(" + ".join(f"IF({w} > 0, 1, 0)" for w, _, _ in CORNERS))
    mine = F.array(F.struct(F.lit(-1).alias("i"), "r", "c", F.lit(1.0).alias("w"), F.col("m").alias("v")))
    t = t.select("tile_id", "sun", "way", needed.alias("needed"), F.explode(F.concat(mine, parts)).alias("p")).where(inside)
    met = t.groupBy("tile_id", "sun", F.col("p.r").alias("r"), F.col("p.c").alias("c")).agg(
        F.first("way").alias("way"), F.first("needed").alias("needed"), F.count_if(F.expr("p.i >= 0 AND p.v IS NOT NULL")).alias("n"),
        F.expr("max(IF(p.i = -1, p.v, NULL))").alias("own"), *[F.expr(f"coalesce(max(IF(p.i = {i}, p.v, NULL)), 0D)").alias(f"v{i}") for i in range(4)],
    )
    ahead = F.expr(f"IF(n = needed, v0 + v1 + v2 + v3 - {k} * way.dz, NULL)")
    return met.select("tile_id", "sun", "r", "c", "way", (F.greatest("own", ahead) if own else ahead).alias("m"))


def pyramid(cells: DataFrame, size: int) -> DataFrame:
    """The highest cell of each block of size x size."""
    return cells.groupBy("tile_id", F.floor(F.col("r") / size).cast("int").alias("br"), F.floor(F.col("c") / size).cast("int").alias("bc")).agg(F.max("h").alias("top"))


def march(eyes: DataFrame, cells: DataFrame, rays: DataFrame, cell_m: float, side: int, reach_m: float, step_m: float, levels: tuple[tuple[int, int], ...] = ((16, 8), (4, 4))) -> DataFrame:
    """What rays meet first. eyes: tile_id, eye, row, col (in cells, 0 at the middle of the first) and z; rays: tile_id,
    eye, ray, azimuth (from north clockwise), altitude. A ray is looked at every step_m up to reach_m and hits where it isn't
    above the bilinear field (edges repeated); it ends at the tile's edge. Adds sees and far: a hit over half a metre is a
    building, else the class of the nearest cell; rays without a hit see the sky if they rise, else open ground.

    levels: from coarse to fine, the steps in a stretch and the side of the blocks that its box is held against.
    """
    a, e = F.radians("azimuth"), F.radians("altitude")
    t = eyes.join(rays, ["tile_id", "eye"]).select(
        "tile_id", "eye", "ray", "row", "col", "z",
        (-F.cos(a) * F.cos(e) * step_m / cell_m).alias("dr"), (F.sin(a) * F.cos(e) * step_m / cell_m).alias("dc"), (F.sin(e) * step_m).alias("dz"),
    )
    count, first = math.ceil(reach_m / step_m), levels[0][0]
    at = lambda axis, k: F.col(axis) + F.col({"row": "dr", "col": "dc", "z": "dz"}[axis]) * k
    stretches = t.withColumn("k0", F.explode(F.sequence(F.lit(1), F.lit(count), F.lit(first)))).withColumn("k1", F.least(F.col("k0") + first - 1, F.lit(count)))
    for n, (size, block) in enumerate(levels):
        stretches = _may_hit(stretches, pyramid(cells, block), block, side, at)
        finer = levels[n + 1][0] if n + 1 < len(levels) else 1
        stretches = stretches.withColumn("_k0", F.explode(F.sequence("k0", "k1", F.lit(finer)))).withColumn("k1", F.least(F.col("_k0") + finer - 1, F.col("k1"))).withColumn("k0", F.col("_k0")).drop("_k0")
    points = stretches.select("tile_id", "eye", "ray", F.col("k0").alias("k"), at("row", F.col("k0")).alias("y"), at("col", F.col("k0")).alias("x"), at("z", F.col("k0")).alias("z"))
    points = points.where(F.col("y").between(-0.5, side - 0.5) & F.col("x").between(-0.5, side - 0.5))
    hits = _field_at(points, cells, side).where("z <= h").groupBy("tile_id", "eye", "ray").agg(F.min(F.struct("k", "y", "x", "h")).alias("hit"))
    near = lambda v: F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(side - 1.0)).cast("int")
    hits = hits.select("tile_id", "eye", "ray", near(F.col("hit.y")).alias("r"), near(F.col("hit.x")).alias("c"), F.col("hit.h").alias("h"), (F.col("hit.k") * step_m).alias("far"))
    hits = hits.join(cells.select("tile_id", "r", "c", "cls"), ["tile_id", "r", "c"]).select("tile_id", "eye", "ray", F.when(F.col("h") > 0.5, "building").otherwise(F.col("cls")).alias("met"), "far")
    out = t.select("tile_id", "eye", "ray", "dz").join(hits, ["tile_id", "eye", "ray"], "left")
    return out.select("tile_id", "eye", "ray", F.coalesce("met", F.when(F.col("dz") > 0, "sky").otherwise("open")).alias("sees"), "far")


def _may_hit(stretches: DataFrame, blocks: DataFrame, block: int, side: int, at) -> DataFrame:
    """The stretches whose lowest point isn't above the highest block that their box touches, with the cells that
    bilinear values reach."""
    def span(axis: str) -> Column:
        ends = [at(axis, F.col("k0")), at(axis, F.col("k1"))]
        low = F.least(F.greatest(F.floor(F.least(*ends)), F.lit(0)), F.lit(side - 1))
        high = F.least(F.greatest(F.floor(F.greatest(*ends)) + 1, F.lit(0)), F.lit(side - 1))
        return F.sequence(F.floor(low / block), F.floor(high / block))

    names = stretches.columns
    t = stretches.withColumn("_low", F.least(at("z", F.col("k0")), at("z", F.col("k1")))).withColumn("br", F.explode(span("row"))).withColumn("bc", F.explode(span("col")))
    met = t.join(blocks.select("tile_id", F.col("br").cast("long").alias("br"), F.col("bc").cast("long").alias("bc"), "top"), ["tile_id", "br", "bc"]).where(F.col("_low") <= F.col("top"))
    return met.select(names).dropDuplicates(["tile_id", "eye", "ray", "k0"])


def _field_at(points: DataFrame, cells: DataFrame, side: int) -> DataFrame:
    """Adds h: the bilinear height at y, x, edges repeated."""
    t = points.withColumns({f"_{v}": F.least(F.greatest(F.col(v), F.lit(0.0)), F.lit(side - 1.0)) for v in ("y", "x")})
    t = t.withColumns({"_fy": F.floor("_y").cast("int"), "_fx": F.floor("_x").cast("int")})
    t = t.withColumns({"_ty": F.col("_y") - F.col("_fy"), "_tx": F.col("_x") - F.col("_fx")})
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.expr(f"_fy + {a}").alias("r"), F.expr(f"_fx + {b}").alias("c"), F.expr(w).alias("w")) for i, (w, a, b) in enumerate(CORNERS)])
    t = t.withColumn("p", F.explode(parts)).where("p.w > 0").select("tile_id", "eye", "ray", "k", "y", "x", "z", "p.*")
    t = t.join(cells.select("tile_id", "r", "c", "h"), ["tile_id", "r", "c"])
    part = " + ".join(f"coalesce(max(IF(i = {i}, w * h, NULL)), 0D)" for i in range(4))
    return t.groupBy("tile_id", "eye", "ray", "k").agg(F.first("y").alias("y"), F.first("x").alias("x"), F.first("z").alias("z"), F.expr(part).alias("h"))
