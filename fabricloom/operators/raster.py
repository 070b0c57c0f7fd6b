"""Neighbourhood operators on cells (tile_id, r, c, ...) as windows and equi-joins.

Every window is partitioned by tile and row or column, so one exchange on the tile serves a chain of them, and a
tile is a bounded group (its side is a parameter of the corpus, not of its size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(axis: str) -> "Window":
    other = "c" if axis == "r" else "r"
    return Window.partitionBy("tile_id", other).orderBy(axis)


def smooth3(cells: DataFrame, value: str, axis: str = "c") -> DataFrame:
    """Weights 1/4, 1/2, 1/4 along an axis, zero outside."""
    w, zero = _along(axis), F.lit(0)
    x = 0.25 * F.coalesce(F.lag(value).over(w), zero) + 0.5 * F.col(value) + 0.25 * F.coalesce(F.lead(value).over(w), zero)
    return cells.withColumn(value, x)


def box_blur(cells: DataFrame, value: str) -> DataFrame:
    """Mean of 3 x 3, edges repeated."""
    for axis in ("c", "r"):
        w = _along(axis)
        x = F.coalesce(F.lag(value).over(w), F.col(value)) + F.col(value) + F.coalesce(F.lead(value).over(w), F.col(value))
        cells = cells.withColumn(value, x / 3.0)
    return cells


def extreme(cells: DataFrame, value: str, radius: int, largest: bool, side: int) -> DataFrame:
    """Largest or smallest value in a square of the radius; outside counts as 0."""
    f = F.max if largest else F.min
    for axis in ("c", "r"):
        w = _along(axis).rowsBetween(-radius, radius)
        x = f(value).over(w)
        inside = (F.col(axis) >= radius) & (F.col(axis) < side - radius)
        cells = cells.withColumn(value, x if largest else F.when(inside, x).otherwise(F.least(x, F.lit(0))))
    return cells


def dilate_cross(cells: DataFrame, value: str) -> DataFrame:
    """The largest of each cell and the four beside it."""
    near = [f(value).over(_along(axis)) for axis in ("r", "c") for f in (F.lag, F.lead)]
    return cells.withColumn(value, F.greatest(F.col(value), *near))


def open_close(cells: DataFrame, value: str, opening: int, closing: int, side: int) -> DataFrame:
    """Opening (erode, dilate), then closing (dilate, erode), by squares."""
    for radius, largest in ((opening, False), (opening, True), (closing, True), (closing, False)):
        if radius:
            cells = extreme(cells, value, radius, largest, side)
    return cells


def strips(mask: DataFrame) -> DataFrame:
    """Runs of cells in each row: tile_id, r, first and last column."""
    island = F.col("c") - F.row_number().over(Window.partitionBy("tile_id", "r").orderBy("c"))
    return mask.withColumn("_i", island).groupBy("tile_id", "r", "_i").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_i")


def iou(a: Column, b: Column) -> Column:
    """Cells in both over cells in either; 1 where both are empty."""
    return F.coalesce(F.try_divide(F.count_if(a & b), F.count_if(a | b)), F.lit(1.0))


def shifts(mask: DataFrame, reach: int) -> DataFrame:
    """Each mask cell moved by every offset up to reach: dr, dc, tile_id, r, c."""
    d = F.sequence(F.lit(-reach), F.lit(reach))
    moved = mask.select("tile_id", "r", "c", F.explode(d).alias("dr")).select("tile_id", "r", "c", "dr", F.explode(d).alias("dc"))
    return moved.select("tile_id", "dr", "dc", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))


def downsample(cells: DataFrame, by: int) -> DataFrame:
    """Blocks of by x by cells: the share built, the largest height, and the mean height of built cells."""
    built = F.col("cls") == "building"
    return cells.groupBy("tile_id", F.floor(F.col("r") / by).cast("int").alias("r"), F.floor(F.col("c") / by).cast("int").alias("c")).agg(
        F.avg(built.cast("int")).alias("share"), F.max("h").alias("top"), F.round(F.avg(F.when(built, F.col("h"))), 6).alias("mean")
    )


def neighbours(cells: DataFrame, columns: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell with the values of its neighbours at the offsets (n_ columns), by an equi-join on cells."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
    moved = cells.select("tile_id", "r", "c", *columns, o.alias("o"))
    moved = moved.select("tile_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), *[F.col(x).alias(f"n_{x}") for x in columns])
    return cells.join(moved, ["tile_id", "r", "c"])


def adjacency(cells: DataFrame, label: str, value: str) -> DataFrame:
    """For each pair of labels that touch: shared cell edges and the strongest of their weaker sides."""
    pairs = neighbours(cells, [label, value], [(0, -1), (-1, 0)]).where(F.col(label) != F.col(f"n_{label}"))
    a, b = F.least(label, f"n_{label}"), F.greatest(label, f"n_{label}")
    return pairs.groupBy("tile_id", a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("edges"), F.max(F.least(value, f"n_{value}")).alias("strength"))


def boundary_edges(mask: DataFrame) -> DataFrame:
    """Edges of cells that only one cell of the mask has: tile_id, r, c of the edge's start and its direction."""
    sides = F.explode(F.array(*[
        F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.lit(k).alias("along"))
        for dr, dc, k in ((0, 0, "c"), (1, 0, "c"), (0, 0, "r"), (0, 1, "r"))
    ]))
    return mask.select("tile_id", sides.alias("e")).select("tile_id", "e.*").groupBy("tile_id", "r", "c", "along").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def gradient(cells: DataFrame, value: str) -> DataFrame:
    """Adds gr and gc: central differences, one-sided at the border."""
    for axis, name in (("r", "gr"), ("c", "gc")):
        w = _along(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        g = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2.0)
        cells = cells.withColumn(name, g)
    return cells


def axis_vote(cells: DataFrame, field: str, band: float = 1.5, least: float = 0.25, votes: int = 6) -> DataFrame:
    """The main direction of edges in a distance field, with fourfold symmetry, and how sure it is.

    Cells near the edge vote with their gradient's direction; a tile with fewer votes gets 0 and 0.
    """
    weight = F.hypot("gr", "gc")
    near = gradient(cells, field).where((F.abs(field) < band) & (weight > least))
    angle = 4 * F.atan2("gr", "gc")
    t = near.groupBy("tile_id").agg(F.sum(weight * F.sin(angle)).alias("s"), F.sum(weight * F.cos(angle)).alias("c"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("votes"))
    enough = F.col("votes") >= votes
    return t.select(
        "tile_id", F.when(enough, F.round(F.atan2(F.round("s", 6), F.round("c", 6)) / 4, 5)).otherwise(0.0).alias("axis"),
        F.when(enough, F.round(F.hypot("s", "c") / F.col("w"), 6)).otherwise(0.0).alias("confidence"), "votes",
    )


def hole_metrics(cells: DataFrame, hole: Column, cell_m: float) -> DataFrame:
    """Six readings of a hole in each tile, 0 where nothing is built: shares built, green and street, mean height,
    floor area ratio, and building size from cells over edge cells. A built cell is an edge cell if a cell of
    the tile around it isn't built, in the hole or not."""
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    bare = cells.where("cls != 'building'").select("tile_id", "r", "c")
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around]))
    near = bare.select("tile_id", "r", "c", o.alias("o")).select("tile_id", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"))
    t = cells.where(hole).join(near.groupBy("tile_id", "r", "c").agg(F.lit(True).alias("edge")), ["tile_id", "r", "c"], "left")
    b, zero, n = F.col("cls") == "building", F.lit(0.0), F.count(F.lit(1))
    built, edge = F.count_if(b), F.count_if(b & F.coalesce("edge", F.lit(False)))

    def share(cls: str) -> Column:
        return F.round(F.count_if(F.col("cls") == cls) / n, 6)

    return t.groupBy("tile_id").agg(
        share("building").alias("coverage"), share("green").alias("green"), share("street").alias("street"),
        F.round(F.coalesce(F.avg(F.when(b, F.col("h"))), zero), 6).alias("mean_height_m"),
        F.round(F.coalesce(F.sum(F.when(b, F.col("h"))), F.lit(0)) / (3.0 * n), 6).alias("far"),
        F.round(F.coalesce(F.try_divide(4.0 * built * cell_m, edge), zero), 6).alias("building_size_m"),
    )


def soft_coverage(cells: DataFrame, field: Column, sharp: float = 12.0) -> DataFrame:
    """Coverage and height through a sigmoid of a field instead of a threshold."""
    s = 1 / (1 + F.exp(-sharp * field))
    return cells.groupBy("tile_id").agg(
        F.round(100.0 * F.avg(s), 6).alias("coverage_pct"), F.round(F.sum(s * F.col("h")) / F.sum(s), 6).alias("mean_height_m")
    )


def dihedral(cells: DataFrame, side: int) -> DataFrame:
    """All eight turns and mirrors of each tile, numbered k: quarter turns, from 4 on mirrored first."""
    last = side - 1
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    t = cells.withColumn("k", k).withColumn("c", F.when(F.col("k") >= 4, last - F.col("c")).otherwise(F.col("c")))
    r, c, q = F.col("r"), F.col("c"), F.col("k") % 4
    new_r = F.when(q == 0, r).when(q == 1, last - c).when(q == 2, last - r).otherwise(c)
    new_c = F.when(q == 0, c).when(q == 1, r).when(q == 2, last - c).otherwise(last - r)
    return t.select("tile_id", "k", new_r.alias("r"), new_c.alias("c"), *[x for x in cells.columns if x not in ("tile_id", "r", "c")])


def padded_crop(cells: DataFrame, r0: int, c0: int, side: int, value: str, fill) -> DataFrame:
    """A square from (r0, c0) on of each tile, cells outside of the tile filled."""
    kept = cells.where(F.col("r").between(r0, r0 + side - 1) & F.col("c").between(c0, c0 + side - 1))
    kept = kept.select("tile_id", (F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), value)
    axis = F.sequence(F.lit(0), F.lit(side - 1))
    grid = cells.select("tile_id").distinct().select("tile_id", F.explode(axis).alias("r")).select("tile_id", "r", F.explode(axis).alias("c"))
    return grid.join(kept, ["tile_id", "r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def bilinear(points: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Values at points (tile_id, p, x, y; x along columns): weights of the four cells around, missing ones left out."""
    x0, y0 = F.floor("x"), F.floor("y")
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    t = points.select("tile_id", "p", "x", "y", corner.alias("k"))
    t = t.withColumn("c", (x0 + F.col("k.a")).cast("int")).withColumn("r", (y0 + F.col("k.b")).cast("int"))
    weight = (1 - F.abs(F.col("x") - F.col("c"))) * (1 - F.abs(F.col("y") - F.col("r")))
    t = t.withColumn("w", weight).where("w > 0").join(cells.select("tile_id", "r", "c", value), ["tile_id", "r", "c"])
    return t.groupBy("tile_id", "p").agg(F.round(F.sum(F.col("w") * F.col(value)) / F.sum("w"), 6).alias(value))
