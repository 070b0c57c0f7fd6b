"""Planar graphs: faces from half-edges, small faces drawn together, straight runs and where they meet.

Nodes are tile_id, node (a whole number below 2 ** 31), x, y; edges tile_id, a, b, at most one between two nodes and none from a
node to itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ranking import ring_ranks
from .regions import both_ways, components


def half_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge from both ends, with the half-edge that comes next around the face to its left: at its end, of all that start
    there in order of angle, the one before the way back. tile_id, id, next, a, b, and the ends' places."""
    t = both_ways(edges)
    for end in ("a", "b"):
        t = t.join(nodes.select("tile_id", F.col("node").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y")), ["tile_id", end])
    name = lambda a, b: F.shiftleft(F.col(a).cast("long"), 31).bitwiseOR(F.col(b).cast("long"))
    t = t.withColumns({"angle": F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), "out": name("a", "b")})
    around = Window.partitionBy("tile_id", "a").orderBy("angle", "b")  # as many rows as a node has edges
    before = F.coalesce(F.lag("out").over(around), F.last("out").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the half-edge that comes in along a row's edge goes on with the one before it
    return t.withColumn("next", before).select("tile_id", name("b", "a").alias("id"), "next", F.col("b").alias("a"), F.col("a").alias("b"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))


def faces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The half-edges by the face that they go round: tile_id, face (the least half-edge), seq, a, b, and the face's size and area.
    Faces inside have areas over 0; what lies around a connected part has one below, or 0 around a tree."""
    half = written(half_edges(nodes, edges), "half-edges")
    ranked = ring_ranks(half.select("tile_id", "id", "next"), ["tile_id"], "faces").withColumnRenamed("ring", "face")
    t = ranked.join(half, ["tile_id", "id"])
    area = t.groupBy("tile_id", "face").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    return t.join(area, ["tile_id", "face"]).select("tile_id", "face", "seq", "a", "b", "size", "area")


def collapsed(nodes: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Without faces smaller than `least`: the nodes around one become one node (the least of their numbers) in their middle, and so do
    those of small faces that share a node. Edges within go, and of several between two nodes one stays."""
    round_ = faces(nodes, edges).where((F.col("area") > 0) & (F.col("area") < least))
    joined = components(nodes.withColumnRenamed("node", "id"), round_.select("tile_id", "a", "b"))
    to = written(joined.select("tile_id", F.col("id").alias("node"), "label", "x", "y"), "collapsed")
    for end in ("a", "b"):
        edges = edges.join(to.select("tile_id", F.col("node").alias(end), F.col("label").alias(f"_{end}")), ["tile_id", end])
    kept = edges.where("_a <> _b").select("tile_id", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    return to.groupBy("tile_id", F.col("label").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("nodes")), kept


def straight_runs(points: DataFrame, keys: list[str]) -> DataFrame:
    """The line that fits whole-numbered points (keys, x, y) best by total least squares: n, the middle cx and cy, angle (in -90 to 90 degrees, as
    radians) and rms, from sums of second moments, so that a run of any length is one aggregate. A point, or points
    without a direction, get the angle 0."""
    s = {k: F.sum(v).cast("double") for k, v in {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}.items()}
    t = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"_{k}") for k, v in s.items()])
    spread = lambda two, one, other: F.col("n") * F.col(two) - F.col(one) * F.col(other)
    t = t.withColumns({"_a": spread("_xx", "_x", "_x"), "_b": spread("_yy", "_y", "_y"), "_c": spread("_xy", "_x", "_y")})
    small = (F.col("_a") + F.col("_b") - F.sqrt((F.col("_a") - F.col("_b")) ** 2 + 4 * F.col("_c") * F.col("_c"))) / 2
    return t.select(
        *keys, "n", (F.col("_x") / F.col("n")).alias("cx"), (F.col("_y") / F.col("n")).alias("cy"),
        (F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b")) / 2).alias("angle"), (F.sqrt(F.greatest(small, F.lit(0.0))) / F.col("n")).alias("rms"),
    )


def snapped(runs: DataFrame, degrees: float, least: int = 2) -> DataFrame:
    """Turns runs of at least so many points that lie within some degrees of the tile's main direction, or square to it, onto it. The
    main direction is the mean of fourfold angles, weighed by points; adds axis."""
    w = F.col("n")
    axis = runs.groupBy("tile_id").agg(F.sum(w * F.cos(4 * F.col("angle"))).alias("_c"), F.sum(w * F.sin(4 * F.col("angle"))).alias("_s"))
    t = runs.join(axis.select("tile_id", F.round(F.atan2(F.round("_s", 6), F.round("_c", 6)) / 4, 9).alias("axis")), "tile_id")
    off = F.col("angle") - F.col("axis")
    t = t.withColumn("_off", off - F.rint(F.round(off / (math.pi / 2), 9)) * (math.pi / 2))
    turn = (F.col("n") >= least) & (F.abs("_off") < math.radians(degrees))
    return t.withColumn("angle", F.when(turn, F.col("angle") - F.col("_off")).otherwise(F.col("angle"))).drop("_off")


def placed(nodes: DataFrame, incident: DataFrame, most: float, heavy: float = 20.0, hold: float = 0.08) -> DataFrame:
    """Moves each node to the point nearest to the lines of its runs (incident: tile_id, node, n, cx, cy, angle) by least squares, a run
    weighing its points (at most `heavy`), held to its place by a share of that, and at most so far. Nodes without a run stay."""
    nx, ny, w = -F.sin("angle"), F.cos("angle"), F.least(F.col("n").cast("double"), F.lit(heavy))
    off = nx * F.col("cx") + ny * F.col("cy")
    sums = {"aa": w * nx * nx, "ab": w * nx * ny, "bb": w * ny * ny, "p": w * nx * off, "q": w * ny * off, "w": w}
    s = incident.groupBy("tile_id", "node").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    t = nodes.join(s, ["tile_id", "node"], "left").withColumn("_l", hold * F.col("_w") + 1e-6)

    def c(k: str) -> Column:
        return F.col(f"_{k}")

    t = t.withColumns({"_aa": c("aa") + c("l"), "_bb": c("bb") + c("l"), "_p": c("p") + c("l") * F.col("x"), "_q": c("q") + c("l") * F.col("y")})
    det = c("aa") * c("bb") - c("ab") * c("ab")
    t = t.withColumns({"_dx": (c("p") * c("bb") - c("q") * c("ab")) / det - F.col("x"), "_dy": (c("q") * c("aa") - c("p") * c("ab")) / det - F.col("y")})
    far = F.hypot("_dx", "_dy")
    scale = F.when(far > most, most / far).otherwise(1.0)
    return t.select("tile_id", "node", (F.col("x") + F.coalesce(c("dx") * scale, F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce(c("dy") * scale, F.lit(0.0))).alias("y"))
