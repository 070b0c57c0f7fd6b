"""Contours of labelled regions of cells: boundary edges that find their successors by the turn rule, closed loops, corners.

Edges run clockwise round each cell (columns as x to the right, rows as y downwards), so a region lies to their right, outer loops
have a positive area and holes a negative one. Where a region touches itself at a corner, an edge turns right, which keeps
loops simple. Loops are numbered by pointer doubling, so no task walks along one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ring_ranks

#: The sides of a cell: direction 0 to 3 (east, south, west, north), start and step of its edge, and the cell beyond it,
#: each as (row, column) from the cell's own.
SIDES = [(0, (0, 0), (0, 1), (-1, 0)), (1, (0, 1), (1, 0), (0, 1)), (2, (1, 1), (0, -1), (1, 0)), (3, (1, 0), (-1, 0), (0, -1))]


def region_edges(regions: DataFrame, side: int) -> DataFrame:
    """Edges between cells (tile_id, label, r, c) and what isn't of their label: tile_id, label, id, d, x, y and the end x1, y1.
    id numbers an edge by its start and direction, in a grid of side x side cells."""
    kinds = F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("d", "y", "x", "dy", "dx", "nr", "nc"), (d, *start, *step, *beyond))]) for d, start, step, beyond in SIDES
    ]))
    t = regions.select("tile_id", "label", "r", "c", kinds.alias("k"))
    t = t.select("tile_id", "label", "k.d", (F.col("r") + F.col("k.y")).alias("y"), (F.col("c") + F.col("k.x")).alias("x"), "k.dy", "k.dx", (F.col("r") + F.col("k.nr")).alias("r"), (F.col("c") + F.col("k.nc")).alias("c"))
    open_ = t.join(regions.select("tile_id", "label", "r", "c"), ["tile_id", "label", "r", "c"], "left_anti")
    number = ((F.col("y") * (side + 1) + F.col("x")) * 4 + F.col("d")).cast("long")
    return open_.select("tile_id", "label", number.alias("id"), "d", "x", "y", (F.col("x") + F.col("dx")).alias("x1"), (F.col("y") + F.col("dy")).alias("y1"))


def successors(edges: DataFrame) -> DataFrame:
    """Adds next and whether the way bends there: of the edges that start where one ends, to the right before straight on before
    left. At most two start at a corner."""
    then = edges.select("tile_id", "label", F.col("id").alias("_id"), F.col("d").alias("_d"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    turn = F.pmod(F.col("_d") - F.col("d"), F.lit(4))
    rank = F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)
    best = edges.join(then, ["tile_id", "label", "x1", "y1"]).groupBy("tile_id", "label", "id").agg(F.min(F.struct(rank.alias("rank"), F.col("_id").alias("next"))).alias("b"))
    return edges.join(best.select("tile_id", "label", "id", "b.next", (F.col("b.rank") != 1).alias("bends")), ["tile_id", "label", "id"])


def loops(regions: DataFrame, side: int) -> DataFrame:
    """The contours of regions: tile_id, label, loop (the least edge number on it), seq from 0 without gaps, size, the point x, y
    where the edge starts, its end x1, y1, and corner (whether the way bends at the start)."""
    edges = successors(region_edges(regions, side))
    ranked = ring_ranks(edges.select("tile_id", "label", "id", "next"), ["tile_id", "label"], "loops")
    bends = edges.select("tile_id", "label", F.col("next").alias("id"), F.col("bends").alias("corner"))
    places = edges.select("tile_id", "label", "id", "x", "y", "x1", "y1").join(bends, ["tile_id", "label", "id"])
    return ranked.withColumnRenamed("ring", "loop").join(places, ["tile_id", "label", "id"]).drop("id")


def loop_facts(loops: DataFrame) -> DataFrame:
    """Of each loop: edges, corners, area (negative for a hole) and the box it spans."""
    cross = F.col("x") * F.col("y1") - F.col("x1") * F.col("y")
    return loops.groupBy("tile_id", "label", "loop").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if("corner").alias("corners"), (F.sum(cross) / 2).alias("area"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
    )
