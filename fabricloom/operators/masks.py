"""Masks of what a model is to make, as cells: rectangles, floods, quarters, with a margin and a fallback.

Every draw is a hash of a seed, the tile and what is drawn, so masks are the same on every run and in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import extreme

#: Fixed kinds and their shares of a hundred.
KINDS = {"rect": 30, "multirect": 20, "plots": 20, "quarters": 30}


def draw(seed: int, what: str, below: int) -> Column:
    """A whole number from 0 to below - 1 for each tile_id."""
    text = F.concat(F.col("tile_id").cast("string"), F.lit(f":{seed}:{what}"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % below).cast("int")


def interior(cells: DataFrame, margin: int, side: int) -> DataFrame:
    """Cells at least a margin from the border of their tile."""
    inside = [F.col(a).between(margin, side - margin - 1) for a in ("r", "c")]
    return cells.where(inside[0] & inside[1])


def rectangle(seed: int, what: str, low: int, high: int, margin: int, side: int) -> Column:
    """Whether a cell is in its tile's drawn rectangle: sides from low to high, inside the margin."""
    out = F.lit(True)
    for axis in ("r", "c"):
        size = low + draw(seed, f"{what}:{axis}:size", high - low + 1)
        room = side - 2 * margin - size + 1
        first = margin + F.pmod(draw(seed, f"{what}:{axis}:first", 1 << 20), room)
        out = out & (F.col(axis) >= first) & (F.col(axis) < first + size)
    return out


def flood(cells: DataFrame, seed: str, allow: str, reach: int, side: int, step: int = 2) -> DataFrame:
    """A mask (1 and 0) grown through what is allowed until it has gone `reach` cells, a square of `step` at a time.
    Every pass is a window by tile, so all of them take one exchange a direction."""
    t = cells.withColumn("_m", F.col(seed))
    for _ in range(max(1, reach // step)):
        t = extreme(t, "_m", step, True, side).withColumn("_m", F.col("_m") * F.col(allow))
    return t.withColumn(seed, F.col("_m")).drop("_m")


def with_fallback(cells: DataFrame, mask: str, other: str, low: float = 0.004, high: float = 0.92) -> DataFrame:
    """Tiles whose mask covers too little or too much take the other mask: mask is replaced."""
    share = F.avg(F.col(mask).cast("double")).over(Window.partitionBy("tile_id"))
    return cells.withColumn(mask, F.when(share.between(low, high), F.col(mask)).otherwise(F.col(other)))


def random_masks(cells: DataFrame, seed: int, margin: int, side: int, reach: int = 8) -> DataFrame:
    """Adds kind and mask (0 and 1) to the cells of each tile: a rectangle, two of them, a rectangle without streets,
    or the quarter around a drawn cell as far as streets let it grow. Kinds have the shares of KINDS; what is next to
    nothing or nearly all of a tile gives way to the rectangle."""
    roll, below = draw(seed, "kind", 100), 0
    kind = None
    for name, share in KINDS.items():
        below += share
        kind = (F if kind is None else kind).when(roll < below, name)
    rect = rectangle(seed, "a", side // 4, side // 2, margin, side)
    two = rect | rectangle(seed, "b", side // 8, side // 3, margin, side)
    free = F.col("cls") != "street"
    at = [(F.col(a) == margin + draw(seed, f"seed:{a}", side - 2 * margin)) for a in ("r", "c")]
    t = cells.withColumns({
        "kind": kind, "_rect": rect.cast("int"), "_two": two.cast("int"), "_plots": (rect & free).cast("int"),
        "_free": free.cast("int"), "_grown": (at[0] & at[1] & free).cast("int"),
    })
    t = flood(t, "_grown", "_free", reach, side)
    inside = F.col("r").between(margin, side - margin - 1) & F.col("c").between(margin, side - margin - 1)
    mask = F.when(F.col("kind") == "rect", F.col("_rect")).when(F.col("kind") == "multirect", F.col("_two")).when(F.col("kind") == "plots", F.col("_plots")).otherwise(F.col("_grown"))
    t = t.withColumn("mask", F.when(inside, mask).otherwise(0))
    return with_fallback(t, "mask", "_rect").drop("_rect", "_two", "_plots", "_free", "_grown")
