"""Polygons drawn onto cells by scanlines: edges become crossings of lines, and between a line's first and second, third and
fourth ... crossing it is inside, so holes and several rings need no order. No polygon or window is drawn in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spans(rings: DataFrame, keys: list[str], polygon: str, pitch: float, lines: int, *kept: str) -> DataFrame:
    """Of each polygon (rings of keys, polygon, ring, seq, x, y, closed from last to first) the stretches inside of lines through
    the middles of rows of the pitch, from 0 to lines - 1: keys, polygon, line, x0, x1, and what is kept of a polygon's columns
    (alike in all its rows). A line takes in an edge's lower end but not its upper one."""
    ring = Window.partitionBy(*keys, polygon, "ring").orderBy("seq")
    whole = Window.partitionBy(*keys, polygon, "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = rings.select(*keys, polygon, "ring", "seq", "x", "y", *kept).withColumns({f"{v}2": F.coalesce(F.lead(v).over(ring), F.first(v).over(whole)) for v in ("x", "y")})
    low, high = F.ceil(F.least("y", "y2") / pitch - 0.5), F.ceil(F.greatest("y", "y2") / pitch - 0.5) - 1
    t = t.withColumns({"_low": F.greatest(low, F.lit(0)).cast("int"), "_high": F.least(high, F.lit(lines - 1)).cast("int")}).where("_low <= _high")
    t = t.withColumn("line", F.explode(F.sequence("_low", "_high")))
    cross = F.col("x") + ((F.col("line") + 0.5) * pitch - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x"))
    order = Window.partitionBy(*keys, polygon, "line").orderBy("cross")  # a polygon's crossings of one line
    t = t.select(*keys, polygon, "line", cross.alias("cross"), *kept).withColumns({"_k": F.row_number().over(order), "x1": F.lead("cross").over(order)})
    return t.where("_k % 2 = 1 AND x1 IS NOT NULL").select(*keys, polygon, "line", F.col("cross").alias("x0"), "x1", *kept)


def rasterise(rings: DataFrame, keys: list[str], polygon: str, value: str, cell: float, side: int, sub: int) -> DataFrame:
    """Polygons on side x side cells, each of sub x sub points: keys, r, c, share of points inside, and the mean over them of the
    highest value of a polygon (a column of rings) that covers each. Cells without a point inside are left out; at half or
    more a cell counts as covered."""
    pitch, points = cell / sub, side * sub
    # the value goes along with the polygon, by the same partitions as its lines: no table of all polygons is joined
    t = spans(rings.withColumn("_value", F.max(value).over(Window.partitionBy(*keys, polygon))), keys, polygon, pitch, points, "_value")
    first, last = F.greatest(F.ceil(F.col("x0") / pitch - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("x1") / pitch - 0.5) - 1, F.lit(points - 1)).cast("int")
    t = t.withColumns({"_a": first, "_b": last}).where("_a <= _b")
    t = t.select(*keys, "line", "_value", F.explode(F.sequence("_a", "_b")).alias("point"))
    top = t.groupBy(*keys, "line", "point").agg(F.max("_value").alias("_value"))
    place = [F.floor(F.col("line") / sub).cast("int").alias("r"), F.floor(F.col("point") / sub).cast("int").alias("c")]
    return top.groupBy(*keys, *place).agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum")).select(
        *keys, "r", "c", (F.col("_n") / (sub * sub)).alias("share"), (F.col("_sum") / F.col("_n")).alias(value)
    )
