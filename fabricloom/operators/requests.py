"""Requests and their parameters as rows: overlays, whitelists, clamps, names, caps, ramps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def overlay(*maps: Column) -> Column:
    """Maps laid over each other: of one key the last map that has it wins, and keys stay in order of first sight.
    A null map has no keys."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def two(below: Column, above: Column) -> Column:
        changed = F.transform_values(below, lambda k, v: F.when(F.map_contains_key(above, k), F.try_element_at(above, k)).otherwise(v))
        return F.map_concat(changed, F.map_filter(above, lambda k, v: ~F.map_contains_key(below, k)))

    return reduce(two, [F.coalesce(m, empty) for m in maps])


def whitelisted(options: Column, names: list[str]) -> Column:
    return F.map_filter(options, lambda k, v: k.isin(*names))


def public(rows: DataFrame, run_level: list[str]) -> DataFrame:
    """Without private columns (a leading underscore) and those of the run."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_") and c not in run_level])


def clamped(value: Column, low, high) -> Column:
    """Within bounds; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def axis_column(axis: Column) -> Column:
    """The column that an axis of a design space fills: prefixes as words, no colons."""
    return F.replace(F.replace(axis, F.lit("target:"), F.lit("target_")), F.lit("dir:"), F.lit("dir_"))


def unknown_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names that are asked for and that nothing is registered under."""
    return asked.select(name).distinct().join(known.select(name), name, "left_anti")


def capped(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group and how many it has beyond them; a cap is what is asked for here."""
    own = Window.partitionBy(group)
    t = rows.withColumn("_k", F.row_number().over(own.orderBy(*order))).withColumn("beyond", F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)).over(own) - most))
    return t.where(F.col("_k") <= most).drop("_k")


def listed(rows: DataFrame, group: str, name: str, most: int) -> DataFrame:
    """The first names of each group as text, and how many more there are."""
    t = capped(rows, group, [name], most).groupBy(group).agg(F.array_sort(F.collect_list(name)).alias("_n"), F.max("beyond").alias("_b"))
    more = F.when(F.col("_b") > 0, F.format_string(" (+%d more)", "_b")).otherwise("")
    return t.select(group, F.concat(F.array_join("_n", ", "), more).alias("names"))


def with_fallback(rows: DataFrame, group: str, good: Column, order: list[str], least: int) -> DataFrame:
    """The good rows of each group, and while there are fewer than asked for, the first of the others: adds filled_in.

    Good rows are counted by group, and of the others only the first `least` are ranked, so no group is held by one task.
    """
    t = written(rows.withColumn("_good", F.coalesce(good, F.lit(False))), "fallback")
    n = t.groupBy(F.col(group).alias("_group")).agg(F.count_if("_good").alias("_n"))
    first = t.where(~F.col("_good")).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= least)
    others = first.join(n, F.col(group).eqNullSafe(F.col("_group"))).where(F.col("_k") <= least - F.col("_n"))
    return t.where("_good").select(*rows.columns, F.lit(False).alias("filled_in")).unionByName(others.select(*rows.columns, F.lit(True).alias("filled_in")))


def warm_up(step: Column, rate: float, steps: int) -> Column:
    """A learning rate that rises linearly to its full value."""
    return rate * F.least(F.lit(1.0), (step + 1) / F.lit(float(steps)))


def projector_ramp(part: Column, rate: float) -> tuple[Column, Column]:
    """Learning rate and noise at a part (0 to 1) of a search: a short rise, full rate, a cosine down over the last
    quarter; noise falls as a square until three quarters."""
    down = 0.5 - 0.5 * F.cos(F.pi() * F.least(F.lit(1.0), (1 - part) / 0.25))
    up = F.least(F.lit(1.0), part / 0.05 + 1e-6)
    return rate * down * up, 0.05 * F.pow(F.greatest(F.lit(0.0), 1 - part / 0.75), F.lit(2.0))


def class_spread(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean of each place of a class's vectors, and one spread: the root of the mean squared distance to that mean.
    Places are rows, so a class is summed in parts."""
    each = vectors.select(label, F.posexplode(vector).alias("place", "_x")).withColumn("_x", F.col("_x").cast("double"))
    t = each.groupBy(label, "place").agg(F.avg("_x").alias("mean"), F.var_pop("_x").alias("_v"))
    spread = t.groupBy(label).agg(F.sqrt(F.sum("_v")).alias("spread"))
    return t.select(label, "place", "mean").join(spread, label)


def quad_boxes(boxes: DataFrame, points: DataFrame, most: int, depth: int = 2) -> DataFrame:
    """Boxes (box, x0, y0, x1, y1) with more points (box, x, y) than most, split in four, again and again up to a depth.

    Points follow their box down by its name and path: an equi-join, no comparison with every box.
    """
    done = None
    open_ = boxes.withColumn("level", F.lit(0)).withColumn("path", F.lit(""))
    inside = points.select("box", "x", "y").withColumn("path", F.lit(""))
    for level in range(depth + 1):
        load = inside.groupBy("box", "path").agg(F.count(F.lit(1)).alias("load"))
        t = open_.join(load, ["box", "path"], "left").withColumn("load", F.coalesce("load", F.lit(0).cast("long")))
        over = (F.col("load") > most) & F.lit(level < depth)
        done = t.where(~over) if done is None else done.unionByName(t.where(~over))
        if level == depth:
            break
        mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        part = F.explode(F.array(*[
            F.struct(F.lit(str(k)).alias("k"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
            for k, (a, b, c, d) in enumerate([(F.col("x0"), F.col("y0"), mx, my), (mx, F.col("y0"), F.col("x1"), my), (F.col("x0"), my, mx, F.col("y1")), (mx, my, F.col("x1"), F.col("y1"))])
        ]))
        split = t.where(over)
        inside = inside.join(split.select("box", "path", "x0", "y0", "x1", "y1"), ["box", "path"])
        quarter = (F.col("x") >= mx).cast("int") + 2 * (F.col("y") >= my).cast("int")
        inside = inside.select("box", F.concat("path", quarter.cast("string")).alias("path"), "x", "y")
        open_ = split.select("box", "path", F.lit(level + 1).alias("level"), part.alias("p")).select("box", F.concat("path", "p.k").alias("path"), "level", "p.x0", "p.y0", "p.x1", "p.y1")
    return done
