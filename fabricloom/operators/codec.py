"""Decoding, placing and resampling of encoded tiles, on cells (tile_id, r, c, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import GREEN, STREET
from .raster import _along, bilinear, extreme

THRESHOLD = 128


def decode(cells: DataFrame, grey: Column, threshold: int = THRESHOLD) -> DataFrame:
    """Adds red, green and blue of cells with footprint, street and green bytes (fp, st, gr): buildings in their grey,
    greens over them, streets over all."""
    street, green, built = (F.col(c) >= threshold for c in ("st", "gr", "fp"))

    def band(k: int) -> Column:
        return F.when(street, STREET[k]).when(green, GREEN[k]).when(built, grey).otherwise(0).cast("int")

    return cells.withColumns({name: band(k) for k, name in enumerate(("red", "green", "blue"))})


def position(index: Column, grid: int) -> tuple[Column, Column]:
    """Row and column of a tile's index, row by row."""
    return F.floor(index / grid).cast("int"), (index % grid).cast("int")


def split_name(name: Column) -> tuple[Column, Column]:
    """What is before and after the last underscore; without one, the whole name and an empty string."""
    has = F.contains(name, F.lit("_"))
    tail = F.substring_index(name, "_", -1)
    return F.when(has, F.substr(name, F.lit(1), F.length(name) - F.length(tail) - 1)).otherwise(name), F.when(has, tail).otherwise("")


def selected(rows: DataFrame, column: str, only: str | None = None, skip: str | None = None) -> DataFrame:
    """Rows whose name is in a comma-separated list and not in another; no list, no condition. Nulls stay unless
    there is a list to be in."""
    def names(text: str) -> list[str]:
        return [x.strip() for x in text.split(",")]

    if only:
        rows = rows.where(F.col(column).isin(names(only)))
    return rows.where(~F.coalesce(F.col(column).isin(names(skip)), F.lit(False))) if skip else rows


def weights(old: int, new: int) -> list[tuple[int, int, float]]:
    """(new place, old place, weight) of an antialiased bilinear resize along one axis: a triangle as wide as a new
    cell (an old one when enlarging), cut at the border and brought to a sum of one."""
    scale = old / new
    reach = max(scale, 1.0)
    out = []
    for i in range(new):
        middle = (i + 0.5) * scale
        some = [(j, 1 - abs(j + 0.5 - middle) / reach) for j in range(old) if abs(j + 0.5 - middle) < reach]
        total = sum(w for _, w in some)
        out += [(i, j, w / total) for j, w in some]
    return out


def resize(cells: DataFrame, value: str, old: int, new: int) -> DataFrame:
    """Antialiased bilinear resize of a field, one axis after the other. The weights are bounded by a tile's side."""
    spark = cells.sparkSession
    w = F.broadcast(spark.createDataFrame(weights(old, new), "_to int, _from int, _w double"))
    for axis in ("c", "r"):
        other = "r" if axis == "c" else "c"
        t = cells.join(w, F.col(axis) == F.col("_from")).groupBy("tile_id", other, F.col("_to").alias(axis))
        cells = t.agg(F.sum(F.col(value) * F.col("_w")).alias(value))
    return cells.select("tile_id", "r", "c", value)


def stacked(cells: DataFrame, channels: list[str], side: int) -> DataFrame:
    """One row a tile: each channel as an array in row order. A tile is a bounded group."""
    place = F.col("r") * side + F.col("c")
    each = F.array_sort(F.collect_list(F.struct(place.alias("p"), *channels)))
    t = cells.groupBy("tile_id").agg(each.alias("_a"))
    return t.select("tile_id", *[F.col("_a").getField(c).alias(c) for c in channels])


def rotated(cells: DataFrame, angles: DataFrame, value: str, side: int) -> DataFrame:
    """A field on a frame turned by angle (tile_id, angle) about the tile's middle: bilinear, without what falls outside."""
    half = (side - 1) / 2.0
    x, y = F.col("c") - half, F.col("r") - half
    t = cells.select("tile_id", "r", "c").join(angles, "tile_id")
    p = (F.col("r") * side + F.col("c")).cast("long")
    points = t.select(
        "tile_id", p.alias("p"),
        F.round(half + x * F.cos("angle") - y * F.sin("angle"), 6).alias("x"), F.round(half + x * F.sin("angle") + y * F.cos("angle"), 6).alias("y"),
    )
    return bilinear(points, cells, value)


def fill_heights(cells: DataFrame, nearest: DataFrame, sigma: float, side: int, flat: int) -> DataFrame:
    """Heights without cliffs: a building's own inside, outside that of the nearest building, blurred.

    nearest: for each cell of a tile with buildings the built cell next to it (nr, nc). The blur reaches four sigma,
    edges repeat. A tile without a building is flat.
    """
    built = cells.where("cls = 'building'").select("tile_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("h").alias("_n"))
    t = cells.join(nearest, ["tile_id", "r", "c"], "left").join(built, ["tile_id", "nr", "nc"], "left")
    t = t.select("tile_id", "r", "c", "cls", "h", F.coalesce("_n", F.lit(flat)).cast("double").alias("_f"))
    reach = int(4 * sigma + 0.5)
    kernel = [(k, 2.718281828459045 ** (-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]
    total = sum(x for _, x in kernel)
    blurred = t.select("tile_id", "r", "c", "_f")
    for axis in ("r", "c"):
        o = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x / total).alias("w")) for k, x in kernel]))
        at = F.greatest(F.lit(0), F.least(F.lit(side - 1), F.col(axis) + F.col("o.k")))
        other = "c" if axis == "r" else "r"
        want = blurred.select("tile_id", "r", "c", o.alias("o")).select("tile_id", F.col(axis).alias("_to"), other, at.alias(axis), F.col("o.w").alias("_w"))
        blurred = want.join(blurred, ["tile_id", "r", "c"]).groupBy("tile_id", other, F.col("_to").alias(axis)).agg(F.sum(F.col("_w") * F.col("_f")).alias("_f"))
    out = t.drop("_f").join(blurred, ["tile_id", "r", "c"])
    value = F.when(F.col("cls") == "building", F.col("h").cast("double")).otherwise(F.round("_f", 6))
    return out.select("tile_id", "r", "c", F.rint(value).cast("int").alias("h"))


def box_mean(cells: DataFrame, value: str, radius: int) -> DataFrame:
    """Mean of a square of the radius; what is outside counts as 0."""
    for axis in ("c", "r"):
        cells = cells.withColumn(value, F.sum(value).over(_along(axis).rowsBetween(-radius, radius)) / (2.0 * radius + 1))
    return cells


def feathered(cells: DataFrame, mask: str, real: str, made: str, feather: int, side: int) -> DataFrame:
    """Made values inside a mask, real ones outside, blended over a seam: the mask widened by a square and averaged twice."""
    t = extreme(cells.withColumn("_a", F.col(mask).cast("double")), "_a", feather, True, side)
    t = box_mean(box_mean(t, "_a", feather), "_a", feather)
    mixed = F.round(F.col(real) * (1 - F.col("_a")) + F.col(made) * F.col("_a"), 6)
    return t.withColumn("blend", F.greatest(F.lit(0), F.least(F.lit(255), F.rint(mixed).cast("int")))).drop("_a")


def summed_area(cells: DataFrame, value: str) -> DataFrame:
    """Adds _sum: of all cells at or before a cell's row and column."""
    from pyspark.sql import Window

    one = cells.withColumn("_sum", F.sum(value).over(_along("c").rowsBetween(Window.unboundedPreceding, 0)))
    return one.withColumn("_sum", F.sum("_sum").over(_along("r").rowsBetween(Window.unboundedPreceding, 0)))


def box_sums(boxes: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Sums of a value over boxes (tile_id, box, r0, c0, r1, c1; both ends included): four lookups in the summed area."""
    corner = F.explode(F.array(*[
        F.struct(r.alias("r"), c.alias("c"), F.lit(s).alias("s"))
        for r, c, s in ((F.col("r1"), F.col("c1"), 1), (F.col("r0") - 1, F.col("c1"), -1), (F.col("r1"), F.col("c0") - 1, -1), (F.col("r0") - 1, F.col("c0") - 1, 1))
    ]))
    t = boxes.select("tile_id", "box", corner.alias("k")).select("tile_id", "box", "k.*")
    found = t.join(summed_area(cells, value).select("tile_id", "r", "c", "_sum"), ["tile_id", "r", "c"], "left")
    return found.groupBy("tile_id", "box").agg(F.sum(F.col("s") * F.coalesce("_sum", F.lit(0))).alias("total"))


def majority(cells: DataFrame, label: str, centre: float = 1.5) -> DataFrame:
    """Each cell's most frequent label in its 3 x 3, its own counting more; ties go to the smaller label."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    votes = cells.select("tile_id", "r", "c", label, around.alias("o")).select(
        "tile_id", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), F.col(label).alias("_l"),
        F.when((F.col("o.a") == 0) & (F.col("o.b") == 0), centre).otherwise(1.0).alias("_w"),
    )
    count = cells.select("tile_id", "r", "c").join(votes, ["tile_id", "r", "c"]).groupBy("tile_id", "r", "c", "_l").agg(F.sum("_w").alias("_w"))
    best = count.groupBy("tile_id", "r", "c").agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col("_l").alias("l"))).alias("b"))
    return best.select("tile_id", "r", "c", F.col("b.l").alias(label))


def largest_rectangle(mask: DataFrame) -> DataFrame:
    """The largest rectangle of mask cells in each tile: r1 (its last row), c0, c1, height and area; ties to the first row
    and column. Every cell's column height limits one rectangle: as wide as its row's heights are not lower."""
    from pyspark.sql import Window

    island = F.col("r") - F.row_number().over(Window.partitionBy("tile_id", "c").orderBy("r"))
    t = mask.select("tile_id", "r", "c").withColumn("_i", island)
    t = t.withColumn("h", F.row_number().over(Window.partitionBy("tile_id", "c", "_i").orderBy("r"))).drop("_i")
    run = F.col("c") - F.row_number().over(Window.partitionBy("tile_id", "r").orderBy("c"))
    t = t.withColumn("_run", run)
    other = t.select("tile_id", "r", "_run", F.col("c").alias("_c"), F.col("h").alias("_h"))
    pairs = t.join(other, ["tile_id", "r", "_run"])  # a row of a tile is bounded by its side
    lower = F.col("_h") < F.col("h")
    one = pairs.groupBy("tile_id", "r", "c", "h", "_run").agg(
        F.max(F.when(lower & (F.col("_c") < F.col("c")), F.col("_c"))).alias("a"), F.min(F.when(lower & (F.col("_c") > F.col("c")), F.col("_c"))).alias("b"),
        F.min("_c").alias("lo"), F.max("_c").alias("hi"),
    )
    c0, c1 = F.coalesce(F.col("a") + 1, F.col("lo")), F.coalesce(F.col("b") - 1, F.col("hi"))
    one = one.select("tile_id", "r", c0.alias("c0"), c1.alias("c1"), "h", ((c1 - c0 + 1) * F.col("h")).alias("area"))
    best = one.groupBy("tile_id").agg(F.min(F.struct((-F.col("area")).alias("n"), "r", "c0", "c1", "h")).alias("b"))
    return best.select("tile_id", F.col("b.r").alias("r1"), "b.c0", "b.c1", F.col("b.h").alias("height"), (-F.col("b.n")).alias("area"))


def peaks(votes: DataFrame, bins: int, separation: int, least: float) -> DataFrame:
    """Peaks of a histogram of positions (tile_id, pos, w): smoothed by quarters and a half, taken from the highest down
    unless closer than the separation to one taken before, and moved to the weighted mean of the votes near by.

    A tile's histogram is one array of a fixed number of bins; the taking is one fold over it.
    """
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor("pos").cast("int")))
    counts = votes.groupBy("tile_id", b.alias("b")).agg(F.sum("w").alias("w"))
    h = counts.groupBy("tile_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))

    def at(m: Column, i: Column) -> Column:
        return F.coalesce(F.try_element_at(m, i), F.lit(0.0))

    smooth = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct((-(0.25 * at(F.col("m"), i - 1) + 0.5 * at(F.col("m"), i) + 0.25 * at(F.col("m"), i + 1))).alias("s"), i.alias("i")))
    ranked = F.array_sort(F.filter(smooth, lambda x: -x["s"] >= least))
    taken = F.aggregate(
        ranked, F.array().cast("array<int>"),
        lambda got, x: F.when(F.exists(got, lambda p: F.abs(p - x["i"]) < separation), got).otherwise(F.concat(got, F.array(x["i"]))),
    )
    picked = h.select("tile_id", F.explode(taken).alias("bin"))
    near = votes.join(picked, "tile_id").where(F.abs(F.col("pos") - (F.col("bin") + 0.5)) <= separation / 2)
    fine = near.groupBy("tile_id", "bin").agg((F.sum(F.col("pos") * F.col("w")) / F.sum("w")).alias("x"))
    return picked.join(fine, ["tile_id", "bin"], "left").select("tile_id", "bin", F.round(F.coalesce("x", F.col("bin") + 0.5), 6).alias("x"))


def overlaps(parts: DataFrame, plates: DataFrame, least: float) -> DataFrame:
    """Parts (tile_id, label, r, c) of which more than a share lies on plates (tile_id, r, c): label, cells, share."""
    on = plates.select("tile_id", "r", "c").distinct().withColumn("_on", F.lit(1))
    t = parts.join(on, ["tile_id", "r", "c"], "left").groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("cells"), F.count("_on").alias("_hit"))
    return t.withColumn("share", F.col("_hit") / F.col("cells")).where(F.col("share") > least).drop("_hit")
