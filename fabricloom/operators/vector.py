"""Rings, segments and street graphs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Each point (keys, seq, x, y) with the next one of its ring; the last is joined to the first."""
    w = Window.partitionBy(*keys).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {n: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c, n in (("x", "x2"), ("y", "y2"))}
    return points.withColumns(nxt)


def ring_facts(points: DataFrame, keys: list[str]) -> DataFrame:
    """Signed area (counter-clockwise positive) and length of each ring."""
    s = segments(points, keys)
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    return s.groupBy(*keys).agg(F.round(F.sum(cross) / 2, 6).alias("area"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))), 6).alias("length"))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def points_in_rings(points: DataFrame, rings: DataFrame, ring_keys: list[str], on: str, cell: float = 50.0) -> DataFrame:
    """Points (on, p, px, py) inside rings of the same `on`: crossings to the right are counted, odd is inside.

    A point meets only the rings whose box has the point's grid cell: rings are listed by the cells of their box.
    """
    box = rings.groupBy(on, *ring_keys).agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    placed = box.select(on, *ring_keys, F.explode(_cells(F.col("_lox"), F.col("_hix"), cell)).alias("_cx"), "_loy", "_hiy")
    placed = placed.select(on, *ring_keys, "_cx", F.explode(_cells(F.col("_loy"), F.col("_hiy"), cell)).alias("_cy"))
    at_cell = points.withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    near = at_cell.join(placed, [on, "_cx", "_cy"]).drop("_cx", "_cy")
    s = segments(rings, [on, *ring_keys]).where("y != y2")
    t = near.join(s, [on, *ring_keys])
    crosses = (F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))
    at = F.col("x") + (F.col("py") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    hit = t.where(crosses & (at > F.col("px"))).groupBy(on, "p", *ring_keys).agg(F.count(F.lit(1)).alias("n"))
    return hit.where("n % 2 = 1").drop("n")


def facade_samples(rings: DataFrame, keys: list[str], height: str, spacing: float, floor: float, offset: float) -> DataFrame:
    """Points on the walls of rings: along each edge in equal steps of at most `spacing`, at each floor's middle,
    moved outward (rings are counter-clockwise), with normal and the wall area a point stands for."""
    s = segments(rings, keys).withColumn("length", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).where("length > 0")
    n = F.greatest(F.lit(1), F.ceil(F.round(F.col("length") / spacing, 9))).cast("int")
    levels = F.greatest(F.lit(1), F.floor(F.col(height) / floor)).cast("int")
    s = s.withColumn("n", n).withColumn("levels", levels)
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)))
    share = (F.col("i") + 0.5) / F.col("n")
    nx, ny = (F.col("y2") - F.col("y")) / F.col("length"), -(F.col("x2") - F.col("x")) / F.col("length")
    return s.select(
        *keys, "seq", "i", "level",
        F.round(F.col("x") + (F.col("x2") - F.col("x")) * share + nx * offset, 6).alias("px"),
        F.round(F.col("y") + (F.col("y2") - F.col("y")) * share + ny * offset, 6).alias("py"),
        F.round((F.col("level") + 0.5) * F.col(height) / F.col("levels"), 6).alias("pz"),
        F.round(nx, 6).alias("nx"), F.round(ny, 6).alias("ny"),
        F.round(F.col("length") / F.col("n") * F.col(height) / F.col("levels"), 6).alias("area"),
    )


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edge ends at each node; a loop has two."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def shortest_parallel(edges: DataFrame, a: str, b: str, length: str) -> DataFrame:
    """Of the edges between two nodes, either way, the shortest."""
    best = edges.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.min(length).alias("length"), F.count(F.lit(1)).alias("parallel"))
    return best


def nearest_segment(points: DataFrame, runs: DataFrame, on: str, cap: float) -> DataFrame:
    """The nearest segment (run, ax, ay, bx, by) of the same `on` to each point (p, px, py), no farther than cap.

    Points of one place are looked up once, and of segments that coincide only the first is; a segment is listed by the
    grid cells, cap wide, of its box widened by the cap, and a place looks in its own.
    """
    def around(a: str, b: str) -> Column:
        return _cells(F.least(a, b) - cap, F.greatest(a, b) + cap, cap)

    line = ["ax", "ay", "bx", "by"]
    listed = runs.groupBy(on, *line).agg(F.min("run").alias("run")).withColumn("_cx", F.explode(around("ax", "bx"))).withColumn("_cy", F.explode(around("ay", "by")))
    places = points.select(on, "px", "py").distinct().withColumns({"_cx": F.floor(F.col("px") / cap), "_cy": F.floor(F.col("py") / cap)})
    t = places.join(listed.hint("merge"), [on, "_cx", "_cy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    u = F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    ex, ey = F.col("px") - F.col("ax") - u * dx, F.col("py") - F.col("ay") - u * dy
    d = F.sqrt(ex * ex + ey * ey)
    near = t.select(on, "px", "py", "run", d.alias("d")).where(F.col("d") <= cap)
    best = near.groupBy(on, "px", "py").agg(F.min("d").alias("d"), F.min_by("run", F.struct("d", "run")).alias("run"))
    found = points.select(on, "p", "px", "py").join(best.hint("merge"), [on, "px", "py"])
    return found.groupBy(on, "p").agg(F.min(F.struct("d", "run")).alias("b")).select(on, "p", "b.run", F.round("b.d", 6).alias("distance"))


def geojson(rows: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """One closed polygon feature as text for each ring of points, with the given columns as properties."""
    points = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    made = rows.groupBy(*keys).agg(points.alias("p"), *[F.first(x).alias(x) for x in properties if x not in keys])
    ring = F.array(F.concat("p", F.array(F.get("p", F.lit(0)))))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry")))
    return made.select(*keys, feature.alias("feature"))


def clip_rows(rings: DataFrame, keys: list[str], x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rings of points clipped to a rectangle side by side (Sutherland and Hodgman): keys, seq, x, y."""
    sides = [("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)]
    for axis, at, sign in sides:
        s = segments(rings, keys)
        a, b = (F.col(axis) - at) * sign, (F.col(f"{axis}2") - at) * sign
        u = a / (a - b)
        cut = F.struct((F.col("x") + (F.col("x2") - F.col("x")) * u).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * u).alias("y"))
        here = F.struct("x", "y")
        made = F.array_compact(F.array(F.when(a >= 0, here), F.when(((a >= 0) != (b >= 0)), cut)))
        t = s.select(*keys, "seq", F.posexplode(made).alias("i", "q"))
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "i"))
        rings = t.select(*keys, order.alias("seq"), "q.x", "q.y")
    return rings


def tags_match(tags: Column, wanted: dict[str, list[str]]) -> Column:
    """Whether a map of tags has any of the wanted values."""
    out = F.lit(False)
    for key, values in wanted.items():
        out = out | F.coalesce(tags[key].isin(*values), F.lit(False))
    return out


def self_crossings(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rings two of whose edges cross inside both, and how many pairs do. A ring is a bounded group."""
    s = segments(points, keys)
    other = s.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("seq", "x", "y", "x2", "y2")])
    t = s.join(other, keys).where("seq < o_seq")

    def side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
        return (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))

    a, b = ("x", "y", "x2", "y2"), ("o_x", "o_y", "o_x2", "o_y2")
    apart = (side(*a, *b[:2]) * side(*a, *b[2:]) < 0) & (side(*b, *a[:2]) * side(*b, *a[2:]) < 0)
    return t.where(apart).groupBy(*keys).agg(F.count(F.lit(1)).alias("crossings"))
