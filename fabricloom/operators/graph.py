"""Street graphs from thinned cells: nodes, edges and their points, cleaning, simplified lines.

Cells become an edge list by equi-joins on neighbours; chains between nodes come from components of a tile, which is a
bounded group, and are put in order by pointer doubling; cleaning goes in rounds of joins on nodes, each of which treats all edges at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds, passing_path, written
from . import raster, tiles_np
from .ranking import list_ranks

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
POINTS = "array<struct<seq: int, x: double, y: double>>"


def skeleton_parts(skeleton: DataFrame, side: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Junction nodes, path cells and junction cells of thinned cells (tile_id, r, c). Cells with three neighbours or more are
    junctions; those that touch are one node (tile_id, node: its least cell number, x, y: their middle). The rest are paths
    (tile_id, r, c, path: the least cell number of the cells that touch). Junction cells are tile_id, r, c, node."""
    near = raster.neighbours(skeleton, ["r"], AROUND).groupBy("tile_id", "r", "c").agg(F.count(F.lit(1)).alias("n"))
    counted = skeleton.join(near, ["tile_id", "r", "c"], "left").select("tile_id", "r", "c", (F.coalesce("n", F.lit(0)) >= 3).alias("on"))
    labels = written(counted.groupBy("tile_id").applyInPandas(tiles_np.two_labels(side), "tile_id int, r int, c int, junction boolean, label int"), "skeleton-labels")
    cells = labels.where("junction").select("tile_id", "r", "c", F.col("label").alias("node"))
    nodes = cells.groupBy("tile_id", "node").agg((F.avg("c") + 0.5).alias("x"), (F.avg("r") + 0.5).alias("y"))
    return nodes, labels.where("not junction").select("tile_id", "r", "c", F.col("label").alias("path")), cells


def skeleton_nodes(skeleton: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """The nodes and paths of skeleton_parts."""
    return skeleton_parts(skeleton, side)[:2]


def path_order(paths: DataFrame, side: int) -> DataFrame:
    """The cells of paths (tile_id, r, c, path) in order: seq from 0 on, from the end (or of a ring the cell) with the least number; a
    ring goes straight before diagonally, then to the least number. Each cell of a path touches at most two others of it.

    Steps from cell to cell, both ways, are lists that pointer doubling ranks, so no task walks along a path.
    """
    number = (F.col("r") * side + F.col("c") + 1).cast("long")
    cells = paths.select("tile_id", "path", "r", "c", number.alias("u"))
    near = raster.neighbours(cells.withColumns({"v": F.col("u"), "rr": F.col("r"), "cc": F.col("c")}), ["path", "v", "rr", "cc"], AROUND).where("path = n_path")
    bend = F.abs(F.col("r") - F.col("n_rr")) + F.abs(F.col("c") - F.col("n_cc"))
    steps = written(near.select("tile_id", "path", "u", F.col("n_v").alias("v"), bend.alias("bend")), "path-steps")
    degree = steps.groupBy("tile_id", "path", "u").agg(F.count(F.lit(1)).alias("n"))
    known = cells.join(degree, ["tile_id", "path", "u"], "left").withColumn("end", F.coalesce("n", F.lit(0)) < 2)
    first = known.groupBy("tile_id", "path").agg(F.coalesce(F.min(F.when(F.col("end"), F.col("u"))), F.min("u")).alias("start"), F.bool_or("end").alias("open"))
    first = written(first, "path-starts")
    step_id = lambda u, v: F.col(u) * (side * side + 1) + F.col(v)
    begin = steps.join(first.select("tile_id", "path", F.col("start").alias("u")), ["tile_id", "path", "u"]).groupBy("tile_id", "path").agg(F.min(F.struct("bend", "v", "u")).alias("s"))
    begin = begin.select("tile_id", "path", (F.col("s.u") * (side * side + 1) + F.col("s.v")).alias("head"))
    before = steps.select("tile_id", "path", F.col("v").alias("u"), F.col("u").alias("w"))
    links = steps.join(before, ["tile_id", "path", "u"]).where("w <> v").select("tile_id", "path", "u", "v", step_id("w", "u").alias("prev"))
    links = steps.select("tile_id", "path", "u", "v").join(links, ["tile_id", "path", "u", "v"], "left").withColumn("id", step_id("u", "v"))
    links = links.join(begin.select("tile_id", "path", F.col("head").alias("id"), F.lit(True).alias("cut")), ["tile_id", "path", "id"], "left")
    links = written(links.select("tile_id", "path", "u", "v", "id", F.when(F.col("cut").isNull(), F.col("prev")).alias("prev")), "path-links")
    ranked = list_ranks(links.select("tile_id", "path", "id", "prev"), ["tile_id", "path"], "path-ranks").join(begin, ["tile_id", "path", "head"], "left_semi")
    ranked = links.join(ranked.select("tile_id", "path", "id", "seq"), ["tile_id", "path", "id"]).join(first, ["tile_id", "path"])
    last = F.max("seq").over(Window.partitionBy("tile_id", "path"))
    onward = F.when(F.col("open") & (F.col("seq") == F.col("last")), F.array(F.struct("u", "seq"), F.struct(F.col("v").alias("u"), (F.col("seq") + 1).alias("seq")))).otherwise(F.array(F.struct("u", "seq")))
    order = ranked.withColumn("last", last).select("tile_id", "path", F.inline(onward))
    alone = known.where("n IS NULL").select("tile_id", "path", "u", F.lit(0).cast("long").alias("seq"))
    back = [F.col("seq").cast("int").alias("seq"), F.floor((F.col("u") - 1) / side).cast("int").alias("r"), ((F.col("u") - 1) % side).cast("int").alias("c")]
    return order.unionByName(alone).select("tile_id", "path", *back)


def skeleton_edges(nodes: DataFrame, paths: DataFrame, junctions: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: each path runs from the node it touches at its first cell to the one at its last; a free end is a
    node of its own. Edges: tile_id, edge, a, b, length in cells with the ways to both nodes, and its points in order.

    junctions: cells (tile_id, r, c, node). A node that is a free end has the number of its cell, from the side squared
    on, so it is no junction's.
    """
    order = written(path_order(paths, side), "path-order")
    last = F.max("seq").over(Window.partitionBy("tile_id", "path"))
    order = order.withColumn("last", last)
    ends = order.where("seq = 0").withColumn("first", F.lit(True)).unionByName(order.where("seq = last").withColumn("first", F.lit(False)))
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
    touch = ends.select("tile_id", "path", "first", "last", F.col("r").alias("r0"), F.col("c").alias("c0"), "r", "c", o.alias("o"))
    touch = touch.withColumn("r", F.col("r") + F.col("o.a")).withColumn("c", F.col("c") + F.col("o.b")).join(junctions, ["tile_id", "r", "c"], "left")
    at = touch.groupBy("tile_id", "path", "first", "last", "r0", "c0").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    free = F.col("r0") * side + F.col("c0") + side * side + F.when(F.col("last") == 0, F.when(F.col("first"), 0).otherwise(side * side)).otherwise(0)
    both = at.groupBy("tile_id", "path", "last").agg(
        F.max(F.when(F.col("first"), F.struct("nodes", free.alias("free")))).alias("s"), F.max(F.when(~F.col("first"), F.struct("nodes", free.alias("free")))).alias("e")
    )
    a = F.coalesce(F.get("s.nodes", F.lit(0)), F.col("s.free"))
    # a path that touches several nodes at its end goes on to another one than it came from, where there is one
    others = F.filter("e.nodes", lambda n: n != F.col("a"))
    one_cell = F.col("last") == 0
    both = both.withColumn("a", a).withColumn("b", F.when(one_cell, F.coalesce(F.get(others, F.lit(0)), F.col("e.free"))).otherwise(F.coalesce(F.get(others, F.lit(0)), F.get("e.nodes", F.lit(0)), F.col("e.free"))))
    edges = both.select("tile_id", F.col("path").alias("edge"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    place = ends.select("tile_id", "path", "first", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    loose = edges.select("tile_id", F.col("edge").alias("path"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("first")), F.struct(F.col("b").alias("node"), F.lit(False).alias("first")))).alias("n"))
    loose = loose.select("tile_id", "path", "n.*").where(F.col("node") >= side * side).join(place, ["tile_id", "path", "first"]).select("tile_id", "node", "x", "y")
    all_nodes = nodes.unionByName(loose.groupBy("tile_id", "node").agg(F.min("x").alias("x"), F.min("y").alias("y")))
    points = order.groupBy("tile_id", F.col("path").alias("edge")).agg(F.sort_array(F.collect_list(F.struct("seq", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y")))).alias("points"))
    return all_nodes, measured(edges.join(points, ["tile_id", "edge"]), all_nodes)


def line_length(points: Column) -> Column:
    """Length of a line of points."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.hypot(F.get(points, i)["x"] - F.get(points, i - 1)["x"], F.get(points, i)["y"] - F.get(points, i - 1)["y"]))
    return F.when(F.size(points) > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def measured(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds length: along the points of each edge, from its one node to its other."""
    for end in ("a", "b"):
        at = nodes.select("tile_id", F.col("node").alias(end), F.struct(F.lit(-1).alias("seq"), "x", "y").alias(f"_{end}"))
        edges = edges.drop("length").join(at, ["tile_id", end])
    whole = F.concat(F.array("_a"), "points", F.array("_b"))
    return edges.withColumn("_w", whole).withColumn("length", line_length(F.col("_w"))).select("tile_id", "edge", "a", "b", "length", "points")


def split_loops(nodes: DataFrame, edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Edges from a node back to it become two that meet at the point farthest from the node, the first of equals; loops
    that go less far are dropped. Edges of under three points stay."""
    loop = (F.col("a") == F.col("b")) & (F.size("points") >= 3)
    at = nodes.select("tile_id", F.col("node").alias("a"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    far = F.transform("points", lambda p, i: F.struct((-F.hypot(p["x"] - F.col("_x"), p["y"] - F.col("_y"))).alias("d"), i.alias("i"), p.alias("p")))
    t = edges.where(loop).join(at, ["tile_id", "a"]).withColumn("_f", F.array_min(far)).where(-F.col("_f.d") >= least)
    t = t.withColumn("_new", (-F.col("edge")).cast("int"))
    half = F.explode(F.array(
        F.struct((F.col("edge") * 2).alias("edge"), F.col("a").alias("a"), F.col("_new").alias("b"), F.slice("points", F.lit(1), F.col("_f.i")).alias("points")),
        F.struct((F.col("edge") * 2 + 1).alias("edge"), F.col("_new").alias("a"), F.col("b").alias("b"), F.slice("points", F.col("_f.i") + 2, F.size("points")).alias("points")),
    ))
    halves = t.select("tile_id", half.alias("h")).select("tile_id", "h.*")
    kept = edges.where(~loop).select("tile_id", (F.col("edge") * 2).alias("edge"), "a", "b", "points")
    out_nodes = nodes.unionByName(t.select("tile_id", F.col("_new").alias("node"), F.col("_f.p.x").alias("x"), F.col("_f.p.y").alias("y")))
    return out_nodes, measured(kept.unionByName(halves), out_nodes)


def _degree(edges: DataFrame) -> DataFrame:
    ends = edges.select("tile_id", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("tile_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def trimmed(edges: DataFrame, spur: float, isolated: float, loop: float) -> DataFrame:
    """One round: without edges that stand alone, spurs and loops shorter than their bounds."""
    for end in ("a", "b"):
        edges = edges.join(_degree(edges).select("tile_id", F.col("node").alias(end), F.col("degree").alias(f"_d{end}")), ["tile_id", end])
    alone = (F.col("_da") == 1) & (F.col("_db") == 1) & (F.col("length") < isolated)
    short = ((F.col("_da") == 1) != (F.col("_db") == 1)) & (F.col("length") < spur)
    tiny = (F.col("a") == F.col("b")) & (F.col("length") < loop)
    return edges.where(~(alone | short | tiny)).select("tile_id", "edge", "a", "b", "length", "points")


def contracted(nodes: DataFrame, edges: DataFrame, short: float) -> tuple[DataFrame, DataFrame]:
    """One round: edges shorter than that between two nodes with other edges vanish. Of short edges that meet only the
    shortest at both of its nodes goes in a round; its nodes become one, in their middle."""
    t = edges
    for end in ("a", "b"):
        t = t.join(_degree(edges).select("tile_id", F.col("node").alias(end), F.col("degree").alias(f"_d{end}")), ["tile_id", end])
    t = t.where((F.col("a") != F.col("b")) & (F.col("length") < short) & (F.col("_da") >= 2) & (F.col("_db") >= 2))
    claim = t.select("tile_id", F.struct("length", "edge").alias("_k"), F.explode(F.array("a", "b")).alias("node"))
    best = claim.groupBy("tile_id", "node").agg(F.min("_k").alias("_k"))
    for end in ("a", "b"):
        t = t.join(best.select("tile_id", F.col("node").alias(end), F.col("_k").alias(f"_k{end}")), ["tile_id", end])
    gone = t.where((F.col("_ka.edge") == F.col("edge")) & (F.col("_kb.edge") == F.col("edge"))).select("tile_id", "edge", F.least("a", "b").alias("to"), F.greatest("a", "b").alias("node"))
    kept = edges.join(gone.select("tile_id", "edge"), ["tile_id", "edge"], "left_anti").drop("length")
    for end in ("a", "b"):
        kept = kept.join(gone.select("tile_id", F.col("node").alias(end), F.col("to").alias("_to")), ["tile_id", end], "left")
        kept = kept.withColumn(end, F.coalesce("_to", end)).drop("_to")
    moved = nodes.join(gone.select("tile_id", "node", "to"), ["tile_id", "node"], "left").withColumn("node", F.coalesce("to", "node"))
    moved = moved.groupBy("tile_id", "node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return moved, measured(kept.select("tile_id", "edge", "a", "b", "points"), moved)


def dissolved(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: nodes with just two edges, of two other nodes, give way to one edge. Of such nodes that share an edge only
    the one with the least number goes in a round; an edge that would become a loop stays two."""
    ends = edges.select("tile_id", "edge", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("far"), F.lit(True).alias("starts")), F.struct(F.col("b").alias("node"), F.col("a").alias("far"), F.lit(False).alias("starts")))).alias("e"))
    ends = ends.select("tile_id", "edge", "e.*")
    two = ends.groupBy("tile_id", "node").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge").alias("m"), F.count_distinct("far").alias("k"))
    two = two.where("n = 2 and m = 2 and k = 2").select("tile_id", "node")
    mine = ends.join(two, ["tile_id", "node"]).where("node != far")
    first = mine.groupBy("tile_id", "edge").agg(F.min("node").alias("_first"))
    good = mine.join(first, ["tile_id", "edge"]).groupBy("tile_id", "node").agg(F.bool_and(F.col("_first") == F.col("node")).alias("ok"), F.count(F.lit(1)).alias("n")).where("ok and n = 2")
    pair = mine.join(good.select("tile_id", "node"), ["tile_id", "node"]).join(edges.select("tile_id", "edge", "points"), ["tile_id", "edge"])
    away = F.when(F.col("starts"), F.col("points")).otherwise(F.reverse("points"))  # from the node on
    pair = pair.select("tile_id", "node", F.struct("edge", "far", away.alias("points")).alias("e")).groupBy("tile_id", "node").agg(F.min("e").alias("s"), F.max("e").alias("t"))
    at = nodes.select("tile_id", "node", F.array(F.struct(F.lit(0).alias("seq"), "x", "y")).alias("_at"))
    pair = pair.join(at, ["tile_id", "node"])
    joined = pair.select("tile_id", F.col("s.edge").alias("edge"), F.col("s.far").alias("a"), F.col("t.far").alias("b"), F.concat(F.reverse("s.points"), "_at", "t.points").alias("points"))
    used = pair.select("tile_id", F.explode(F.array("s.edge", "t.edge")).alias("edge"))
    kept = edges.join(used, ["tile_id", "edge"], "left_anti").select("tile_id", "edge", "a", "b", "points")
    left = nodes.join(pair.select("tile_id", "node"), ["tile_id", "node"], "left_anti")
    return left, measured(kept.unionByName(joined), left)


def clean(nodes: DataFrame, edges: DataFrame, spur: float, isolated: float, short: float, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Loops split, then rounds of trimming, contracting and dissolving; nodes without an edge go. Each round's tables
    are written, so that plans don't grow round by round."""
    nodes, edges = split_loops(nodes, edges, short)
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    for _ in range(rounds):
        edges = written(trimmed(edges, spur, isolated, 2 * short), "trimmed")
        nodes, edges = contracted(nodes, edges, short)
        nodes, edges = written(nodes, "nodes"), written(edges, "contracted")
        nodes, edges = dissolved(nodes, edges)
        nodes, edges = written(nodes, "nodes"), written(edges, "dissolved")
    return nodes.join(_degree(edges).select("tile_id", "node"), ["tile_id", "node"], "left_semi"), edges


def simplified(lines: DataFrame, keys: list[str], epsilon: float, most: int = 1 << 20) -> DataFrame:
    """Lines of points (keys, seq, x, y) by Douglas and Peucker: kept points. All open stretches of all lines are looked at once a
    round, and cut at their farthest point (the first of equals); one that has no point farther than epsilon from its
    chord is done, and its points leave. There are as many rounds as the deepest cut, each a window over stretches."""
    own = Window.partitionBy(*keys)
    ends = {"_aseq": F.min("seq"), "_bseq": F.max("seq"), **{f"_a{c}": F.min_by(c, "seq") for c in "xy"}, **{f"_b{c}": F.max_by(c, "seq") for c in "xy"}}
    rounds = Rounds(lines.withColumns({n: e.over(own) for n, e in ends.items()}), "simplified")
    kept = passing_path(lines.sparkSession, "simplified-kept")
    rounds.df.where("seq = _aseq OR seq = _bseq").select(*lines.columns).write.parquet(kept)
    t = rounds.df.where("seq > _aseq AND seq < _bseq").drop("_bseq")
    for _ in range(most):
        dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
        chord = F.hypot(dx, dy)
        off = F.when(chord < 1e-9, F.hypot(F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay"))).otherwise(F.abs(dx * (F.col("_ay") - F.col("y")) - dy * (F.col("_ax") - F.col("x"))) / chord)
        stretch, first = Window.partitionBy(*keys, "_aseq"), F.struct("_d", -F.col("seq"))
        s = t.withColumn("_d", F.round(off, 9)).withColumns({"_most": F.max("_d").over(stretch), **{f"_f{c}": F.max_by(c, first).over(stretch) for c in ("seq", "x", "y")}})
        t = rounds.next(s.where(F.col("_most") > epsilon).drop("_d", "_most"))
        if not t.head(1):
            break
        t.where("seq = _fseq").select(*lines.columns).write.mode("append").parquet(kept)
        after = F.col("seq") > F.col("_fseq")
        sides = {**{f"_a{c}": F.when(after, F.col(f"_f{c}")).otherwise(F.col(f"_a{c}")) for c in ("seq", "x", "y")}, **{f"_b{c}": F.when(after, F.col(f"_b{c}")).otherwise(F.col(f"_f{c}")) for c in "xy"}}
        t = t.where("seq != _fseq").withColumns(sides).drop("_fseq", "_fx", "_fy")
    return lines.sparkSession.read.schema(lines.schema).parquet(kept)


def douglas_peucker(points: np.ndarray, epsilon: float) -> list[int]:
    """The places of kept points, one line at a time; what simplified() is tested against."""
    def cut(i: int, j: int) -> list[int]:
        if j - i < 2:
            return []
        a, d = points[i], points[j] - points[i]
        length = np.hypot(*d)
        inner = points[i + 1 : j] - a
        off = np.round(np.hypot(*inner.T) if length < 1e-9 else np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length, 9)
        k = int(off.argmax())
        return [*cut(i, i + 1 + k), i + 1 + k, *cut(i + 1 + k, j)] if off[k] > epsilon else []

    return [0, *cut(0, len(points) - 1), len(points) - 1]
