"""Regions of cells as graphs that shrink in rounds of joins: components, flooding from markers, necks, absorbing what is small.

No heap and no walk in one task: each round treats all cells or regions at once, and leaves at most half of what is open.
Tables of nodes have (tile_id, id), tables of links (tile_id, a, b).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Rounds, written
from .ranking import list_ranks


def both_ways(links: DataFrame, *values: str) -> DataFrame:
    """Each link from both of its ends."""
    back = links.select("tile_id", F.col("b").alias("a"), F.col("a").alias("b"), *values)
    return links.select("tile_id", "a", "b", *values).unionByName(back)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds label to nodes: the least id that links lead to. Labels spread to neighbours and jump to their own label's label,
    so long chains shrink by doubling."""
    near = written(both_ways(links), "component-links")
    state, moved = Rounds(nodes.select("tile_id", "id", F.col("id").alias("label"), F.lit(True).alias("moved")), "components"), True
    while moved:
        t = state.df.drop("moved")
        heard = near.join(t.select("tile_id", F.col("id").alias("b"), F.col("label").alias("_label")), ["tile_id", "b"]).groupBy("tile_id", F.col("a").alias("id")).agg(F.min("_label").alias("_label"))
        t = t.join(heard, ["tile_id", "id"], "left").withColumn("_low", F.least("label", "_label"))
        jump = t.select("tile_id", F.col("id").alias("_low"), F.col("_low").alias("_far"))
        t = t.join(jump, ["tile_id", "_low"]).select("tile_id", "id", F.least("_low", "_far").alias("_new"), "label")
        moved = not state.next(t.select("tile_id", "id", F.col("_new").alias("label"), (F.col("_new") < F.col("label")).alias("moved"))).where("moved").isEmpty()
    return nodes.join(state.df.drop("moved"), ["tile_id", "id"])


def cell_links(cells: DataFrame, side: int, *values: str) -> DataFrame:
    """Links between cells (tile_id, r, c, values) that share an edge, a before b, numbered r * side + c + 1, with values of both."""
    t = cells.select("tile_id", "r", "c", (F.col("r") * side + F.col("c") + 1).cast("long").alias("a"), *values)
    step = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    ahead = t.select("*", step.alias("s")).select("tile_id", "a", *values, (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    there = t.select("tile_id", "r", "c", F.col("a").alias("b"), *[F.col(v).alias(f"b_{v}") for v in values])
    return ahead.join(there, ["tile_id", "r", "c"]).drop("r", "c")


def flood(cells: DataFrame, markers: DataFrame, side: int) -> DataFrame:
    """Floods cells (tile_id, r, c, value) from markers (tile_id, r, c, label; labels over 0), highest values first: tile_id, r, c,
    label, null where no marker leads.

    A cell gets the label that the best way brings, a way being as good as its lowest value. That is a spanning forest of the cells'
    links, each weighing the lesser value of its ends, that is rooted in the markers: in each round every tree without a
    marker takes its best link (of equal weights the one with the least cell numbers), and trees merge.
    """
    number = (F.col("r") * side + F.col("c") + 1).cast("long").alias("id")
    links = written(cell_links(cells, side, "value").select("tile_id", "a", "b", (-F.least("value", "b_value")).alias("cost")), "flood-links")
    start = cells.select("tile_id", "r", "c", number).join(markers.select("tile_id", "r", "c", "label"), ["tile_id", "r", "c"], "left")
    state = Rounds(start.select("tile_id", "id", F.coalesce(-F.col("label").cast("long"), "id").alias("tree")), "flood")  # trees with a marker: below 0
    while True:
        t = state.df
        ends = links.join(t.select("tile_id", F.col("id").alias("a"), F.col("tree").alias("ta")), ["tile_id", "a"]).join(t.select("tile_id", F.col("id").alias("b"), F.col("tree").alias("tb")), ["tile_id", "b"])
        ways = F.explode(F.array(F.struct(F.col("ta").alias("tree"), F.col("tb").alias("to")), F.struct(F.col("tb").alias("tree"), F.col("ta").alias("to"))))
        open_ = ends.where("ta <> tb").select("tile_id", F.struct("cost", "a", "b").alias("key"), ways.alias("w")).select("tile_id", "key", "w.*").where("tree > 0")
        best = written(open_.groupBy("tile_id", "tree").agg(F.min_by("to", "key").alias("to")), "flood-best")
        if best.isEmpty():
            break
        back = best.select("tile_id", F.col("tree").alias("to"), F.col("to").alias("_back"))
        parent = best.join(back, ["tile_id", "to"], "left")  # two trees may take one link: the lesser one stays
        parent = parent.select("tile_id", F.col("tree").alias("id"), F.when((F.col("_back") == F.col("tree")) & (F.col("tree") < F.col("to")), None).otherwise(F.col("to")).alias("prev"))
        ends_ = best.select("tile_id", F.col("to").alias("id")).distinct().join(best.select("tile_id", F.col("tree").alias("id")), ["tile_id", "id"], "left_anti")
        roots = list_ranks(parent.unionByName(ends_.withColumn("prev", F.lit(None).cast("long"))), ["tile_id"], "flood-trees")
        joined = t.join(roots.select("tile_id", F.col("id").alias("tree"), "head"), ["tile_id", "tree"], "left")
        state.next(joined.select("tile_id", "id", F.coalesce("head", "tree").alias("tree")))
    return state.df.select(
        "tile_id", F.floor((F.col("id") - 1) / side).cast("int").alias("r"), ((F.col("id") - 1) % side).cast("int").alias("c"), F.when(F.col("tree") < 0, -F.col("tree")).alias("label")
    )


def merge_necks(regions: DataFrame, ratio: float, side: int) -> DataFrame:
    """Joins regions (tile_id, r, c, value, label) that meet at no real neck: where the highest value along their common border
    is at least ratio times the lesser of their peaks. Labels are then the least of those joined."""
    peaks = regions.groupBy("tile_id", "label").agg(F.max("value").alias("peak"))
    links = cell_links(regions, side, "value", "label").where("label <> b_label")
    necks = links.groupBy("tile_id", F.least("label", "b_label").alias("a"), F.greatest("label", "b_label").alias("b")).agg(F.max(F.greatest("value", "b_value")).alias("neck"))
    for end in ("a", "b"):
        necks = necks.join(peaks.select("tile_id", F.col("label").alias(end), F.col("peak").alias(f"_{end}")), ["tile_id", end])
    wide = necks.where(F.col("neck") >= ratio * F.least("_a", "_b"))
    joined = components(peaks.select("tile_id", F.col("label").alias("id")), wide.select("tile_id", "a", "b"))
    return regions.join(joined.select("tile_id", F.col("id").alias("label"), F.col("label").alias("_to")), ["tile_id", "label"]).withColumn("label", F.col("_to")).drop("_to")


def absorb(regions: DataFrame, least: int, side: int) -> DataFrame:
    """Regions (tile_id, r, c, label) of fewer than `least` cells go into the neighbour that they share most edges with (of equals
    the one with the least label), smallest first, until none that has a neighbour is too small.

    In a round all go that are smaller than each small neighbour (of equals by label), so no region goes and takes one in at
    once, and the outcome is that of going one by one.
    """
    sizes = written(regions.groupBy("tile_id", F.col("label").alias("id")).agg(F.count(F.lit(1)).alias("size")), "absorb-sizes")
    links = cell_links(regions, side, "label").where("label <> b_label").groupBy("tile_id", F.col("label").alias("a"), F.col("b_label").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    borders = written(both_ways(links, "n").groupBy("tile_id", "a", "b").agg(F.sum("n").alias("n")), "absorb-borders")
    state = Rounds(sizes.select("tile_id", "id", F.col("id").alias("now"), F.lit(True).alias("moved")), "absorb")
    while True:
        t = state.df.drop("moved")
        size = t.join(sizes, ["tile_id", "id"]).groupBy("tile_id", F.col("now").alias("id")).agg(F.sum("size").alias("size"))
        at = borders
        for end in ("a", "b"):
            at = at.join(t.select("tile_id", F.col("id").alias(end), F.col("now").alias(f"_{end}")), ["tile_id", end])
        at = at.where("_a <> _b").groupBy("tile_id", F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("n").alias("n"))
        for end in ("a", "b"):
            at = at.join(size.select("tile_id", F.col("id").alias(end), F.struct("size", "id").alias(f"k{end}")), ["tile_id", end])
        small = at.where(F.col("ka.size") < least)
        first = F.bool_and((F.col("kb.size") >= least) | (F.col("ka") < F.col("kb")))
        pick = small.groupBy("tile_id", F.col("a").alias("now")).agg(first.alias("goes"), F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("to")).where("goes")
        new = t.join(pick.select("tile_id", "now", (-F.col("to.b")).alias("_to")), ["tile_id", "now"], "left")
        if state.next(new.select("tile_id", "id", F.coalesce("_to", "now").alias("now"), F.col("_to").isNotNull().alias("moved"))).where("moved").isEmpty():
            break
    named = state.df.select("tile_id", F.col("id").alias("label"), "now")
    return regions.join(named, ["tile_id", "label"]).withColumn("label", F.col("now")).drop("now")


def same_value_regions(cells: DataFrame, value: str, side: int) -> DataFrame:
    """Adds label: cells (tile_id, r, c, value) that touch and have the same value, by their least cell number."""
    links = cell_links(cells, side, value).where(F.col(value) == F.col(f"b_{value}"))
    nodes = cells.withColumn("id", (F.col("r") * side + F.col("c") + 1).cast("long"))
    return components(nodes, links).drop("id")
