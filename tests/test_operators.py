"""Graphs, lines, tile facts, overlays and masks on small cases with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabricloom.functions import projection
from fabricloom.operators import codec, graph, metrics, requests, tiles_np
from fabricloom.sources.cells import full_cells
from oracle import SMALL


def test_tile_facts_equal_the_tables(spark):
    grid = full_cells(spark, SMALL).cache()
    facts = {r.tile_id: r for r in tiles_np.tile_facts(grid, 12.5, 32).collect()}
    street = F.col("cls") == "street"
    for on, eight, name in ((F.col("cls") == "building", False, "building_count"), (street, True, "street_components"), (~street, False, "block_count")):
        n = tiles_np.components(grid, on, eight, 32).groupBy("tile_id").agg(F.count_distinct("label").alias("n"))
        assert {r.tile_id: r.n for r in n.collect()} == {k: getattr(r, name) for k, r in facts.items()}
    for r in tiles_np.skeleton_facts(tiles_np.skeletons(grid, street, 32), 12.5, 32).collect():
        f = facts[r.tile_id]
        assert (r.dead_ends, r.intersections) == (f.dead_ends, f.intersections) and abs(r.street_length_m - f.street_length_m) < 1e-3


def drawn(spark, rows):
    cells = [(0, r, c) for r, line in enumerate(rows) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(cells, "tile_id int, r int, c int")


def street_graph(spark, rows, side):
    thin = drawn(spark, rows)
    nodes, paths = graph.skeleton_nodes(thin, side)
    cells = thin.join(paths.select("tile_id", "r", "c"), ["tile_id", "r", "c"], "left_anti")
    at = tiles_np.components(cells.withColumn("on", F.lit(True)), F.col("on"), True, side).withColumnRenamed("label", "node")
    return graph.skeleton_edges(nodes, paths, at, side)


def test_a_cross_is_one_node_and_four_edges(spark):
    nodes, edges = street_graph(spark, ["....#....", "....#....", "....#....", "....#....", "#########", "....#....", "....#....", "....#....", "....#...."], 9)
    rows = edges.collect()
    assert len(rows) == 4 and len({r.a for r in rows} & {r.b for r in rows}) <= 1 and nodes.count() == 5
    centre = [n for n in nodes.collect() if n.node < 81]
    assert [(n.x, n.y) for n in centre] == [(4.5, 4.5)]
    assert all(abs(r.length - 4.0) < 1e-9 for r in rows)


def edge_table(spark, nodes, lines):
    n = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in nodes.items()], "tile_id int, node int, x double, y double")
    e = spark.createDataFrame([(0, k, a, b, [(i, float(x), float(y)) for i, (x, y) in enumerate(p)]) for k, (a, b, p) in enumerate(lines, 1)], f"tile_id int, edge int, a int, b int, points {graph.POINTS}")
    return n, graph.measured(e, n)


def test_cleaning_leaves_the_streets(spark):
    """A long street with a spur, a node of degree two, a short link between two junctions and a piece that stands alone."""
    nodes = {1: (0, 0), 2: (10, 0), 3: (20, 0), 4: (10, 2), 5: (22, 0), 6: (40, 0), 7: (22, 15), 8: (20, -15), 9: (90, 90), 10: (91, 90)}
    lines = [(1, 2, []), (2, 3, []), (2, 4, []), (3, 5, []), (5, 6, []), (5, 7, []), (3, 8, []), (9, 10, [])]
    n, e = graph.clean(*edge_table(spark, nodes, lines), spur=5.0, isolated=5.0, short=4.0)
    rows = sorted((min(r.a, r.b), max(r.a, r.b), round(r.length, 3)) for r in e.collect())
    assert [r[:2] for r in rows] == [(1, 3), (3, 6), (3, 7), (3, 8)]
    assert {(r.node, r.x, r.y) for r in n.collect()} == {(1, 0, 0), (3, 21, 0), (6, 40, 0), (7, 22, 15), (8, 20, -15)}
    assert rows[0][2] == 21.0 and rows[1][2] == 19.0


def test_lines_equal_one_by_one(spark):
    rng = np.random.default_rng(2)
    lines = [rng.normal(size=(n, 2)).cumsum(0) for n in (2, 3, 40, 200)] + [np.zeros((5, 2))]
    t = spark.createDataFrame([(k, i, float(x), float(y)) for k, p in enumerate(lines) for i, (x, y) in enumerate(p)], "k int, seq int, x double, y double")
    got = {}
    for r in graph.simplified(t, ["k"], 1.2).collect():
        got.setdefault(r.k, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(set(graph.douglas_peucker(p, 1.2))) for k, p in enumerate(lines)}


def test_projection_goes_round_and_keeps_its_scale(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-79, 83), rng.uniform(-179.9, 179.9)) for _ in range(300)] + [(0.0, 3.0), (51.4, 3.0)]
    t = spark.createDataFrame(rows, "lat double, lon double").withColumn("z", projection.zone(F.col("lon")))
    east, north = projection.forward(F.col("lat"), F.col("lon"), F.col("z"))
    t = t.withColumn("e", east).withColumn("n", north)
    lat, lon = projection.inverse(F.col("e"), F.col("n"), F.col("z"))
    for r in t.withColumn("la", lat).withColumn("lo", lon).collect():
        assert abs(r.la - r.lat) < 1e-8 and abs(r.lo - r.lon) < 1e-7
        if r.lon == 3.0:  # on the middle meridian north is the scaled arc of the meridian
            assert abs(r.e - 500000) < 1e-6
    quarter = t.where("lat = 0").first()
    assert abs(quarter.n) < 1e-6


def test_overlays_and_nulls(spark):
    def m(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.lit(None).cast("map<string,string>")

    laid = requests.overlay(m({"a": "1", "b": "2"}), m(None), m({"b": "3", "c": "4"}))
    assert list(spark.range(1).select(laid).first()[0].items()) == [("a", "1"), ("b", "3"), ("c", "4")]
    with pytest.raises(ValueError, match="beauty"):
        metrics.measure(spark.range(0).selectExpr("1 tile_id", "'x' cls", "1 h"), ["beauty"], 400.0, 32)


def test_resize_weights_sum_to_one():
    for old, new in ((32, 12), (10, 10), (5, 9)):
        sums = {}
        for i, _, w in codec.weights(old, new):
            sums[i] = sums.get(i, 0) + w
        assert sorted(sums) == list(range(new)) and all(math.isclose(s, 1) for s in sums.values())


def test_newton_steps(spark):
    from fabricloom.operators import newton

    rows = [("one", 5.0, -2.0, 0.0), ("there", 1.0, 1.0, 0.0), ("null", None, 1.0, 0.0)]
    t = spark.createDataFrame(rows, "name string, t0 double, t1 double, o double").withColumns(
        {"w0": F.array(F.lit(1.0), F.lit(1.0), F.lit(7.0)), "j0": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), "j1": F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))}
    )
    run = lambda cap, most: {r.name: r for r in newton.towards(t, "w0", ("t0", "t1"), ("o", "o"), ("j0", "j1"), 0.0, cap, 1e-6, most).collect()}
    free, short = run(100.0, 9), run(2.0, 9)
    assert free["one"].w == [5.0, -2.0, 7.0] and free["one"].steps == 1 and free["there"].steps == 0
    assert short["one"].steps == 3 and max(abs(a - b) for a, b in zip(short["one"].w, [5.0, -2.0, 7.0])) < 1e-9  # 5 away, 2 a step
    assert run(2.0, 2)["one"].miss > 0.5 and free["null"].miss is None
