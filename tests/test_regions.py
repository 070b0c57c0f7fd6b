"""Contours, rankings, floods, necks, absorbing, horizons and scanlines on small cases with known answers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fabricloom.operators import contour, planar, ranking, rays, regions, scanline


def drawn(spark, rows, tile=0):
    cells = [(tile, ord(x) - 64, r, c) for r, line in enumerate(rows) for c, x in enumerate(line) if x.isupper()]
    return spark.createDataFrame(cells, "tile_id int, label int, r int, c int")


def test_pinched_contour_with_a_hole(spark):
    t = drawn(spark, ["AAA..", "A.A..", "AAAB.", "...BB"])
    loops = contour.loops(t, 5)
    facts = {(r.label, r.area): (r.edges, r.corners) for r in contour.loop_facts(loops).collect()}
    assert facts == {(1, 9.0): (12, 4), (1, -1.0): (4, 4), (2, 3.0): (8, 6)}
    # two cells that touch at a corner are two loops, each turning right where they meet
    touching = contour.loops(drawn(spark, ["A.", ".A"]), 2)
    assert sorted((r.edges, r.area) for r in contour.loop_facts(touching).collect()) == [(4, 1.0), (4, 1.0)]
    # a region that closes round a cell but for a corner: what is open meets at the corner, so the one loop goes in and out there
    ring = contour.loops(drawn(spark, ["AAA", "A.A", ".AA"]), 3)
    assert [(r.edges, r.area) for r in contour.loop_facts(ring).collect()] == [(16, 7.0)]
    for r in loops.groupBy("label", "loop").agg(F.sort_array(F.collect_list("seq")).alias("s")).collect():
        assert r.s == list(range(len(r.s)))
    assert contour.loops(t.limit(0), 5).count() == 0


def test_rankings(spark):
    rng = random.Random(1)
    rings, lists = [], []
    for tile, n in enumerate([1, 2, 3, 17, 64]):
        ids = rng.sample(range(1000), n)
        rings += [(tile, a, b) for a, b in zip(ids, ids[1:] + ids[:1])]
        lists += [(tile, a, b) for a, b in zip(ids, [None, *ids])]
    got = ranking.ring_ranks(spark.createDataFrame(rings, "t int, id bigint, next bigint"), ["t"]).collect()
    follow = {(t, a): b for t, a, b in rings}
    for r in got:
        at = r.ring
        for _ in range(r.seq):
            at = follow[r.t, at]
        assert at == r.id and r.ring == min(a for t, a, _ in rings if t == r.t) and r.size == sum(t == r.t for t, *_ in rings)
    assert len(got) == len(rings)
    closed = [(9, 1, 2), (9, 2, 1)]
    got = ranking.list_ranks(spark.createDataFrame(lists + closed, "t int, id bigint, prev bigint"), ["t"]).collect()
    prev = {(t, a): b for t, a, b in lists}
    for r in got:
        at, steps = r.id, 0
        while prev[r.t, at] is not None:
            at, steps = prev[r.t, at], steps + 1
        assert (at, steps) == (r.head, r.seq)
    assert len(got) == len(lists)


def test_flood_meets_at_the_neck(spark):
    values = [[3, 5, 2, 4, 3], [0, 0, 0, 0, 9]]
    cells = spark.createDataFrame([(0, r, c, v) for r, row in enumerate(values) for c, v in enumerate(row) if v], "tile_id int, r int, c int, value int")
    marks = spark.createDataFrame([(0, 0, 1, 7), (0, 1, 4, 8)], "tile_id int, r int, c int, label int")
    got = {(r.r, r.c): r.label for r in regions.flood(cells, marks, 5).collect()}
    assert got == {(0, 0): 7, (0, 1): 7, (0, 2): 7, (0, 3): 8, (0, 4): 8, (1, 4): 8}
    flooded = spark.createDataFrame([(0, *k, v) for k, v in got.items()], "tile_id int, r int, c int, label bigint").join(cells, ["tile_id", "r", "c"])
    labels = lambda ratio: {r.label for r in regions.merge_necks(flooded, ratio, 5).collect()}
    assert labels(0.9) == {7, 8} and labels(0.8) == {7}  # the neck is 4, the lesser peak 5
    alone = regions.flood(cells, marks.limit(0), 5)
    assert alone.count() == 6 and alone.where("label IS NOT NULL").count() == 0


def test_absorbing_equals_one_by_one(spark):
    rng, side = random.Random(3), 9
    grid = [[rng.choice([1, 1, 2, 3]) for _ in range(side)] for _ in range(side)]
    cells = spark.createDataFrame([(0, r, c, grid[r][c]) for r in range(side) for c in range(side)], "tile_id int, r int, c int, v int")
    start = regions.same_value_regions(cells, "v", side).select("tile_id", "r", "c", "label")
    label = {(x.r, x.c): x.label for x in start.collect()}
    got = {(x.r, x.c): x.label for x in regions.absorb(start, 5, side).collect()}
    while True:
        sizes = {k: sum(v == k for v in label.values()) for k in set(label.values())}
        borders = {}
        for (r, c), a in label.items():
            for q in ((r + 1, c), (r, c + 1), (r - 1, c), (r, c - 1)):
                if q in label and label[q] != a:
                    borders.setdefault(a, {}).setdefault(label[q], 0)
                    borders[a][label[q]] += 1
        small = sorted((n, k) for k, n in sizes.items() if n < 5 and k in borders)
        if not small:
            break
        gone = small[0][1]
        to = max(borders[gone], key=lambda b: (borders[gone][b], -b))
        label = {p: to if v == gone else v for p, v in label.items()}
    assert got == label and len(set(got.values())) > 1


def test_shade_of_one_tower(spark):
    side = 16
    cells = spark.createDataFrame([(0, r, c, 40 if (r, c) == (8, 8) else 0) for r in range(side) for c in range(side)], "tile_id int, r int, c int, h int")
    got = {(r.sun, r.r, r.c): r.shade for r in rays.horizon_field(cells, [(45.0, 90.0), (45.0, 180.0)], 10.0, side).collect()}
    assert all(abs(got[0, 8, 8 - k] - (40 - 10 * k)) < 1e-6 for k in (1, 2, 3)) and got[0, 7, 6] < 0  # sun in the east: shade to the west
    assert abs(got[1, 6, 8] - 20) < 1e-6 and got[0, 0, 15] is None  # sun in the south: shade to the north


def test_rays_equal_plain_steps(spark):
    side, rng = 20, np.random.default_rng(5)
    h = np.where(rng.random((side, side)) < 0.2, rng.integers(4, 40, (side, side)), 0)
    cells = spark.createDataFrame([(0, r, c, "green", int(h[r, c])) for r in range(side) for c in range(side)], "tile_id int, r int, c int, cls string, h int")
    eyes = [(0, k, float(rng.uniform(0, 19)), float(rng.uniform(0, 19)), float(rng.uniform(5, 45))) for k in range(30)]
    ways = [(0, k, j, float(rng.uniform(0, 360)), float(rng.uniform(-25, 25))) for k in range(30) for j in range(4)]
    out = rays.march(
        spark.createDataFrame(eyes, "tile_id int, eye int, row double, col double, z double"), cells,
        spark.createDataFrame(ways, "tile_id int, eye int, ray int, azimuth double, altitude double"), 10.0, side, 150.0, 4.0,
    )
    got = {(r.eye, r.ray): (r.sees, r.far) for r in out.collect()}
    for _, k, j, az, alt in ways:
        (_, _, row, col, z), a, e = eyes[k], math.radians(az), math.radians(alt)
        want = ("sky" if alt > 0 else "open", None)
        for n in range(1, math.ceil(150 / 4) + 1):
            y, x, at = row - math.cos(a) * math.cos(e) * 0.4 * n, col + math.sin(a) * math.cos(e) * 0.4 * n, z + math.sin(e) * 4 * n
            if not (-0.5 <= y <= side - 0.5 and -0.5 <= x <= side - 0.5):
                break
            v, u = min(max(y, 0), side - 1), min(max(x, 0), side - 1)
            r, c = int(v), int(u)
            r1, c1 = min(r + 1, side - 1), min(c + 1, side - 1)
            field = (h[r, c] * (1 - u + c) + h[r, c1] * (u - c)) * (1 - v + r) + (h[r1, c] * (1 - u + c) + h[r1, c1] * (u - c)) * (v - r)
            if at <= field:
                want = ("building" if field > 0.5 else "green", 4.0 * n)
                break
        assert got[k, j] == want


def test_scanlines_of_a_ring_with_a_hole(spark):
    square = lambda ring, a, b: [(0, 1, ring, i, float(x), float(y), 9) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    rings = spark.createDataFrame(square(0, -2, 6) + square(1, 2, 4), "place int, id int, ring int, seq int, x double, y double, h int")
    got = {(r.r, r.c): (r.share, r.h) for r in scanline.rasterise(rings, ["place"], "id", "h", 2.0, 5, 4).collect()}
    assert got == {(r, c): (1.0, 9.0) for r in range(3) for c in range(3) if (r, c) != (1, 1)}


def test_faces_of_two_squares_and_a_spur(spark):
    places = {1: (0, 0), 2: (2, 0), 3: (2, 2), 4: (0, 2), 5: (3, 0), 6: (3, 2), 7: (1, 1)}
    pairs = [(1, 2), (2, 3), (3, 4), (1, 4), (2, 5), (5, 6), (3, 6), (1, 7)]  # 7 hangs inside the larger square
    nodes = spark.createDataFrame([(0, n, float(x), float(y)) for n, (x, y) in places.items()], "tile_id int, node bigint, x double, y double")
    edges = spark.createDataFrame([(0, a, b) for a, b in pairs], "tile_id int, a bigint, b bigint")
    got = {(r.area, r.size) for r in planar.faces(nodes, edges).collect()}
    assert got == {(4.0, 6), (2.0, 4), (-6.0, 6)}
    left, kept = planar.collapsed(nodes, edges, 3.0)
    assert {(r.node, r.x, r.y, r.nodes) for r in left.collect()} == {(1, 0.0, 0.0, 1), (2, 2.5, 1.0, 4), (4, 0.0, 2.0, 1), (7, 1.0, 1.0, 1)}
    assert {(r.a, r.b) for r in kept.collect()} == {(1, 2), (2, 4), (1, 4), (1, 7)}


def test_runs_turn_and_meet(spark):
    along = [(0, 1, x, 0) for x in range(10)] + [(0, 2, 4, y) for y in range(1, 9)] + [(0, 3, 0, y) for y in range(9)] + [(0, 4, 5, 5)]
    runs = planar.snapped(planar.straight_runs(spark.createDataFrame(along, "tile_id int, path int, x int, y int"), ["tile_id", "path"]), 12.0)
    got = {r.path: (r.n, round(r.cx, 6), round(r.cy, 6), round(r.angle, 6), round(r.rms, 6)) for r in runs.collect()}
    assert got[1] == (10, 4.5, 0, 0, 0) and got[2][:3] == (8, 4, 4.5) and abs(abs(got[2][3]) - math.pi / 2) < 1e-6 and got[4] == (1, 5, 5, 0, 0)
    node = spark.createDataFrame([(0, 1, 4.4, 0.6), (0, 2, 30.0, 30.0), (0, 3, 9.0, 9.0)], "tile_id int, node int, x double, y double")
    meets = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 2, 1)], "tile_id int, node int, path int").join(runs, ["tile_id", "path"])
    at = {r.node: (r.x, r.y) for r in planar.placed(node, meets, 1.5).collect()}
    assert abs(at[1][0] - 4) < 0.1 and abs(at[1][1]) < 0.1 and abs(math.dist(at[2], (30, 30)) - 1.5) < 1e-9 and at[3] == (9, 9)
