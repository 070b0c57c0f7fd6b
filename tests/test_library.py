"""Files in and out, scenes with known answers, streams against batches, and golden tables where present."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabricloom.functions import heights, scalars
from fabricloom.operators import algebra, audit, raster, sinks, solar, space, stats, tiles_np, vector
from fabricloom.sources import files
from fabricloom.sources.cells import full_cells
from fabricloom.streaming import windows
from oracle import SMALL



def test_height_table_of_a_small_histogram(spark, tmp_path):
    """Bytes worked out by hand from the rule: mid-rank over 51 to 255, ends fixed, levels a step of at most 4 apart."""
    counts = {100: 50, 110: 1, 111: 1, 150: 30, 255: 18}
    hist = spark.createDataFrame([*counts.items(), (7, 0)], "grey int, n bigint")
    got = {r.grey: r.byte for r in heights.forward(hist).collect()}
    assert got == {100: 51, 110: 154, 111: 158, 150: 188, 255: 255}
    forward, n = ([0] * 256 for _ in range(2))
    for g, k in counts.items():
        forward[g], n[g] = got[g], k
    (tmp_path / "lut.json").write_text(json.dumps({"forward": forward, "counts": n, "inverse": [0] * 256}))
    levels, inverse = files.height_table(spark, str(tmp_path / "lut.json"))
    assert {r.grey: r.byte for r in levels.collect()} == got
    back = {r.b: r.grey for r in inverse.collect()}
    assert len(back) == 256 and all(back[v] == g for g, v in got.items()) and back[0] == 100 and back[156] == 110


@pytest.mark.parametrize("lat,decl,hours", [(41.39, 0, 12.0), (41.39, -23.44, 9.0), (59.91, -23.44, 5.55), (1.35, 0, 12.0), (-33.45, 23.44, 9.78), (52.23, 23.44, 16.54), (80, -23.44, 0), (80, 23.44, 24)])
def test_day_lengths(spark, lat, decl, hours):
    t = spark.range(1).select(F.lit(0).alias("place"), F.lit(float(lat)).alias("lat"), F.lit(float(decl)).alias("decl"))
    assert abs(t.select(scalars.day_length(F.col("lat"), F.col("decl"))).first()[0] - hours) < 0.05
    total = solar.positions(t, 30.0).agg(F.sum("hours"), F.min("altitude")).first()
    assert abs((total[0] or 0) - hours) < 0.05 and (total[1] is None or total[1] > 0)


def test_noon_sun_stands_south(spark):
    t = spark.range(1).select(F.lit(0).alias("place"), F.lit(41.0).alias("lat"), F.lit(0.0).alias("decl"))
    rows = solar.positions(t, 1.0).orderBy(F.desc("altitude")).limit(1).collect()
    assert abs(rows[0].azimuth - 180) < 0.5 and abs(rows[0].altitude - 49) < 0.1
    first = solar.positions(t, 1.0).orderBy("i").first()
    assert abs(first.azimuth - 90) < 1


def grid(spark, tall, side=16):
    return spark.range(side * side).select(F.lit(0).alias("tile_id"), (F.col("id") / side).cast("int").alias("r"), (F.col("id") % side).cast("int").alias("c")).withColumn("h", F.when(tall, 30).otherwise(0)).withColumn("cls", F.when(F.col("h") > 0, "building").otherwise("open"))


def test_shadow_reaches_as_far_as_it_should(spark):
    t = grid(spark, (F.col("r") == 10) & (F.col("c") == 8))
    shade = {r.r: r.shade for r in solar.horizon(t, 1, 0, 5.0, 1.0, 15).where("c = 8 and shade > 0").collect()}
    assert shade == {9: 25.0, 8: 20.0, 7: 15.0, 6: 10.0, 5: 5.0}


def test_shade_and_view_reach_as_far_as_heights_ask(spark):
    t = grid(spark, (F.col("r") == 35) & (F.col("c") == 3), 36).withColumn("h", F.when(F.col("h") > 0, 100).otherwise(0))
    for slope, cells in ((0.25, 31), (0.5, 15)):
        shade = {r.r: r.shade for r in solar.horizon(t, 1, 0, 12.5, slope).where("c = 3 and shade > 0").collect()}
        assert shade == {35 - k: 100 - k * 12.5 * slope for k in range(1, cells + 1)}
    lit = solar.sun_hours(t, [(1, 0, 0.25, 2.0)], 12.5).where("hours = 0").count()
    assert lit == 31
    eyes = spark.createDataFrame([(0, 1, 15, 3, 10.0), (0, 2, 14, 3, 10.0)], "tile_id int, eye int, r int, c int, z double")
    seen = {r.eye: (r.sees, r.far) for r in solar.first_hit(eyes, t, [(1, 0, 0.0)], 12.5).collect()}
    assert seen == {1: ("building", 250.0), 2: ("open", None)}
    diagonal = t.withColumn("h", F.when((F.col("r") >= 29) & (F.col("c") >= 14), 100).otherwise(0))
    eyes = spark.createDataFrame([(0, 1, 15, 0, 10.0), (0, 2, 14, 0, 10.0)], "tile_id int, eye int, r int, c int, z double")
    seen = {r.eye: (r.sees, r.far) for r in solar.first_hit(eyes, diagonal, [(1, 1, 0.0)], 12.5).collect()}
    assert seen == {1: ("building", round(12.5 * 14 * math.sqrt(2), 6)), 2: ("open", None)}


def test_view_of_an_empty_tile_is_half_sky(spark):
    rays = [(0, 1, math.tan(math.radians(r.altitude))) for r in spark.range(1).select(F.inline(solar.view_rays(4, 8))).collect()]
    eyes = spark.createDataFrame([(0, 1, 3, 3, 10.0)], "tile_id int, eye int, r int, c int, z double")
    seen = solar.first_hit(eyes, grid(spark, F.lit(False)), rays, 5.0, 12).groupBy("sees").count().collect()
    assert {r.sees: r["count"] for r in seen} == {"sky": 16, "open": 16}


def test_tiles_round_trip(spark, tmp_path):
    cells = full_cells(spark, SMALL).withColumn("grey", scalars.metres_to_grey(F.col("h")))
    (tmp_path / "Ulm").mkdir()
    for r in sinks.images(cells, 32).collect():
        (tmp_path / "Ulm" / f"Ulm_{r.tile_id}.png").write_bytes(r.image)
    (tmp_path / "Ulm" / "Ulm_99.png").write_bytes(b"not an image")
    read = files.tiles(spark, str(tmp_path))
    assert {(r.city, r.idx, r.status) for r in read.collect()} == {("Ulm", i, "read") for i in range(8)} | {("Ulm", 99, "unreadable")}
    back = files.pixels(read).withColumn("cls2", files.pixel_class(F.col("red"), F.col("green"), F.col("blue")))
    same = back.join(cells, (back["idx"] == cells["tile_id"]) & (back["r"] == cells["r"]) & (back["c"] == cells["c"]))
    assert same.count() == 8192 and same.where("cls != cls2 or (cls = 'building' and red != grey)").count() == 0


def test_city_lists(spark, tmp_path):
    shapes = ['[{"city": "A", "lat": 1.5, "lon": 2.0}, {"city": "B", "continent": "X"}]', '["A", "B"]', '{"names": ["A", "B"]}', '{"A": [1.5, 2.0], "B": [3, 4]}']
    for k, text in enumerate(shapes):
        p = tmp_path / f"{k}.json"
        p.write_text(text)
        rows = files.cities(spark, str(p)).orderBy("city").collect()
        assert [r.city for r in rows] == ["A", "B"] and (rows[0].lat == (1.5 if k in (0, 3) else None))


def test_features(spark, tmp_path):
    square = [{"lat": a, "lon": b} for a, b in ((0, 0), (0, 0.001), (0.001, 0.001), (0.001, 0), (0, 0))]
    found = [
        {"type": "way", "id": 1, "tags": {"building": "yes", "height": "12,5"}, "geometry": square},
        {"type": "way", "id": 1, "tags": {"building": "yes", "height": "12,5"}, "geometry": square},
        {"type": "way", "id": 2, "tags": {"building": "no"}, "geometry": square},
        {"type": "way", "id": 3, "tags": {"highway": "residential"}, "geometry": square[:2]},
        {"type": "way", "id": 4, "tags": {"building": "yes"}, "geometry": square[:3]},
        {"type": "relation", "id": 5, "tags": {"leisure": "park"}, "members": [{"type": "way", "role": "outer", "geometry": square}, {"type": "way", "role": "inner", "geometry": square}]},
        {"type": "way", "id": 6, "tags": {"building": "yes", "building:levels": "3;4"}, "geometry": square},
    ]
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"elements": found}))
    rows = files.features(files.elements(spark, str(p)), 0.0, 0.0).collect()
    got = sorted((r.kind, r.id, r.is_hole, r.height, r.width) for r in rows)
    assert got == [("building", 1, False, 12.5, None), ("building", 6, False, 9.0, None), ("green", 5, False, None, None), ("green", 5, True, None, None), ("street", 3, False, None, 8.0)]


def test_open_ways_of_a_relation_are_joined(spark, tmp_path):
    a, b, c, d = ({"lat": x, "lon": y} for x, y in ((0, 0), (0, 1), (1, 1), (1, 0)))
    member = lambda role, *p: {"type": "way", "role": role, "geometry": list(p)}
    found = [
        {"type": "relation", "id": 1, "tags": {"building": "yes"}, "members": [member("outer", a, b), member("outer", d, c), member("outer", d, a), member("outer", c, b)]},
        {"type": "relation", "id": 2, "tags": {"building": "yes"}, "members": [member("outer", a, b), member("outer", c, d)]},
        {"type": "relation", "id": 3, "tags": {"building": "yes"}, "members": [member("outer", a, b, c, d, a), member("inner", b, c, d), member("inner", d, b)]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"elements": found}))
    rows = files.features(files.elements(spark, str(tmp_path / "a.json")), 0.0, 0.0).collect()
    assert sorted((r.id, r.is_hole, len(r.points)) for r in rows) == [(1, False, 5), (3, False, 5), (3, True, 4)]


def test_first_of_an_element_is_the_first_by_file_and_place(spark, tmp_path):
    for name, height in (("b", 2), ("a", 1)):
        rows = [{"type": "way", "id": 1, "tags": {"height": str(height + k)}, "geometry": []} for k in (0, 10)]
        (tmp_path / f"{name}.json").write_text(json.dumps({"elements": rows}))
    assert [r.tags["height"] for r in files.elements(spark, str(tmp_path)).collect()] == ["1"]


def test_chunks_cover_the_window(spark):
    places = spark.createDataFrame([(1, 48.0, 10.0), (2, 0.0, 0.0)], "place bigint, lat double, lon double")
    t = files.chunks(places, 10000.0, 2500.0).groupBy("place")
    for r in t.agg(F.count("*").alias("n"), (F.max("north") - F.min("south")).alias("d"), F.count_distinct("key").alias("k")).collect():
        assert (r.n, r.k) == (25, 25) and abs(r.d * 111320 - 10300) < 1


def test_one_bad_option_does_not_end_the_others(spark):
    def model(batch):
        if (batch["n"] == 3).any():
            raise ValueError("three")
        return batch.assign(error=None)

    rows = space.generate(spark.range(6).withColumnRenamed("id", "n").coalesce(1), model, "n bigint, error string").collect()
    assert {r.n: r.error for r in rows} == {n: "ValueError: three" if n == 3 else None for n in range(6)}


def test_quantiles_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE", 37)
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(0, 90, 700) / 7, np.full(500, 3.25)])
    g = rng.integers(0, 3, len(v)) ** 2
    t = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)] + [(1, None)], "g int, v double")
    at = [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    got = {(r.g, r.q): r.x for r in stats.quantiles(t, ["g"], "v", at).collect()}
    assert set(got) == {(k, i) for k in (0, 1, 4) for i in range(6)}
    for (k, i), x in got.items():
        assert abs(x - np.quantile(v[g == k], at[i])) < 1e-9


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from fabricloom.session import shared_dir

    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_dir(session("spark://x", "hdfs:///c/")) == "hdfs:///c"
    assert shared_dir(session("local[4]", None)).startswith("file:///")
    for master in ("spark://x", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("A", 1, 0.123456), ("B", 2, 2.00005)], "city string, idx int, v double")
    sinks.metric_csv(t, str(tmp_path / "m"))
    assert sorted(r.v for r in files.metrics(spark, str(tmp_path / "m")).collect()) == [0.1235, 2.0]
    sinks.corpus(t, str(tmp_path / "c"))
    sinks.rewrite(spark.read.parquet(str(tmp_path / "c")).withColumn("v", F.col("v") * 2), str(tmp_path / "c"))
    backup = sinks.rewrite(spark.read.parquet(str(tmp_path / "c")).withColumn("v", F.col("v") * 2), str(tmp_path / "c"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "c")).collect())[0] == pytest.approx(4 * 0.123456)
    assert sorted(r.v for r in spark.read.parquet(backup).collect())[0] == 0.123456
    for _ in range(2):
        sinks.append_log(t, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "6 hours").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "k1")).start()
    q.processAllAvailable()
    q.stop()
    want = windows.tumbling(events, "6 hours")
    got = spark.table("tumbled")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_log_is_followed_and_resumed(spark, tmp_path):
    folder = str(tmp_path / "log")
    spark.createDataFrame([("001", None, 1.0), ("002", "failed", 2.0)], "name string, error string, seconds double").write.json(folder)
    q = windows.follow(windows.read_log(spark, folder), "progress", str(tmp_path / "k2"))
    q.processAllAvailable()
    spark.createDataFrame([("003", None, 4.0)], "name string, error string, seconds double").write.mode("append").json(folder)
    q.processAllAvailable()
    q.stop()
    assert spark.table("progress").first() == (3, 1, 7.0)
    todo = spark.createDataFrame([(f"{i:03d}",) for i in range(1, 6)], "name string")
    assert sorted(r.name for r in space.resume(todo, spark.read.json(folder)).collect()) == ["004", "005"]


def test_lines_are_thin_and_keep_their_parts():
    rng = np.random.default_rng(0)
    for _ in range(5):
        m = rng.random((24, 24)) < 0.55
        t = tiles_np.thin(m)
        assert not (t & ~m).any()
        assert len(np.unique(tiles_np.label(t, True))) == len(np.unique(tiles_np.label(m, True)))
        assert (tiles_np.thin(t) == t).all()


def test_grid_size_and_order(spark):
    t = space.grid(spark, {"a": space.axis(0, 1, 4), "b": space.axis(1, 3, 3, True)})
    rows = t.orderBy("option").collect()
    assert len(rows) == 12 and [r.option for r in rows] == list(range(1, 13)) and (rows[1].a, rows[1].b) == (0.0, 2.0)


def test_nearest_finds_itself(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = t.select(F.col("vec_id").alias("q"), "embedding")
    rows = stats.nearest(q, t, 1, "q", "vec_id", "embedding").collect()
    assert len(rows) == t.count() and all(r.distance == 0 for r in rows)


def test_directions_are_unit_and_orthogonal(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("embedding", F.col("label").cast("double").alias("a"), F.col("vec_id").cast("double").alias("b"))
    u, v = (np.array(r.direction) for r in algebra.directions(t, "embedding", ["a", "b"], 1.0).collect())
    assert abs(u @ u - 1) < 1e-9 and abs(v @ v - 1) < 1e-9 and abs(u @ v) < 1e-9
    x = np.array([r.embedding for r in t.collect()], float)
    top = np.array(algebra.components(t, "embedding", 1).first().direction)
    assert abs(np.linalg.norm((x - x.mean(0)) @ top) - np.linalg.svd(x - x.mean(0))[1][0]) < 1e-6


def test_runs_and_flags(spark):
    t = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 9, 10)], "k string, n int")
    assert audit.runs_text(t, ["k"], "n").first().runs == "1-3, 7, 9-10"
    assert spark.range(1).select(audit.flags({"x": F.lit(True), "y": F.lit(None).cast("boolean"), "z": F.lit(True)})).first()[0] == "x; z"


def test_geojson_ring_is_closed(spark):
    t = spark.createDataFrame([(1, i, float(x), float(y), 3.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1)])], "id int, seq int, x double, y double, h double")
    feature = json.loads(vector.geojson(t, ["id"], ["id", "h"]).first().feature)
    assert feature["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]] and feature["properties"] == {"id": 1, "h": 3.0}


def test_boundary_of_a_square(spark):
    t = spark.createDataFrame([(0, r, c) for r in range(3) for c in range(4)], "tile_id int, r int, c int")
    assert raster.boundary_edges(t).count() == 14
