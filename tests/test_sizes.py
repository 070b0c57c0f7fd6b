"""What large tables asked for: joins, groups and broadcasts that stay bounded, and the rows they give."""

from pyspark.sql import functions as F

from fabricloom.operators import graph, newton, requests, sinks, stats, vector
from fabricloom.plans import registry
from oracle import SMALL


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_crops_meet_cells_by_place(spark, monkeypatch):
    monkeypatch.setattr(requests, "written", lambda df, name: df, raising=False)
    plan = optimized(registry.queries()["crop_content"](spark, SMALL)).splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "Generate explode" in line]
    assert below and not any("crop" in line for line in below)


def test_fallback_of_full_short_and_null_groups(spark):
    rows = [("a", i, i < 3) for i in range(6)] + [("b", i, i > 7) for i in range(9)] + [(None, i, False) for i in range(4)]
    got = requests.with_fallback(spark.createDataFrame(rows, "g string, i int, ok boolean"), "g", F.col("ok"), ["i"], 2).collect()
    assert sorted((r.g or "", r.i, r.filled_in) for r in got) == [("", 0, True), ("", 1, True), ("a", 0, False), ("a", 1, False), ("a", 2, False), ("b", 0, True), ("b", 8, False)]


def test_polygons_are_drawn_without_a_join(spark):
    assert "Join" not in optimized(registry.queries()["scanline_cells"](spark, SMALL))


def test_steps_that_cancel_out_have_no_direction(spark):
    values = [0.3, 0.1, 0.7, 0.2, 0.3]
    assert sum(b - a for a, b in zip(values, values[1:])) != 0
    rows = [("there and back", i, v) for i, v in enumerate(values)] + [("up", i, v) for i, v in enumerate([1.0, 2.0, 1.5, 4.0])]
    got = {r.k: r for r in stats.walk(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v").collect()}
    assert got["there and back"].monotone == 0
    assert (got["up"].change, got["up"].monotone) == (3.0, 0.666667)


def test_customers_with_an_order_of_any_status_are_left_out(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "P"), (2, "O")], "o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["customers_without_orders"](spark, str(tmp_path))
    assert [r.c_custkey for r in got.collect()] == [3]
    assert "o_orderstatus" not in registry.oracle_sql()["customers_without_orders"]


def test_coinciding_points_and_segments_meet_once(spark):
    points = spark.createDataFrame([(0, p, 10.0 * (p % 2), 5.0) for p in range(40)], "place int, p int, px double, py double")
    runs = spark.createDataFrame([(0, r, 0.0, 9.0, 20.0, 9.0) for r in range(30, 9, -1)] + [(0, 1, 0.0, 90.0, 9.0, 90.0)], "place int, run int, ax double, ay double, bx double, by double")
    near = vector.nearest_segment(points, runs, "place", 50.0)
    assert sorted((r.p, r.run, r.distance) for r in near.collect()) == [(p, 10, 4.0) for p in range(40)]
    assert optimized(near).count("Aggregate") == 4  # places, segments, the best of a place, the best of a point


def test_near_vectors_far_from_the_origin(spark):
    rows = [(i, [1e6 + (i * 37 % 200) * 1e-3, 1e6]) for i in range(200)] + [(i, [1e6, 1e6]) for i in range(300, 330)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = stats.nearest(t.where("vec_id = 0").select(F.col("vec_id").alias("q"), "embedding"), t.where("vec_id < 200"), 4, "q", "vec_id", "embedding").collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(k + 1, k * 173 % 200) for k in range(4)]
    got = stats.nearest(t.where("vec_id = 0").select(F.col("vec_id").alias("q"), "embedding"), t, 4, "q", "vec_id", "embedding").collect()
    assert sorted(r.vec_id for r in got) == [0, 300, 301, 302]


def test_steps_of_lists_of_any_length_and_nulls(spark):
    rows = [("a", [0.0, 9.0], [1.0, 0.0], [0.0, 1.0]), ("b", [0.0], [1.0], [1.0]), ("c", [0.0, None], [1.0, 0.0], [0.0, 1.0]), ("d", [0.0], [1.0, 0.0], [0.0, 1.0]), ("e", None, [1.0], [1.0]), ("f", [], [], [])]
    t = spark.createDataFrame(rows, "name string, w0 array<double>, j0 array<double>, j1 array<double>").coalesce(1).withColumns({"t": F.lit(3.0), "o": F.lit(0.0)})
    out = newton.towards(t, "w0", ("t", "t"), ("o", "o"), ("j0", "j1"), 0.5, 100.0, 1e-3, 40)
    got = {r.name: r for r in out.collect()}
    assert [round(x, 2) for x in got["a"].w] == [3.0, 3.0] and got["a"].steps > 1 and [round(x, 2) for x in got["b"].w] == [3.0]
    assert all((got[n].w, got[n].steps, got[n].miss) == (None, None, None) for n in "cde") and (got["f"].w, got["f"].miss) == ([], 3.0)
    assert "lambda" not in optimized(out)  # lambdas are evaluated row by row, outside of generated code


def test_answers_come_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ANSWERS", 10, raising=False)
    rows = spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("key"), F.array(F.struct("id")).alias("elements"))
    sinks.answers(rows, str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.json.gz"))) == 10 and spark.read.json(str(tmp_path / "a")).count() == 100


def test_a_part_listed_twice_has_its_windows_once(spark, tmp_path):
    spark.createDataFrame([(1, 6), (1, 6), (1, 12), (2, None)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["window_origins"](spark, str(tmp_path)).collect()
    assert sorted((r.p_partkey, r.origin, r.places) for r in got) == [(1, 0, 64), (1, 48, 64), (1, 96, 64)]


def test_stretches_that_are_done_leave(spark, monkeypatch):
    seen = []

    class Counted(graph.Rounds if hasattr(graph, "Rounds") else object):
        def next(self, df):
            out = super().next(df)
            seen.append(out.count())
            return out

    monkeypatch.setattr(graph, "Rounds", Counted, raising=False)
    rows = [("straight", i, float(i), 0.0) for i in range(200)] + [("corner", i, float(i), 10.0 if i == 3 else 0.0) for i in range(9)]
    got = graph.simplified(spark.createDataFrame(rows, "k string, seq int, x double, y double"), ["k"], 6.0)
    assert sorted((r.k, r.seq) for r in got.collect()) == [("corner", 0), ("corner", 3), ("corner", 8), ("straight", 0), ("straight", 199)]
    assert seen == [7, 0]
