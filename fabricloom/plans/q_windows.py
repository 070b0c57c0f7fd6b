"""Masks, windows, bridges and requests: the small table steps around a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, tiles_np
from ..session import table
from ..sources import files
from ..sources.cells import SIDE, full_cells
from .catalog import CELLS_SQL, query
from .q_raster import _reach


@query("rect_mask", """
SELECT c_custkey, CAST(count(*) AS BIGINT) AS cells, min(r) AS r0, max(c) AS c1 FROM (
  SELECT c_custkey, round_even(x0 / 12.5, 0) AS a, round_even((x0 + w) / 12.5, 0) AS b, round_even(y0 / 12.5, 0) AS d, round_even((y0 + h) / 12.5, 0) AS e
  FROM (SELECT c_custkey, c_custkey * 7 % 300.0 AS x0, c_custkey * 13 % 300.0 AS y0, 20.0 + c_custkey % 60 AS w, 20.0 + c_custkey % 45 AS h FROM customer)) m,
  (SELECT CAST(i AS INT) AS r FROM range(32) t(i)), (SELECT CAST(i AS INT) AS c FROM range(32) t(i)) WHERE c >= a AND c < b AND r >= d AND r < e GROUP BY 1
""")
def rect_mask(spark, sf_dir):
    """Rectangles in metres as cells; bounds are rounded half to even. Cells come from sequences, not from a join."""
    k = F.col("c_custkey")
    x0, y0 = (k * 7 % 300).cast("double"), (k * 13 % 300).cast("double")
    at = {"a": x0, "b": x0 + 20.0 + k % 60, "d": y0, "e": y0 + 20.0 + k % 45}
    t = table(spark, sf_dir, "customer").select("c_custkey", *[F.least(F.rint(v / 12.5), F.lit(32.0)).cast("int").alias(n) for n, v in at.items()])
    t = t.where("a < b and d < e").select("c_custkey", "b", "a", F.explode(F.sequence(F.col("d"), F.col("e") - 1)).alias("r"))
    t = t.select("c_custkey", "r", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("c"))
    return t.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("cells"), F.min("r").alias("r0"), F.max("c").alias("c1"))


@query("window_choice", """
WITH m AS (SELECT tile_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM full_cells WHERE cls = 'green' AND h = 0 AND r BETWEEN 9 AND 14 + tile_id AND c BETWEEN 4 AND 12 GROUP BY 1),
s AS (SELECT *, least(32, CAST(ceil(greatest(r1 - r0 + 1, c1 - c0 + 1) * 1.44) AS INT)) AS side FROM m)
SELECT tile_id, side, CAST(greatest(0, least(32 - side, (r0 + r1 + 1 - side) // 2)) AS INT) AS top, CAST(greatest(0, least(32 - side, (c0 + c1 + 1 - side) // 2)) AS INT) AS left_ FROM s
""", cells=True)
def window_choice(spark, sf_dir):
    """A square window around each tile's mask with a margin of 22 percent on either side, kept inside the tile."""
    mask = full_cells(spark, sf_dir).where("cls = 'green' and r between 9 and 14 + tile_id and c between 4 and 12")
    m = mask.groupBy("tile_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    need = F.greatest(F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1) * 1.44
    m = m.withColumn("side", F.least(F.lit(SIDE), F.ceil(need)).cast("int"))

    def inside(a: str, b: str):
        middle = F.expr(f"({a} + {b} + 1 - side) div 2")
        return F.greatest(F.lit(0), F.least(F.lit(SIDE) - F.col("side"), middle)).cast("int")

    return m.select("tile_id", "side", inside("r0", "r1").alias("top"), inside("c0", "c1").alias("left_"))


@query("height_bridge", """
WITH a AS (SELECT DISTINCT CAST(p_size AS INT) AS a, 4 + p_size * 1.7 AS m FROM part), b AS (SELECT DISTINCT CAST(s_suppkey % 40 AS INT) AS b, 5 + (s_suppkey % 40) * 2.3 AS m FROM supplier)
SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(abs(a.m - b.m), 9), b) AS k FROM a, b) WHERE k = 1
""")
def height_bridge(spark, sf_dir):
    """From one height table to another: the level whose metres are nearest. Both tables have 256 rows at most."""
    a = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("a")).distinct()
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).cast("int").alias("b")).distinct()
    gap = F.round(F.abs(4 + F.col("a") * 1.7 - 5 - F.col("b") * 2.3), 9)
    return a.join(F.broadcast(b), F.lit(True)).groupBy("a").agg(F.min(F.struct(gap.alias("d"), "b")).alias("m")).select("a", "m.b")


@query("overlap_blend", """
WITH w AS (SELECT o, k, 0.5 - 0.5 * cos(2 * pi() * k / 15) AS w FROM (VALUES (0), (8), (16)) v(o), range(16) r(k))
SELECT tile_id, r, c, round(sum((h + o) * w) / greatest(sum(w), 1e-6), 6) AS h FROM full_cells JOIN w ON c = o + k GROUP BY 1, 2, 3
""", cells=True)
def overlap_blend(spark, sf_dir):
    """Three overlapping windows' readings blended by Hann weights; a column finds its windows by an equi-join."""
    k = F.explode(F.sequence(F.lit(0), F.lit(15)))
    w = spark.createDataFrame([(0,), (8,), (16,)], "o int").select("o", k.alias("k"))
    w = w.select("o", (F.col("o") + F.col("k")).alias("c"), (0.5 - 0.5 * F.cos(2 * F.pi() * F.col("k") / 15)).alias("w"))
    t = full_cells(spark, sf_dir).join(F.broadcast(w), "c")
    blend = F.sum((F.col("h") + F.col("o")) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))
    return t.groupBy("tile_id", "r", "c").agg(F.round(blend, 6).alias("h"))


@query("inside_outside", """
SELECT tile_id, cls, count(*) AS n, CAST(sum(h) AS BIGINT) AS h FROM (
  SELECT tile_id, cls, h FROM full_cells WHERE r BETWEEN 8 AND 23 AND c BETWEEN 8 AND 23
  UNION ALL SELECT CAST((tile_id + 7) % 8 AS INT), cls, h FROM full_cells WHERE NOT (r BETWEEN 8 AND 23 AND c BETWEEN 8 AND 23)) GROUP BY 1, 2
""", cells=True)
def inside_outside(spark, sf_dir):
    """A fit inside a region, what is there outside of it (the next tile's)."""
    grid, region = full_cells(spark, sf_dir), F.expr("r between 8 and 23 and c between 8 and 23")
    outside = grid.where(~region).withColumn("tile_id", ((F.col("tile_id") + 7) % 8).cast("int"))
    return grid.where(region).unionByName(outside).groupBy("tile_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))


@query("given_flags", """
SELECT event_id, round(coalesce(v, 0), 6) AS value, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS given FROM (
  SELECT event_id, CASE WHEN CAST('0x' || substr(md5(event_id || ':value'), 1, 8) AS BIGINT) % 100 < 30 THEN NULL ELSE (value - 50) / 29 END AS v FROM events)
""")
def given_flags(spark, sf_dir):
    """Three in ten conditions are withheld, by a hash of the row and the metric; withheld ones read 0 with flag 0."""
    draw = F.conv(F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":value"))), 1, 8), 16, 10).cast("bigint") % 100
    v = F.when(draw >= 30, (F.col("value") - 50) / 29)
    t = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return t.select("event_id", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("value"), F.when(F.col("v").isNull(), 0).otherwise(1).alias("given"))


@query("crop_scales", """
SELECT o_orderkey, round(s, 6) AS scale, CAST(round_even(128 * s, 0) AS INT) AS side FROM (SELECT o_orderkey, pow(2.0, -1 + 3 * (o_orderkey % 997) / 997.0) AS s FROM orders)
""")
def crop_scales(spark, sf_dir):
    """Log-uniform scales from a half to four, and the side of a crop at each."""
    s = F.pow(F.lit(2.0), -1 + 3 * (F.col("o_orderkey") % 997) / 997.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(s, 6).alias("scale"), F.rint(128 * s).cast("int").alias("side"))


@query("status_scrape", """
SELECT event_id, CASE WHEN t LIKE '%available now%' THEN CAST(regexp_extract(t, '([0-9]+) slots available', 1) AS INT) ELSE 0 END AS slots,
  CASE WHEN t LIKE '%available now%' THEN 0 ELSE CAST(regexp_extract(t, 'in ([0-9]+) seconds', 1) AS INT) END AS wait
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 5) || ' slots available now.' ELSE 'Slot available after: x, in ' || (event_id % 90) || ' seconds.' END AS t FROM events)
""")
def status_scrape(spark, sf_dir):
    """Free slots, or the seconds until one is, from a service's status text."""
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat((i % 5).cast("string"), F.lit(" slots available now."))).otherwise(F.concat(F.lit("Slot available after: x, in "), (i % 90).cast("string"), F.lit(" seconds.")))
    t = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    now = F.contains("t", F.lit("available now"))
    return t.select(
        "event_id", F.when(now, F.regexp_extract("t", "([0-9]+) slots available", 1).try_cast("int")).otherwise(0).alias("slots"),
        F.when(now, 0).otherwise(F.regexp_extract("t", "in ([0-9]+) seconds", 1).try_cast("int")).alias("wait"),
    )


@query("seed_blend", """
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(CAST(p[1] AS DOUBLE) * 0.7 + CAST(p[2] AS DOUBLE) * 0.3))), 5) AS weight, CAST(label = 3 AS INT) AS hot
FROM (SELECT x.vec_id, x.label, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
""")
def seed_blend(spark, sf_dir):
    """Vectors blended with the next one, and a one-hot entry of the label."""
    t = table(spark, sf_dir, "embeddings")
    nxt = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    blend = F.zip_with("embedding", "b", lambda x, y: F.abs(x.cast("double") * 0.7 + y.cast("double") * 0.3))
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1).otherwise(0))
    return t.join(nxt, "vec_id").select("vec_id", F.round(F.aggregate(blend, F.lit(0.0), lambda s, v: s + v), 5).alias("weight"), F.get(hot, F.lit(3)).alias("hot"))


@query("clean_mask", _reach("building", "abs(a.r - b.r) + abs(a.c - b.c) = 1").replace(
    "SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m", ", l AS (SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m"
) + ") SELECT tile_id, r, c, label FROM l QUALIFY count(*) OVER (PARTITION BY tile_id, label) >= 3")
def clean_mask(spark, sf_dir):
    """Building cells without components of under three cells."""
    return tiles_np.cleaned(full_cells(spark, sf_dir), F.col("cls") == "building", 3, SIDE)


_P = ", ".join(f"coalesce(max(CASE WHEN b.r = a.r + {dr} AND b.c = a.c + {dc} THEN 1 END), 0) AS p{k}" for k, (dr, dc) in enumerate([(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]))
_TURNS = " + ".join(f"(1 - p{k}) * p{(k + 1) % 8}" for k in range(8))


@query("skeleton", f"""
WITH RECURSIVE {CELLS_SQL}, s AS (SELECT tile_id, r, c, 0 AS k FROM full_cells WHERE cls = 'street' UNION ALL
  SELECT tile_id, r, c, k + 1 FROM (SELECT a.tile_id, a.r, a.c, a.k, {_P}, count(b.r) AS n FROM s a LEFT JOIN s b ON b.tile_id = a.tile_id AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 AND NOT (b.r = a.r AND b.c = a.c)
    WHERE a.k < 60 GROUP BY a.tile_id, a.r, a.c, a.k)
  WHERE NOT (n BETWEEN 2 AND 6 AND {_TURNS} = 1 AND CASE WHEN k % 2 = 0 THEN p0 * p2 * p4 = 0 AND p2 * p4 * p6 = 0 ELSE p0 * p2 * p6 = 0 AND p0 * p4 * p6 = 0 END)),
t AS (SELECT tile_id, r, c FROM s WHERE k = 60)
SELECT t.tile_id, t.r, t.c, count(u.r) AS neighbours FROM t LEFT JOIN t u ON u.tile_id = t.tile_id AND abs(u.r - t.r) <= 1 AND abs(u.c - t.c) <= 1 AND NOT (u.r = t.r AND u.c = t.c) GROUP BY ALL
""")
def skeleton(spark, sf_dir):
    """Street cells thinned to lines, with the neighbours that each has."""
    thin = tiles_np.skeletons(full_cells(spark, sf_dir), F.col("cls") == "street", SIDE)
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    near = raster.neighbours(thin, ["r"], around).groupBy("tile_id", "r", "c").agg(F.count(F.lit(1)).alias("neighbours"))
    return thin.join(near, ["tile_id", "r", "c"], "left").select("tile_id", "r", "c", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


@query("fetch_plan", """
WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS place, (n_nationkey - 12) * 4.0 AS lat, n_nationkey * 7.0 AS lon FROM nation),
b AS (SELECT place, CAST(i AS INT) AS i, CAST(j AS INT) AS j, lat + (i * 2060.0 - 5150) / 111320.0 AS south, lon + (j * 2060.0 - 5150) / (111320.0 * cos(radians(lat))) AS west,
  lat + (i * 2060.0 - 5150) / 111320.0 + 2060.0 / 111320.0 AS north, lon + (j * 2060.0 - 5150) / (111320.0 * cos(radians(lat))) + 2060.0 / (111320.0 * cos(radians(lat))) AS east FROM p, range(5) a(i), range(5) b(j)),
k AS (SELECT *, printf('%.5f', round(south, 5)) AS s, printf('%.5f', round(west, 5)) AS w, printf('%.5f', round(north, 5)) AS n, printf('%.5f', round(east, 5)) AS e FROM b)
SELECT place, i, j, round(south, 8) AS south, round(west, 8) AS west, round(north, 8) AS north, round(east, 8) AS east, s || '_' || w || '_' || n || '_' || e AS key, 5 AS asks FROM k
""")
def fetch_plan(spark, sf_dir):
    """The boxes and keys of a 10 km window, with its margin, around each nation's stand-in place, and how often
    the request text of each asks for its box (buildings, streets, three kinds of greens)."""
    n = F.col("n_nationkey")
    places = table(spark, sf_dir, "nation").select(n.cast("long").alias("place"), ((n - 12) * 4.0).alias("lat"), (n * 7.0).alias("lon"))
    t = files.chunks(places, 10_000.0, 2_500.0)
    box = F.format_string("%.5f,%.5f,%.5f,%.5f", "south", "west", "north", "east")
    text = files.query_text(F.col("south"), F.col("west"), F.col("north"), F.col("east"))
    asked = F.concat(F.lit("("), box, F.lit(")"))
    once = ((F.length(text) - F.length(F.replace(text, asked, F.lit("")))) / F.length(asked)).cast("int")
    return t.select("place", "i", "j", *[F.round(c, 8).alias(c) for c in ("south", "west", "north", "east")], "key", once.alias("asks"))
