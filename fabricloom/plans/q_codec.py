"""Codec queries over the stand-in grid: decoding, resampling, sums, plateaus, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import heights
from ..operators import audit, codec, raster, tiles_np
from ..session import table
from ..sources.cells import SIDE, cells, full_cells
from .catalog import query
from .q_audit import LUT_SQL, _lut
from .q_raster import _reach

#: The axis weights of a resize from 32 to 12 cells, as SQL.
_WEIGHTS = """raw AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, 1 - abs(j + 0.5 - (i + 0.5) * 32 / 12.0) / (32 / 12.0) AS w FROM range(12) a(i), range(32) b(j)
  WHERE abs(j + 0.5 - (i + 0.5) * 32 / 12.0) < 32 / 12.0), wt AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM raw)"""


@query("threshold_decode", "WITH " + LUT_SQL.strip()[5:] + """, near AS (SELECT CAST(b.i AS INT) AS b, grey,
  row_number() OVER (PARTITION BY b.i ORDER BY abs(byte - greatest(b.i, 51)), grey) AS rn FROM range(256) b(i), lut), inv AS (SELECT b, grey FROM near WHERE rn = 1),
k AS (SELECT CAST(l_suppkey % 8 AS INT) AS tile_id, CAST(l_orderkey % 32 AS INT) AS r, CAST(l_partkey % 32 AS INT) AS c, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT *, v % 256 AS fp, v * 7 % 256 AS st, v * 13 % 256 AS gr, CAST(51 + v % 205 AS INT) AS b FROM k)
SELECT tile_id, r, c, CAST(CASE WHEN st >= 128 THEN 255 WHEN gr >= 128 THEN 128 WHEN fp >= 128 THEN grey ELSE 0 END AS INT) AS red,
  CAST(CASE WHEN st >= 128 THEN 0 WHEN gr >= 128 THEN 255 WHEN fp >= 128 THEN grey ELSE 0 END AS INT) AS green,
  CAST(CASE WHEN st >= 128 THEN 0 WHEN gr >= 128 THEN 0 WHEN fp >= 128 THEN grey ELSE 0 END AS INT) AS blue FROM e JOIN inv USING (b)
""")
def threshold_decode(spark, sf_dir):
    v = F.col("v")
    e = cells(spark, sf_dir).select("tile_id", "r", "c", (v % 256).alias("fp"), (v * 7 % 256).alias("st"), (v * 13 % 256).alias("gr"), (51 + v % 205).cast("int").alias("b"))
    e = e.join(heights.inverse(_lut(spark, sf_dir)), "b")  # 256 rows
    return codec.decode(e, F.col("grey")).select("tile_id", "r", "c", "red", "green", "blue")


@query("tile_position", "SELECT event_id, CAST(event_id % 625 // 25 AS INT) AS row_, CAST(event_id % 25 AS INT) AS col_ FROM events")
def tile_position(spark, sf_dir):
    row, col = codec.position(F.col("event_id") % 625, 25)
    return table(spark, sf_dir, "events").select("event_id", row.alias("row_"), col.alias("col_"))


@query("split_names", r"""
SELECT p_partkey, CASE WHEN contains(n, '_') THEN regexp_extract(n, '^(.*)_[^_]*$', 1) ELSE n END AS city, CASE WHEN contains(n, '_') THEN regexp_extract(n, '_([^_]*)$', 1) ELSE '' END AS idx
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN replace(p_type, ' ', '-') ELSE replace(p_type, ' ', '_') || '_' || p_size END AS n FROM part)
""")
def split_names(spark, sf_dir):
    """Names split at their last underscore."""
    plain = F.replace("p_type", F.lit(" "), F.lit("-"))
    name = F.when(F.col("p_partkey") % 5 == 0, plain).otherwise(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")))
    city, idx = codec.split_name(F.col("n"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("n")).select("p_partkey", city.alias("city"), idx.alias("idx"))


@query("only_and_skip", "SELECT n_name FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_99') AND n_name NOT IN ('NATION_7')")
def only_and_skip(spark, sf_dir):
    return codec.selected(table(spark, sf_dir, "nation").select("n_name"), "n_name", "NATION_3, NATION_7,NATION_11 , NATION_99", "NATION_7")


@query("resize_field", f"""
WITH {_WEIGHTS}, a AS (SELECT tile_id, r, i AS c, sum(h * w) AS h FROM full_cells JOIN wt ON c = j GROUP BY ALL)
SELECT tile_id, i AS r, c, round(sum(h * w), 5) AS h FROM a JOIN wt ON r = j GROUP BY ALL
""", cells=True)
def resize_field(spark, sf_dir):
    return codec.resize(full_cells(spark, sf_dir), "h", SIDE, 12).withColumn("h", F.round("h", 5))


@query("resized_stack", f"""
WITH {_WEIGHTS}, v AS (SELECT tile_id, r, c, CASE WHEN cls = 'street' THEN 1.0 ELSE 0.0 END AS s, h FROM full_cells),
a AS (SELECT tile_id, r, i AS c, sum(h * w) AS h, sum(s * w) AS s FROM v JOIN wt ON c = j GROUP BY ALL),
b AS (SELECT tile_id, i AS r, c, round(sum(h * w), 5) AS h, round(sum(s * w), 5) AS s FROM a JOIN wt ON r = j GROUP BY ALL)
SELECT tile_id, count(*) AS n, round(arg_min(h, r * 12 + c), 4) AS first_h, round(max(s), 4) AS top_s, round(sum(h), 2) AS total_h FROM b GROUP BY 1
""", cells=True)
def resized_stack(spark, sf_dir):
    """Two fields brought to one size and stacked as arrays of a tile."""
    grid = full_cells(spark, sf_dir)
    h = codec.resize(grid, "h", SIDE, 12)
    s = codec.resize(grid.select("tile_id", "r", "c", (F.col("cls") == "street").cast("double").alias("s")), "s", SIDE, 12)
    both = h.join(s, ["tile_id", "r", "c"]).select("tile_id", "r", "c", F.round("h", 5).alias("h"), F.round("s", 5).alias("s"))
    t = codec.stacked(both, ["h", "s"], 12)
    return t.select(
        "tile_id", F.size("h").cast("long").alias("n"), F.round(F.get("h", F.lit(0)), 4).alias("first_h"), F.round(F.array_max("s"), 4).alias("top_s"),
        F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 2).alias("total_h"),
    )


@query("rotated_resample", """
WITH t AS (SELECT tile_id, CAST(r * 32 + c AS BIGINT) AS p, c - 15.5 AS x, r - 15.5 AS y, tile_id * 0.17 AS a FROM full_cells),
q AS (SELECT tile_id, p, round(15.5 + x * cos(a) - y * sin(a), 6) AS x, round(15.5 + x * sin(a) + y * cos(a), 6) AS y FROM t),
k AS (SELECT q.*, floor(x) + a.i AS c, floor(y) + b.i AS r FROM q, range(2) a(i), range(2) b(i)),
w AS (SELECT *, (1 - abs(x - c)) * (1 - abs(y - r)) AS w FROM k)
SELECT w.tile_id, p, round(sum(w * h) / sum(w), 6) AS h FROM w JOIN full_cells f ON f.tile_id = w.tile_id AND f.r = w.r AND f.c = w.c WHERE w > 0 GROUP BY 1, 2
""", cells=True)
def rotated_resample(spark, sf_dir):
    grid = full_cells(spark, sf_dir)
    angles = grid.select("tile_id").distinct().withColumn("angle", F.col("tile_id") * 0.17)
    return codec.rotated(grid, angles, "h", SIDE)


_NEAR = """nr AS (SELECT f.tile_id, f.r, f.c, f.cls, f.h, arg_min(b.h, (pow(f.r - b.r, 2) + pow(f.c - b.c, 2)) * 4096 + b.r * 32 + b.c) AS n
  FROM full_cells f LEFT JOIN full_cells b ON b.tile_id = f.tile_id AND b.cls = 'building' GROUP BY ALL)"""


@query("height_fill", f"""
WITH {_NEAR}, ker AS (SELECT CAST(k AS INT) AS k, exp(-0.5 * pow(k / 1.5, 2)) AS w FROM range(-6, 7) t(k)), kn AS (SELECT k, w / sum(w) OVER () AS w FROM ker),
f AS (SELECT tile_id, r, c, cls, h, CAST(coalesce(n, 128) AS DOUBLE) AS f FROM nr),
a AS (SELECT f.tile_id, f.r, f.c, sum(kn.w * g.f) AS f FROM f, kn JOIN f g ON g.tile_id = f.tile_id AND g.c = f.c AND g.r = greatest(0, least(31, f.r + kn.k)) GROUP BY ALL),
b AS (SELECT a.tile_id, a.r, a.c, sum(kn.w * g.f) AS f FROM a, kn JOIN a g ON g.tile_id = a.tile_id AND g.r = a.r AND g.c = greatest(0, least(31, a.c + kn.k)) GROUP BY ALL)
SELECT tile_id, r, c, CAST(round_even(CASE WHEN cls = 'building' THEN h ELSE round(b.f, 6) END, 0) AS INT) AS h FROM f JOIN b USING (tile_id, r, c)
""", cells=True)
def height_fill(spark, sf_dir):
    grid = full_cells(spark, sf_dir)
    near = tiles_np.nearest(grid, F.col("cls") == "building", SIDE)
    return codec.fill_heights(grid, near, 1.5, SIDE, 128)


@query("feathered_composite", """
WITH m AS (SELECT tile_id, r, c, h, (h * 3 + 40) % 256 AS g, CASE WHEN r BETWEEN 10 AND 20 AND c BETWEEN 9 + tile_id AND 22 THEN 1.0 ELSE 0.0 END AS m FROM full_cells),
a AS (SELECT *, max(m) OVER (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS d FROM m),
b AS (SELECT *, max(d) OVER (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS d1 FROM a),
c1 AS (SELECT *, sum(d1) OVER (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s1 FROM b),
c2 AS (SELECT *, sum(s1) OVER (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s2 FROM c1),
c3 AS (SELECT *, sum(s2) OVER (PARTITION BY tile_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s3 FROM c2),
c4 AS (SELECT *, sum(s3) OVER (PARTITION BY tile_id, c ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s4 FROM c3)
SELECT tile_id, r, c, greatest(0, least(255, CAST(round_even(round(h * (1 - s4) + g * s4, 6), 0) AS INT))) AS blend FROM c4
""", cells=True)
def feathered_composite(spark, sf_dir):
    grid = full_cells(spark, sf_dir).withColumn("g", (F.col("h") * 3 + 40) % 256)
    grid = grid.withColumn("m", F.when(F.expr("r between 10 and 20 and c between 9 + tile_id and 22"), 1.0).otherwise(0.0))
    return codec.feathered(grid, "m", "h", "g", 2, SIDE).select("tile_id", "r", "c", "blend")


@query("box_sums", """
WITH b AS (SELECT event_id AS box, CAST(event_id % 8 AS INT) AS tile_id, event_id * 7 % 20 AS r0, event_id * 11 % 20 AS c0, event_id * 7 % 20 + event_id % 12 AS r1, event_id * 11 % 20 + event_id % 9 AS c1 FROM events)
SELECT b.tile_id, box, CAST(sum(h) AS BIGINT) AS total FROM b JOIN full_cells f ON f.tile_id = b.tile_id AND r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1 GROUP BY 1, 2
""", cells=True)
def box_sums(spark, sf_dir):
    """Sums of heights in the boxes of events, from a summed area table."""
    i = F.col("event_id")
    r0, c0 = i * 7 % 20, i * 11 % 20
    boxes = table(spark, sf_dir, "events").select(
        (i % 8).cast("int").alias("tile_id"), i.alias("box"), r0.cast("int").alias("r0"), c0.cast("int").alias("c0"), (r0 + i % 12).cast("int").alias("r1"), (c0 + i % 9).cast("int").alias("c1")
    )
    return codec.box_sums(boxes, full_cells(spark, sf_dir), "h")


_MAJORITY = """
{out} AS (SELECT tile_id, r, c, b FROM (SELECT x.tile_id, x.r, x.c, y.b, sum(CASE WHEN x.r = y.r AND x.c = y.c THEN 1.5 ELSE 1.0 END) AS w
  FROM {from_} x JOIN {from_} y ON x.tile_id = y.tile_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tile_id, r, c ORDER BY w DESC, b) = 1)"""


@query("height_plateaus", f"""
WITH q AS (SELECT tile_id, r, c, h, CAST(round_even(h / 12.0, 0) AS INT) AS b FROM full_cells WHERE cls = 'building'),
{_MAJORITY.format(out='m1', from_='q')}, {_MAJORITY.format(out='m2', from_='m1')}
SELECT q.tile_id, m2.b AS plateau, count(*) AS n, median(h) AS height, list_sort(list(h))[len(list(h)) // 2 + 1] AS upper FROM q JOIN m2 USING (tile_id, r, c) GROUP BY 1, 2
""", cells=True)
def height_plateaus(spark, sf_dir):
    """Heights in steps of 12 m, smoothed twice by majority, and the median height of each step; of an even number of
    heights upper takes the later."""
    from pyspark.sql import Window

    b = full_cells(spark, sf_dir).where("cls = 'building'").select("tile_id", "r", "c", "h")
    bins = b.select("tile_id", "r", "c", F.rint(F.col("h") / 12.0).cast("int").alias("plateau"))
    bins = codec.majority(codec.majority(bins, "plateau"), "plateau")
    t = b.join(bins, ["tile_id", "r", "c"])
    own = Window.partitionBy("tile_id", "plateau")
    t = t.withColumn("k", F.row_number().over(own.orderBy("h"))).withColumn("n", F.count(F.lit(1)).over(own))
    upper = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("h")))
    return t.groupBy("tile_id", "plateau").agg(F.count(F.lit(1)).alias("n"), F.median("h").alias("height"), upper.alias("upper"))


@query("street_width", _reach("street", "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1").replace("SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL", """,
l AS (SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL),
d AS (SELECT l.tile_id, l.label, l.r, l.c, min(sqrt(pow(l.r - f.r, 2) + pow(l.c - f.c, 2))) AS d FROM l JOIN full_cells f ON f.tile_id = l.tile_id AND f.cls != 'street' GROUP BY ALL)
SELECT tile_id, label, count(*) AS cells, round_even(round(greatest(3.0, least(60.0, 2 * (avg(d) - 0.25) * 12.5)), 6) * 2, 0) / 2 AS width FROM d GROUP BY ALL
"""))
def street_width(spark, sf_dir):
    """Widths of connected streets from their cells' distance to what isn't street, to half a metre."""
    grid = full_cells(spark, sf_dir)
    street = F.col("cls") == "street"
    field = tiles_np.distances(grid, street, SIDE, reach=64.0).where("distance > 0")
    parts = tiles_np.components(grid, street, True, SIDE).join(field, ["tile_id", "r", "c"])
    wide = F.greatest(F.lit(3.0), F.least(F.lit(60.0), 2 * (F.avg(F.col("distance") + 0.5) - 0.25) * 12.5))
    return parts.groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("cells"), (F.rint(F.round(wide, 6) * 2) / 2).alias("width"))


@query("largest_rectangle", """
WITH m AS (SELECT tile_id, r, c FROM full_cells WHERE cls != 'street'), i AS (SELECT *, r - row_number() OVER (PARTITION BY tile_id, c ORDER BY r) AS i FROM m),
h AS (SELECT tile_id, r, c, row_number() OVER (PARTITION BY tile_id, c, i ORDER BY r) AS h FROM i),
p AS (SELECT a.tile_id, a.r, a.c AS c0, b.c AS c1, min(k.h) AS h, count(*) AS n FROM h a JOIN h b ON b.tile_id = a.tile_id AND b.r = a.r AND b.c >= a.c
  JOIN h k ON k.tile_id = a.tile_id AND k.r = a.r AND k.c BETWEEN a.c AND b.c GROUP BY ALL),
s AS (SELECT *, h * n AS area FROM p WHERE n = c1 - c0 + 1)
SELECT tile_id, r AS r1, c0, c1, CAST(h AS INT) AS height, CAST(area AS INT) AS area FROM s QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY area DESC, r, c0, c1) = 1
""", cells=True)
def largest_rectangle(spark, sf_dir):
    out = codec.largest_rectangle(full_cells(spark, sf_dir).where("cls != 'street'"))
    return out.select("tile_id", "r1", "c0", "c1", F.col("height").cast("int").alias("height"), F.col("area").cast("int").alias("area"))


@query("line_peaks", """
WITH RECURSIVE {cells}, v AS (SELECT tile_id, c + 0.25 + (r % 3) * 0.2 AS pos, CAST(h AS DOUBLE) AS w FROM full_cells WHERE cls = 'building' AND r BETWEEN 4 AND 20),
hist AS (SELECT t.i AS tile_id, b.i AS b, coalesce(sum(w), 0.0) AS w FROM range(8) t(i), range(32) b(i) LEFT JOIN v ON v.tile_id = t.i AND CAST(floor(pos) AS INT) = b.i GROUP BY ALL),
s AS (SELECT tile_id, CAST(b AS INT) AS b, 0.25 * coalesce(lag(w) OVER k, 0) + 0.5 * w + 0.25 * coalesce(lead(w) OVER k, 0) AS s FROM hist WINDOW k AS (PARTITION BY tile_id ORDER BY b)),
o AS (SELECT tile_id, list(b ORDER BY s DESC, b) AS bs FROM s WHERE s >= 200 GROUP BY 1),
p AS (SELECT tile_id, bs, CAST([] AS INT[]) AS got FROM o
  UNION ALL SELECT tile_id, bs[2:], CASE WHEN len(list_filter(got, lambda x: abs(x - bs[1]) < 4)) = 0 THEN list_append(got, bs[1]) ELSE got END FROM p WHERE len(bs) > 0),
e AS (SELECT tile_id, unnest(got) AS b FROM p WHERE len(bs) = 0)
SELECT CAST(e.tile_id AS INT) AS tile_id, e.b AS bin, round(coalesce(sum(pos * w) / sum(w), e.b + 0.5), 6) AS x FROM e LEFT JOIN v ON v.tile_id = e.tile_id AND abs(pos - (e.b + 0.5)) <= 2 GROUP BY e.tile_id, e.b
""".replace("{cells}", __import__("fabricloom.plans.catalog", fromlist=["x"]).CELLS_SQL))
def line_peaks(spark, sf_dir):
    """Main columns of buildings in the northern part of a tile, weighted by height."""
    v = full_cells(spark, sf_dir).where("cls = 'building' and r between 4 and 20")
    v = v.select("tile_id", (F.col("c") + 0.25 + (F.col("r") % 3) * 0.2).alias("pos"), F.col("h").cast("double").alias("w"))
    return codec.peaks(v, SIDE, 4, 200.0)


@query("plate_overlap", _reach("building", "abs(a.r - b.r) + abs(a.c - b.c) = 1").replace("SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL", """,
l AS (SELECT m.tile_id, m.r, m.c, CAST(min(w.b) AS INT) AS label FROM m JOIN w ON w.tile_id = m.tile_id AND w.a = m.i GROUP BY ALL),
o AS (SELECT l.*, EXISTS (SELECT 1 FROM full_cells f WHERE f.cls = 'green' AND f.tile_id = l.tile_id AND abs(f.r - l.r) <= 1 AND abs(f.c - l.c) <= 1) AS hit FROM l)
SELECT tile_id, label, count(*) AS cells, count_if(hit) / count(*) AS share FROM o GROUP BY 1, 2 HAVING count_if(hit) / count(*) > 0.2
"""))
def plate_overlap(spark, sf_dir):
    """Buildings of which more than a fifth lies on greens widened by a cell."""
    grid = full_cells(spark, sf_dir)
    parts = tiles_np.components(grid, F.col("cls") == "building", False, SIDE)
    wide = raster.extreme(grid.withColumn("g", (F.col("cls") == "green").cast("int")), "g", 1, True, SIDE).where("g = 1")
    return codec.overlaps(parts, wide, 0.2)


@query("grey_levels", """
SELECT CAST(t.i AS INT) AS tile_id, count(DISTINCT h) AS levels, coalesce(min(h), -1) AS low, coalesce(max(h), -1) AS high
FROM range(8) t(i) LEFT JOIN full_cells f ON f.tile_id = t.i AND cls = 'building' AND r < t.i GROUP BY 1
""", cells=True)
def grey_levels(spark, sf_dir):
    """Levels in the first rows of each tile, -1 where there are none."""
    h = F.when((F.col("cls") == "building") & (F.col("r") < F.col("tile_id")), F.col("h"))
    none = F.lit(-1).cast("long")
    return full_cells(spark, sf_dir).groupBy("tile_id").agg(F.count_distinct(h).alias("levels"), F.coalesce(F.min(h), none).alias("low"), F.coalesce(F.max(h), none).alias("high"))


@query("paint_order", """
WITH q AS (SELECT c_custkey % 40 AS g, c_custkey * 7 % 24 AS r0, c_custkey * 13 % 24 AS c0, 2 + c_custkey % 6 AS a, 2 + c_custkey % 5 AS b, 4 + c_custkey % 23 AS h FROM customer)
SELECT g, r0 + i AS r, c0 + j AS c, max(h) AS h FROM q, range(8) x(i), range(8) y(j) WHERE i < a AND j < b GROUP BY ALL
""")
def paint_order(spark, sf_dir):
    """Overlapping buildings drawn so that the taller wins, in any order."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select((k % 40).alias("g"), (k * 7 % 24).alias("r0"), (k * 13 % 24).alias("c0"), (k % 5).alias("b"), (4 + k % 23).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), 1 + k % 6)).alias("i"))
    t = t.select("g", (F.col("r0") + F.col("i")).alias("r"), "c0", "h", F.explode(F.sequence(F.lit(0).cast("long"), 1 + F.col("b"))).alias("j"))
    return t.groupBy("g", "r", (F.col("c0") + F.col("j")).alias("c")).agg(F.max("h").alias("h"))


@query("usable_order", """
WITH s AS (SELECT CAST(event_id % 25 AS INT) AS city, 100.0 * avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS usable FROM events GROUP BY 1)
SELECT row_number() OVER (ORDER BY round(usable, 6) DESC, city) AS place, city, round(usable, 6) AS usable FROM s
""")
def usable_order(spark, sf_dir):
    """Cities by their usable share, the best first: one row a city."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 25).cast("int").alias("city")).agg(F.round(audit.share(F.col("value") > 50), 6).alias("usable"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("usable"), "city")).cast("long"))


@query("every_kth", "SELECT p_partkey FROM part WHERE p_partkey % 7 = 0 ORDER BY p_partkey LIMIT 12")
def every_kth(spark, sf_dir):
    """A preview: every seventh part, the first twelve."""
    return table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select("p_partkey").orderBy("p_partkey").limit(12)
