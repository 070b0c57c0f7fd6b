"""Corpus audits over the stand-in grid, events and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import heights
from ..operators import audit
from ..sources.cells import cells, full_cells
from ..session import table
from .catalog import query


@query("tile_class_report", """
WITH s AS (SELECT tile_id, CASE WHEN tile_id % 2 = 0 THEN 'even' ELSE 'odd' END AS grp,
  100.0 * avg(CASE WHEN cls = 'building' THEN 1 ELSE 0 END) AS b, 100.0 * avg(CASE WHEN cls = 'street' THEN 1 ELSE 0 END) AS s,
  100.0 * avg(CASE WHEN cls = 'green' THEN 1 ELSE 0 END) AS g, 100.0 * avg(CASE WHEN cls = 'open' THEN 1 ELSE 0 END) AS o
  FROM full_cells GROUP BY ALL)
SELECT grp, count(*) AS tiles, count_if(o = 100.0) AS blank, round(avg(b), 6) AS building_pct, round(avg(s), 6) AS street_pct,
  round(avg(g), 6) AS green_pct, round(avg(o), 6) AS open_pct FROM s GROUP BY GROUPING SETS ((grp), ())
""", cells=True)
def tile_class_report(spark, sf_dir):
    """Scan, classify, shares by tile, status, then groups of tiles and the grand total."""
    tiles = audit.tile_shares(full_cells(spark, sf_dir), ["tile_id"])
    tiles = tiles.withColumn("grp", F.when(F.col("tile_id") % 2 == 0, "even").otherwise("odd"))
    tiles = tiles.withColumn("status", audit.status(100.0 - F.col("open_pct")))
    return tiles.rollup("grp").agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("status") == "blank").alias("blank"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("building_pct", "street_pct", "green_pct", "open_pct")],
    )


@query("tile_status", """
WITH s AS (SELECT event_id % 625 AS idx, 100.0 * avg(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS content FROM events GROUP BY 1)
SELECT idx, round(content, 6) AS content, CASE WHEN content = 0.0 THEN 'blank' WHEN content < 5.0 THEN 'near_blank' ELSE 'ok' END AS status,
  content >= 5.0 AS kept FROM s
""")
def tile_status(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 625).alias("idx")).agg(audit.share(F.col("value") > 90).alias("c"))
    return t.select("idx", F.round("c", 6).alias("content"), audit.status(F.col("c")).alias("status"), (F.col("c") >= 5.0).alias("kept"))


LUT_SQL = """
WITH hist AS (SELECT CAST(100 + p_size * 3 AS INT) AS grey, count(*) AS n FROM part GROUP BY 1),
a AS (SELECT *, row_number() OVER (ORDER BY grey) AS i, count(*) OVER () AS k,
  (sum(n) OVER (ORDER BY grey) - n / 2) / sum(n) OVER () AS mid FROM hist),
b AS (SELECT *, CASE WHEN k > 1 THEN greatest(1, least(4, 204 // (k - 1))) ELSE 1 END AS step FROM a),
c AS (SELECT *, CASE WHEN i = 1 THEN 51 WHEN i = k THEN 255 ELSE CAST(round_even(51 + mid * 204, 0) AS BIGINT) END - i * step AS base FROM b),
d AS (SELECT *, CASE WHEN i = k THEN least(255, max(base) OVER (ORDER BY i) + i * step) ELSE max(base) OVER (ORDER BY i) + i * step END AS up FROM c),
lut AS (SELECT grey, n, CAST(min(up - i * step) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + i * step AS INT) AS byte FROM d)
"""


def _lut(spark, sf_dir):
    hist = table(spark, sf_dir, "part").groupBy((100 + F.col("p_size") * 3).alias("grey")).agg(F.count(F.lit(1)).alias("n"))
    return heights.forward(hist)


@query("height_lut_forward", LUT_SQL + " SELECT grey, n, byte FROM lut")
def height_lut_forward(spark, sf_dir):
    return _lut(spark, sf_dir)


@query("height_lut_inverse", LUT_SQL + """, near AS (SELECT CAST(b.i AS INT) AS b, grey,
  row_number() OVER (PARTITION BY b.i ORDER BY abs(byte - greatest(b.i, 51)), grey) AS rn FROM range(256) b(i), lut)
SELECT b, grey FROM near WHERE rn = 1""")
def height_lut_inverse(spark, sf_dir):
    return heights.inverse(_lut(spark, sf_dir))


@query("height_lut_apply", LUT_SQL + """
SELECT p_partkey, byte, CAST(round_even((SELECT sum(byte * n) / sum(n) FROM lut), 0) AS INT) AS mean_byte
FROM part JOIN lut ON grey = 100 + p_size * 3""")
def height_lut_apply(spark, sf_dir):
    lut = _lut(spark, sf_dir)
    mean = lut.agg(F.rint(F.sum(F.col("byte") * F.col("n")) / F.sum("n")).cast("int").alias("mean_byte"))
    # both sides of the lookup are bounded: 256 grey levels, one mean
    rows = table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size") * 3).alias("grey"))
    return rows.join(lut, "grey").join(F.broadcast(mean), F.lit(True)).select("p_partkey", "byte", "mean_byte")  # one row


@query("grey_percentiles", """
WITH h AS (SELECT p_size AS g, count(*) AS n FROM part GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY g) AS c, sum(n) OVER () AS t FROM h)
SELECT min(g) FILTER (c >= 0.01 * t) AS p01, min(g) FILTER (c >= 0.5 * t) AS p50, min(g) FILTER (c >= 0.99 * t) AS p99 FROM c
""")
def grey_percentiles(spark, sf_dir):
    h = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    return audit.histogram_percentiles(h, "p_size", "n", [0.01, 0.5, 0.99])


@query("city_audit", """
WITH t AS (SELECT tile_id, 100.0 * avg(CASE WHEN cls = 'building' THEN 1 ELSE 0 END) AS b, 100.0 * avg(CASE WHEN cls = 'street' THEN 1 ELSE 0 END) AS s,
  sum(h) FILTER (cls = 'building') AS hs, count(*) FILTER (cls = 'building') AS hn, count(DISTINCT h) FILTER (cls = 'building') AS levels,
  count(*) FILTER (cls = 'building' AND h = 7) AS fallback FROM full_cells GROUP BY 1)
SELECT CAST(tile_id % 3 AS INT) AS city, count(*) AS tiles, count_if(hn = 0) AS no_building, round(avg(b), 6) AS building_pct, round(avg(s), 6) AS street_pct,
  round(coalesce(sum(hs) / sum(hn), 0), 6) AS mean_height, round(coalesce(100.0 * sum(fallback) / sum(hn), 0), 6) AS fallback_pct,
  round(avg(levels), 6) AS levels FROM t GROUP BY 1
""", cells=True)
def city_audit(spark, sf_dir):
    """Shares are means of tiles, heights means of cells."""
    building = F.col("cls") == "building"
    t = full_cells(spark, sf_dir).groupBy("tile_id").agg(
        audit.share(building).alias("b"), audit.share(F.col("cls") == "street").alias("s"),
        F.sum(F.when(building, F.col("h"))).alias("hs"), F.count_if(building).alias("hn"),
        F.count_distinct(F.when(building, F.col("h"))).alias("levels"), F.count_if(building & (F.col("h") == 7)).alias("fallback"),
    )
    zero = F.lit(0.0)
    return t.groupBy((F.col("tile_id") % 3).alias("city")).agg(
        F.count(F.lit(1)).alias("tiles"), F.count_if(F.col("hn") == 0).alias("no_building"),
        F.round(F.avg("b"), 6).alias("building_pct"), F.round(F.avg("s"), 6).alias("street_pct"),
        F.round(F.coalesce(F.try_divide(F.sum("hs"), F.sum("hn")), zero), 6).alias("mean_height"),
        F.round(F.coalesce(F.try_divide(100.0 * F.sum("fallback"), F.sum("hn")), zero), 6).alias("fallback_pct"),
        F.round(F.avg("levels"), 6).alias("levels"),
    )


@query("audit_flags", """
WITH a AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS bal, count_if(c_acctbal < 0) AS neg FROM customer GROUP BY 1),
s AS (SELECT s_nationkey, count(*) AS sup FROM supplier GROUP BY 1)
SELECT n_name, coalesce(n, 0) AS customers, sup AS suppliers, array_to_string(list_filter([CASE WHEN coalesce(n, 0) < 55 THEN 'few customers' END,
  CASE WHEN bal < 4400 THEN 'low balance' END, CASE WHEN sup IS NULL THEN 'no supplier' END, CASE WHEN 10 * neg > n THEN 'debts' END], lambda x: x IS NOT NULL), '; ') AS flags
FROM nation LEFT JOIN a ON c_nationkey = n_nationkey LEFT JOIN s ON s_nationkey = n_nationkey
""")
def audit_flags(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("bal"), F.count_if(F.col("c_acctbal") < 0).alias("neg"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    t = table(spark, sf_dir, "nation").join(a, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    t = t.withColumn("customers", F.coalesce("n", F.lit(0)))
    rules = {"few customers": F.col("customers") < 55, "low balance": F.col("bal") < 4400, "no supplier": F.col("suppliers").isNull(), "debts": 10 * F.col("neg") > F.col("n")}
    return t.select("n_name", "customers", "suppliers", audit.flags(rules).alias("flags"))


_HAVE = "SELECT DISTINCT n_name, CAST(event_id * 7 % 625 AS INT) AS idx FROM events JOIN nation ON n_nationkey = user_id % 25"


def _have(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "events").join(nation, F.expr("n_nationkey = user_id % 25")).select("n_name", (F.col("event_id") * 7 % 625).cast("int").alias("idx"))


@query("missing_tiles", f"""
WITH have AS ({_HAVE}) SELECT n_name, CAST(i AS INT) AS idx FROM nation, range(625) r(i) WHERE (n_name, i) NOT IN (SELECT n_name, idx FROM have)
""")
def missing_tiles(spark, sf_dir):
    return audit.missing(_have(spark, sf_dir), table(spark, sf_dir, "nation"), "n_name", "idx", 625)


@query("index_runs", f"""
WITH have AS ({_HAVE}), g AS (SELECT *, idx - row_number() OVER (PARTITION BY n_name ORDER BY idx) AS k FROM have),
r AS (SELECT n_name, min(idx) AS a, max(idx) AS b FROM g GROUP BY n_name, k)
SELECT n_name, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS runs FROM r GROUP BY 1
""")
def index_runs(spark, sf_dir):
    return audit.runs_text(_have(spark, sf_dir), ["n_name"], "idx")


@query("label_map", "SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS city_id FROM nation")
def label_map(spark, sf_dir):
    return audit.dictionary(table(spark, sf_dir, "nation"), "n_name", "city_id")


@query("size_histogram", "SELECT n_chars // 500 AS size, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def size_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("n_chars") / 500).cast("long").alias("size"), "lang").agg(F.count(F.lit(1)).alias("n"))


@query("tile_metrics", """
SELECT tile_id, round(100.0 * avg(CASE WHEN cls = 'building' THEN 1 ELSE 0 END), 6) AS coverage_pct, round(count_if(cls = 'street') * 156.25, 6) AS street_area_m2,
  round(coalesce(avg(h) FILTER (cls = 'building'), 0), 6) AS mean_height_m, round(coalesce(max(h) FILTER (cls = 'building'), 0), 6) AS max_height_m,
  round(coalesce(sum(h) FILTER (cls = 'building'), 0) / (3.0 * count(*)), 6) AS far_proxy,
  round(coalesce(sum(h) FILTER (cls = 'building'), 0) * 156.25 / 3.0, 6) AS gfa_m2 FROM full_cells GROUP BY 1
""", cells=True)
def tile_metrics(spark, sf_dir):
    from ..operators.metrics import tile_metrics as measure

    return measure(full_cells(spark, sf_dir), tile_m=400.0, side=32)


@query("seeded_sample", """
SELECT source, doc_id, k FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS INT) AS k FROM documents) WHERE k <= 20
""")
def seeded_sample(spark, sf_dir):
    """Up to 20 documents of each source, in the order of a seeded hash."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id").withColumn("k", F.row_number().over(w)).where("k <= 20")


@query("occupied_cells", "SELECT tile_id, cls, count(*) AS n, CAST(sum(h) AS BIGINT) AS h FROM classed GROUP BY 1, 2", cells=True)
def occupied_cells(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("tile_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
