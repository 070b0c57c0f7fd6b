"""Files written and read again: metric tables, reports, logs, caches, stores, map elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks
from ..session import new_path, table
from ..sources import files
from .catalog import query
from .q_audit import LUT_SQL, _lut


@query("metric_csv", """
SELECT n_name AS city, 'tile_' || c_custkey || '.png' AS file, CAST(c_custkey AS DOUBLE) AS idx, round_even(c_acctbal / 7, 4) AS coverage_pct, CASE WHEN c_custkey % 9 > 0 THEN round_even(c_acctbal / 11, 4) END AS mean_height_m
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def metric_csv(spark, sf_dir):
    """A metric table as CSV with four places, and back; a missing value is an empty cell."""
    t = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    t = t.select(F.col("n_name").alias("city"), F.concat(F.lit("tile_"), k.cast("string"), F.lit(".png")).alias("file"), k.alias("idx"), (F.col("c_acctbal") / 7).alias("coverage_pct"), F.when(k % 9 > 0, F.col("c_acctbal") / 11).alias("mean_height_m"))
    path = new_path(spark, "metrics")
    sinks.metric_csv(t, path)
    return files.metrics(spark, path)


@query("json_report", "SELECT event_type AS name, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json_report(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    path = new_path(spark, "report")
    sinks.report(t, path)
    return spark.read.schema("name string, n bigint, mean double").json(path)


@query("run_log", """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS name, s_acctbal AS coverage, CASE WHEN s_acctbal > 0 THEN 'ok' ELSE 'failed' END AS status, 2 AS runs FROM supplier
""")
def run_log(spark, sf_dir):
    """A log that two runs add to, read as options with parameters and objectives."""
    t = table(spark, sf_dir, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("name"), F.create_map(F.lit("coverage"), "s_acctbal").alias("parameters"),
        F.create_map(F.lit("status"), F.when(F.col("s_acctbal") > 0, "ok").otherwise("failed")).alias("objectives"), F.create_map(F.lit("model"), F.lit(0.5)).alias("seconds"),
    )
    path = new_path(spark, "log")
    for _ in range(2):
        sinks.append_log(t, path)
    log = files.option_log(spark, path)
    return log.groupBy("name").agg(F.max(F.col("parameters")["coverage"]).alias("coverage"), F.max(F.col("objectives")["status"]).alias("status"), F.count(F.lit(1)).cast("int").alias("runs"))


_CORNERS = [(0.0, 0.0), (0.0, 0.001), (0.001, 0.001), (0.001, 0.0), (0.0, 0.0)]


def _elements(spark, sf_dir):
    """A map element for each part: buildings, streets and parks by their number; every seventh is no element at all."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "building").when(k % 3 == 1, "highway").otherwise("leisure")
    value = F.when(k % 3 == 0, F.when(k % 5 == 0, "no").otherwise("yes")).when(k % 3 == 1, F.when(k % 4 == 0, "footway").otherwise("residential")).otherwise("park")
    tags = F.map_from_arrays(F.array(kind, F.lit("height")), F.array(value, F.concat((F.col("p_size") / 2).cast("string"), F.lit(" m"))))
    square = F.array(*[F.struct(F.lit(a).alias("lat"), (F.lit(b) + k * 0.01).alias("lon")) for a, b in _CORNERS])
    shape = F.when(k % 11 == 0, F.slice(square, 1, 3)).otherwise(square)
    no_members = F.lit(None).cast("array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>")
    one = F.struct(F.lit("way").alias("type"), k.alias("id"), tags.alias("tags"), shape.alias("geometry"), no_members.alias("members"))
    listed = F.when(k % 7 == 0, F.slice(F.array(one), 1, 0)).otherwise(F.array(one, one))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("key"), k.cast("string")).alias("key"), listed.alias("elements"))


@query("answer_cache", "SELECT 'way' AS type, p_partkey AS id, CAST(CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 5 END AS INT) AS points FROM part WHERE p_partkey % 7 != 0")
def answer_cache(spark, sf_dir):
    """Answers of a map service saved compressed, empty ones never; each element once."""
    path = new_path(spark, "answers")
    sinks.answers(_elements(spark, sf_dir), path)
    return files.elements(spark, path, True).select("type", "id", F.size("geometry").alias("points"))


@query("map_features", """
SELECT kind, id, points, height, width FROM (SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 5 END AS INT) AS points,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 5 != 0 AND p_partkey % 11 != 0 THEN 'building' END
    WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 4 != 0 THEN 'street' END WHEN p_partkey % 11 != 0 THEN 'green' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0 END AS height, CASE WHEN p_partkey % 3 = 1 THEN 8.0 END AS width FROM part WHERE p_partkey % 7 != 0) WHERE kind IS NOT NULL
""")
def map_features(spark, sf_dir):
    """Buildings, streets and greens of saved map elements, by their tags and shape."""
    path = new_path(spark, "answers")
    sinks.answers(_elements(spark, sf_dir), path)
    t = files.features(files.elements(spark, path, True), 0.0, 0.0)
    return t.select("kind", "id", F.size("points").alias("points"), "height", "width")


@query("rewritten_table", "SELECT s_suppkey, s_acctbal * 2 AS s_acctbal, s_acctbal AS before FROM supplier")
def rewritten_table(spark, sf_dir):
    """A table rewritten from itself, beside its backup."""
    path = new_path(spark, "rewritten")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").write.parquet(path)
    backup = sinks.rewrite(spark.read.parquet(path).withColumn("s_acctbal", F.col("s_acctbal") * 2), path)
    old = spark.read.parquet(backup).withColumnRenamed("s_acctbal", "before")
    return spark.read.parquet(path).join(old, "s_suppkey")


@query("corpus_by_city", "SELECT CAST(c_nationkey AS INT) AS city, count(*) AS tiles, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey IN (3, 7) GROUP BY 1")
def corpus_by_city(spark, sf_dir):
    """A corpus with one folder a city, of which two are read."""
    path = new_path(spark, "corpus")
    sinks.corpus(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city"), "c_custkey", "c_acctbal"), path)
    t = spark.read.parquet(path).where(F.col("city").isin(3, 7))
    return t.groupBy("city").agg(F.count(F.lit(1)).alias("tiles"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("city_lists", """
SELECT 'rows' AS shape, n_name AS city, n_nationkey * 1.5 AS lat FROM nation UNION ALL SELECT 'names', n_name, NULL FROM nation UNION ALL SELECT 'named', n_name, NULL FROM nation UNION ALL SELECT 'pairs', n_name, n_nationkey * 1.5 FROM nation
""")
def city_lists(spark, sf_dir):
    """The nations as a list of cities in each of its shapes."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"), (F.col("n_nationkey") * 1.5).alias("lat"))
    names = F.collect_list("city")
    pair = F.array("lat", F.lit(0.0))
    shapes = {
        "rows": F.to_json(F.collect_list(F.struct("city", "lat"))), "names": F.to_json(names), "named": F.to_json(F.struct(names.alias("names"))),
        "pairs": F.to_json(F.map_from_entries(F.collect_list(F.struct("city", pair)))),
    }
    out = None
    for name, text in shapes.items():  # one row of 25 names each
        path = new_path(spark, f"cities-{name}")
        n.agg(text.alias("value")).coalesce(1).write.text(path)
        one = files.cities(spark, path).select(F.lit(name).alias("shape"), "city", "lat")
        out = one if out is None else out.unionByName(one)
    return out


@query("saved_height_table", LUT_SQL + """, near AS (SELECT CAST(b.i AS INT) AS b, grey,
  row_number() OVER (PARTITION BY b.i ORDER BY abs(byte - greatest(b.i, 51)), grey) AS rn FROM range(256) b(i), lut)
SELECT b, grey FROM near WHERE rn = 1""")
def saved_height_table(spark, sf_dir):
    """A height table saved as arrays of 256, and its inverse worked out anew on reading."""
    lut = _lut(spark, sf_dir)
    all_ = spark.range(256).select(F.col("id").cast("int").alias("grey")).join(lut, "grey", "left")
    rows = F.sort_array(F.collect_list(F.struct("grey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("byte", F.lit(0)).alias("byte"))))
    saved = all_.agg(rows.alias("r")).select(F.to_json(F.struct(F.col("r.byte").alias("forward"), F.col("r.n").alias("counts"))).alias("value"))
    path = new_path(spark, "height-table")
    saved.write.text(path)
    _, inverse = files.height_table(spark, path)
    return inverse.select("b", "grey")


@query("text_summary", """
SELECT unnest([n_name || ': ' || count(*) || ' customers', '  balance ' || printf('%.2f', round(sum(c_acctbal), 2))]) AS line FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name
""")
def text_summary(spark, sf_dir):
    t = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = t.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("m"))
    path = new_path(spark, "summary")
    sinks.summary(t, [F.format_string("%s: %d customers", "n_name", "n"), F.format_string("  balance %.2f", "m")], path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("run_manifest", "SELECT 'stub' AS engine, (SELECT count(*) FROM part) AS options, 108 AS planned, true AS stamped")
def run_manifest(spark, sf_dir):
    """A run's facts as one JSON object with the time it was written."""
    path = new_path(spark, "manifest")
    sinks.manifest({"engine": "stub", "options": table(spark, sf_dir, "part").count(), "planned": 108}, spark, path)
    t = spark.read.schema("engine string, options bigint, planned int, written string").json(path)
    return t.select("engine", "options", "planned", F.rlike("written", F.lit(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")).alias("stamped"))


@query("stored_once", """
SELECT CAST(c_nationkey AS INT) AS snapshot, count(*) AS n, round(sum(c_acctbal), 2) AS total, c_nationkey >= 15 AS added_later FROM customer GROUP BY ALL
""")
def stored_once(spark, sf_dir):
    """Metrics by snapshot in a store: a second run that asks for more adds only what isn't there."""
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("snapshot"), "c_acctbal")
    path = new_path(spark, "store")
    sinks.once(t.where("snapshot < 15"), path, "snapshot")
    added = sinks.once(t.withColumn("c_acctbal", F.when(F.col("snapshot") >= 15, F.col("c_acctbal")).otherwise(-1.0)), path, "snapshot")
    one = spark.read.parquet(path).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return one.join(added.withColumn("_a", F.lit(True)), "snapshot", "left").select("snapshot", "n", "total", F.coalesce("_a", F.lit(False)).alias("added_later"))


@query("file_inventory", "SELECT 'city=' || c_nationkey AS folder FROM customer GROUP BY 1")
def file_inventory(spark, sf_dir):
    """The folders of a corpus by a listing of its files over 600 bytes."""
    path = new_path(spark, "inventory")
    c = table(spark, sf_dir, "customer")
    sinks.corpus(c.select(F.col("c_nationkey").alias("city"), "c_custkey", "c_name", "c_acctbal"), path)
    t = files.inventory(spark, path, "*.parquet", 600)
    return t.select(F.regexp_extract("path", "(city=[^/]+)", 1).alias("folder")).distinct()


@query("candidate_metrics", """
SELECT p_partkey AS candidate, round(p_size * 1.0, 3) AS target, round(p_retailprice / 37, 3) AS achieved, round(p_retailprice / 37 - p_size, 3) AS error FROM part
""")
def candidate_metrics(spark, sf_dir):
    """Candidates' targets and what they reached, nested in JSON and flattened again."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.struct((F.col("p_size") * 1.0).alias("coverage")).alias("targets"), F.struct((F.col("p_retailprice") / 37).alias("coverage")).alias("achieved"))
    path = new_path(spark, "candidates")
    sinks.report(t, path)
    r = spark.read.schema("p_partkey bigint, targets struct<coverage: double>, achieved struct<coverage: double>").json(path)
    a, b = F.col("achieved.coverage"), F.col("targets.coverage")
    return r.select(F.col("p_partkey").alias("candidate"), F.round(b, 3).alias("target"), F.round(a, 3).alias("achieved"), F.round(a - b, 3).alias("error"))


@query("sample_store", """
SELECT label, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 5) AS first_sum, len(any_value(embedding)) AS places FROM embeddings GROUP BY 1
""")
def sample_store(spark, sf_dir):
    """Samples with their vectors in Parquet, and back by label."""
    path = new_path(spark, "samples")
    table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").write.parquet(path)
    t = spark.read.parquet(path).groupBy("label")
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 5).alias("first_sum"), F.max(F.size("embedding")).cast("long").alias("places"))
