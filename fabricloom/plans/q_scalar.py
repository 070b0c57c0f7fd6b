"""Scalar functions over whole tables: names, tags, heights, fields, angles, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedules as S
from ..functions import scalars as X
from ..session import table
from .catalog import query


@query("filename_parse", """
SELECT event_id, f AS file, nullif(regexp_extract(f, '(?i)^(.+)_([0-9]+)[.]png$', 1), '') AS city,
  TRY_CAST(regexp_extract(f, '(?i)^(.+)_([0-9]+)[.]png$', 2) AS INT) AS idx,
  TRY_CAST(regexp_extract(f, '(?i)^(.+)_([0-9]+)[.]png$', 2) AS INT) // 25 AS tile_row,
  TRY_CAST(regexp_extract(f, '(?i)^(.+)_([0-9]+)[.]png$', 2) AS INT) % 25 AS tile_col
FROM (SELECT event_id, n_name || '_' || (event_id % 625) || CASE WHEN event_id % 7 = 0 THEN '.PNG' WHEN event_id % 11 = 0 THEN '.txt' ELSE '.png' END AS f
  FROM events JOIN nation ON n_nationkey = event_id % 25)
""")
def filename_parse(spark, sf_dir):
    ending = F.when(F.col("event_id") % 7 == 0, ".PNG").when(F.col("event_id") % 11 == 0, ".txt").otherwise(".png")
    names = table(spark, sf_dir, "events").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("n_nationkey = event_id % 25"))
    names = names.select("event_id", F.concat("n_name", F.lit("_"), (F.col("event_id") % 625).cast("string"), ending).alias("file"))
    idx = X.tile_index(F.col("file"))
    return names.select(
        "event_id", "file", X.tile_city(F.col("file")).alias("city"), idx.alias("idx"),
        F.floor(idx / 25).cast("int").alias("tile_row"), (idx % 25).alias("tile_col"),
    )


_TAGS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN k || ',5' WHEN 1 THEN k || '''' WHEN 2 THEN k || ' ft' WHEN 3 THEN '0'
  WHEN 4 THEN 'tall' WHEN 5 THEN k || '.25 m' WHEN 6 THEN '-' || k END AS height,
  CASE WHEN event_id % 3 = 0 THEN (k % 9) || ';4' WHEN event_id % 3 = 1 THEN 'some' END AS levels
  FROM (SELECT event_id, CAST(event_id % 90 AS VARCHAR(9)) AS k0, event_id % 90 AS k FROM events)"""


@query("height_tag_parse", f"""
SELECT event_id, height, levels, round(CASE WHEN m > 0 THEN m WHEN l > 0 THEN l * 3.0 ELSE 7.0 END, 6) AS metres FROM (
  SELECT *, CASE WHEN height LIKE '%ft%' OR height LIKE '%''%' THEN hn * 0.3048 ELSE hn END AS m FROM (
    SELECT *, TRY_CAST(regexp_extract(replace(height, ',', '.'), '[-+]?[0-9]*[.]?[0-9]+') AS DOUBLE) AS hn,
      TRY_CAST(regexp_extract(replace(levels, ',', '.'), '[-+]?[0-9]*[.]?[0-9]+') AS DOUBLE) AS l FROM ({_TAGS})))
""")
def height_tag_parse(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events_for_tags")
    tags = spark.sql(_TAGS.replace("FROM events", "FROM events_for_tags").replace("''''", "\"'\"").replace("VARCHAR(9)", "STRING"))
    return tags.select("event_id", "height", "levels", F.round(X.parse_height(F.col("height"), F.col("levels")), 6).alias("metres"))


@query("grey_metres", """
SELECT p_partkey, CAST(g AS INT) AS grey, round(m, 9) AS metres, CAST(round_even(100 + greatest(0, least(1, (m - 4.0) / 96.0)) * 155, 0) AS INT) AS back
FROM (SELECT *, 4.0 + greatest(0.0, least(1.0, (g - 100) / 155.0)) * 96.0 AS m FROM (SELECT p_partkey, p_size * 6 - 30 AS g FROM part))
""")
def grey_metres(spark, sf_dir):
    grey = (F.col("p_size") * 6 - 30).alias("grey")
    t = table(spark, sf_dir, "part").select("p_partkey", grey).withColumn("m", X.grey_to_metres(F.col("grey")))
    return t.select("p_partkey", "grey", F.round("m", 9).alias("metres"), X.metres_to_grey(F.col("m")).alias("back"))


@query("field_bytes", """
SELECT event_id, CAST(i AS INT) AS byte, round(i / 127.5 - 1.0, 9) AS field, CAST(round_even((i / 127.5 - 1.0 + 1.0) * 127.5, 0) AS INT) AS back,
  CAST(CASE WHEN i > 127 THEN i - 256 ELSE i END AS INT) AS signed,
  CAST(greatest(0.0, least(255.0, round_even(128.0 + (i - 128) / 16.0 / 8.0 * 127.0, 0))) AS INT) AS sdf_byte,
  CAST(round_even(greatest(-31.0, least(31.0, (i - 128) / 3.0)) * 4.0, 0) AS INT) AS quarter
FROM (SELECT event_id, event_id * 37 % 256 AS i FROM events) t
""")
def field_bytes(spark, sf_dir):
    """Bytes of events as fields and distances, and back."""
    b = (F.col("event_id") * 37 % 256).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", b.alias("byte"), F.round(X.byte_to_field(b), 9).alias("field"), X.field_to_byte(X.byte_to_field(b)).alias("back"),
        X.signed_byte(b).alias("signed"), X.sdf_to_byte((b - 128) / 16.0).alias("sdf_byte"), X.sdf_to_quarter((b - 128) / 3.0).alias("quarter"),
    )


@query("angle_difference", """
SELECT event_id, round(d - round_even(d / 90.0, 0) * 90.0, 6) AS turn90, round(d - round_even(d / 180.0, 0) * 180.0, 6) AS turn180
FROM (SELECT event_id, CAST(event_id % 720 AS DOUBLE) - (event_id * 7 % 361) AS d FROM events)
""")
def angle_difference(spark, sf_dir):
    a, b = (F.col("event_id") % 720).cast("double"), (F.col("event_id") * 7 % 361).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", *[F.round(X.angle_difference(a, b, F.lit(float(p))), 6).alias(f"turn{p}") for p in (90, 180)]
    )


@query("names_and_slugs", """
SELECT c_custkey, trim(regexp_replace(c_name || ' / ' || c_mktsegment || '!', '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS slug,
  contains(x, left(y, 5)) OR contains(y, left(x, 5)) AS agree FROM (
  SELECT *, regexp_replace(lower(c_name), '[ _-]', '', 'g') AS x, regexp_replace(lower(c_mktsegment || ' Customer'), '[ _-]', '', 'g') AS y FROM customer)
""")
def names_and_slugs(spark, sf_dir):
    title = F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.slug(title).alias("slug"), X.names_agree(F.col("c_name"), F.concat("c_mktsegment", F.lit(" Customer"))).alias("agree")
    )


@query("stub_model", """
SELECT o_orderkey, CAST(CAST('0x' || substr(md5('{"coverage":' || (o_orderkey % 50) || '}'), 1, 8) AS BIGINT) % 16 AS INT) AS pick FROM orders
""")
def stub_model(spark, sf_dir):
    spec = F.to_json(F.struct((F.col("o_orderkey") % 50).alias("coverage")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.stub_index(spec, 16).alias("pick"))


@query("noise_schedule", """
SELECT event_id, t, round(ac, 6) AS alphas_cumprod, round(least(ac / (1 - ac), 5.0), 4) AS clipped_snr,
  round(least(ac / (1 - ac), 5.0) / (ac / (1 - ac) + 1), 6) AS weight FROM (
  SELECT event_id, CAST(i AS INT) AS t, greatest(1e-5, least(1.0, pow(cos(((i + 1) / 1000.0 + 0.008) / 1.008 * pi() / 2), 2) / pow(cos(0.008 / 1.008 * pi() / 2), 2))) AS ac
  FROM (SELECT event_id, event_id * 7 % 1000 AS i FROM events) r)
""")
def noise_schedule(spark, sf_dir):
    """The schedule at each event's step."""
    return S.schedule(table(spark, sf_dir, "events").select("event_id"), F.col("event_id") * 7 % 1000)


@query("ddim_steps", """
WITH s AS (SELECT p_partkey, CAST(i AS INT) AS i, CAST(round_even(999 - i * CAST(999 AS DOUBLE) / (p_size + 1), 0) AS INT) AS t FROM part, range(80) r(i) WHERE i < p_size + 2)
SELECT p_partkey, i, t, coalesce(lead(t) OVER (PARTITION BY p_partkey ORDER BY i), -1) AS t_next FROM s
""")
def ddim_steps(spark, sf_dir):
    """Steps of a sampler, as many as each part's size and two."""
    return S.steps(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 1000, F.col("p_size") + 2).drop("p_size")


@query("window_origins", """
WITH o AS (SELECT DISTINCT p_partkey, least(i * 48, p_size * 8) AS o FROM part, range(0, 99) r(i) WHERE i <= ceil(p_size * 8 / 48.0))
SELECT p_partkey, CAST(o AS INT) AS origin, count(*) AS places, round(sum(round(greatest(0.5 - 0.5 * cos(2 * pi() * k / 63), 0.01), 9)), 6) AS weight FROM o, range(64) w(k) GROUP BY ALL
""")
def window_origins(spark, sf_dir):
    """The windows that cover a canvas as long as each part's size says, and the weight of each: places are summed once an origin, not once a part."""
    t = S.windows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 64 + F.col("p_size") * 8, 64, 48).select("p_partkey", "origin").distinct()
    facts = S.window_weights(t.select("origin").distinct(), 64).groupBy("origin").agg(F.count(F.lit(1)).alias("places"), F.round(F.sum("weight"), 6).alias("weight"))
    return t.join(F.broadcast(facts), "origin").select("p_partkey", "origin", "places", "weight")


@query("step_embedding", """
SELECT event_id, CAST(t AS INT) AS t, CAST(k AS INT) AS k, round(CASE WHEN k < 8 THEN cos(t * f) ELSE sin(t * f) END, 6) AS value FROM (
  SELECT event_id, event_id * 37 % 1000 AS t, k, exp(-ln(10000.0) * (k % 8) / 8) AS f FROM events, range(16) b(k))
""")
def step_embedding(spark, sf_dir):
    """The embedding of each event's step."""
    return S.embedding(table(spark, sf_dir, "events").select("event_id"), F.col("event_id") * 37 % 1000, 16)
