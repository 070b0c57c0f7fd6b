"""Windowed queries over events, in batch; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import windows
from .catalog import query


@query("tumbling_events", """
SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def tumbling_events(spark, sf_dir):
    t = windows.tumbling(table(spark, sf_dir, "events"), "6 hours")
    return t.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_events", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '8 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_events(spark, sf_dir):
    t = windows.sessions(table(spark, sf_dir, "events"), "8 hours")
    return t.withColumn("start", F.col("start").cast("timestamp_ntz"))
