"""The corpus-wide rank transform of grey levels to height bytes (the height table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The byte of the lowest building, the highest byte, the widest step between levels.
LOWEST, HIGHEST, WIDEST = 51, 255, 4


def forward(histogram: DataFrame) -> DataFrame:
    """Each grey level with a count (grey, n) and its byte: mid-rank spread over the bytes, at least a step apart.

    A histogram has at most 256 levels, so its windows run in one small task. The two passes that keep levels a
    step apart are running extrema of the byte less the level's number of steps.
    """
    order = Window.orderBy("grey")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = histogram.where("n > 0").select(
        "grey", "n",
        F.row_number().over(order).alias("i"),
        F.count(F.lit(1)).over(everything).alias("k"),
        ((F.sum("n").over(upto) - F.col("n") / 2) / F.sum("n").over(everything)).alias("mid"),
    )
    span = HIGHEST - LOWEST
    t = t.withColumn("step", F.when(F.col("k") > 1, F.greatest(F.lit(1), F.least(F.lit(WIDEST), F.floor(span / (F.col("k") - 1))))).otherwise(F.lit(1)))
    byte = F.when(F.col("i") == 1, LOWEST).when(F.col("i") == F.col("k"), HIGHEST).otherwise(F.rint(LOWEST + F.col("mid") * span))
    t = t.withColumn("base", byte.cast("long") - F.col("i") * F.col("step"))
    t = t.withColumn("up", F.max("base").over(upto) + F.col("i") * F.col("step"))
    t = t.withColumn("up", F.when(F.col("i") == F.col("k"), F.least("up", F.lit(HIGHEST))).otherwise(F.col("up")))
    t = t.withColumn("base", F.col("up") - F.col("i") * F.col("step"))
    return t.select("grey", "n", (F.min("base").over(after) + F.col("i") * F.col("step")).cast("int").alias("byte"))


def inverse(levels: DataFrame) -> DataFrame:
    """Each byte from 0 to 255 and the grey level it decodes to: the nearest, the lower of two as near; bytes
    below the lowest building decode to it. levels: at most 256 rows (grey, byte)."""
    spark = levels.sparkSession
    bytes_ = spark.range(256).select(F.col("id").cast("int").alias("b"))
    small = F.broadcast(levels.select("grey", "byte"))
    near = F.struct(F.abs(F.col("byte") - F.greatest("b", F.lit(LOWEST))).alias("d"), "grey")
    return bytes_.join(small, F.lit(True)).groupBy("b").agg(F.min(near).alias("m")).select("b", F.col("m.grey").alias("grey"))
