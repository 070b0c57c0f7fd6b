"""Gridded tables: cells (tile_id, r, c, ...), one row a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

TILES, SIDE = 8, 32


def class_of(v: Column) -> Column:
    """The class that a value stands for in the stand-in grid."""
    k = v % 100
    return F.when(k < 30, "street").when(k < 55, "building").when(k < 70, "green").otherwise("open")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells of the stand-in grid with class and height in metres."""
    made = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % TILES).cast("int").alias("tile_id"),
        (F.col("l_orderkey") % SIDE).cast("int").alias("r"),
        (F.col("l_partkey") % SIDE).cast("int").alias("c"),
    ).agg(F.sum("l_quantity").cast("long").alias("v"))
    return made.withColumns({"cls": class_of(F.col("v")), "h": 4 + F.col("v") % 97})


def full_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells; heights other than of buildings are 0. Absent cells are filled in from sequences, tile by tile."""
    known = cells(spark, sf_dir)
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = spark.range(TILES).select(F.col("id").cast("int").alias("tile_id"), F.explode(side).alias("r"))
    grid = grid.select("tile_id", "r", F.explode(side).alias("c"))
    return grid.join(known, ["tile_id", "r", "c"], "left").select(
        "tile_id", "r", "c",
        F.coalesce("cls", F.lit("open")).alias("cls"),
        F.when(F.col("cls") == "building", F.col("h")).otherwise(0).cast("long").alias("h"),
    )
