"""Audits of a tile corpus: class shares, status, completeness, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Percent of rows for which a condition holds."""
    return 100.0 * F.avg(condition.cast("int"))


def tile_shares(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of each class by tile: a partial aggregate on the map side, then one row a tile is shuffled."""
    return cells.groupBy(*keys).agg(*[share(F.col("cls") == k).alias(f"{k}_pct") for k in ("building", "street", "green", "open")])


def status(content: Column, near_blank: float = 5.0) -> Column:
    """unreadable (no content known), blank, near_blank or ok, by the percent that isn't open ground."""
    return F.when(content.isNull(), "unreadable").when(content == 0.0, "blank").when(content < near_blank, "near_blank").otherwise("ok")


def runs(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Runs of consecutive whole numbers: keys, first, last, length. Numbers may repeat."""
    numbers = rows.select(*keys, n).distinct()
    island = F.col(n) - F.row_number().over(Window.partitionBy(*keys).orderBy(n))
    return numbers.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min(n).alias("first"), F.max(n).alias("last"), F.count(F.lit(1)).alias("length")
    ).drop("_island")


def runs_text(rows: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The runs of each key as text: 1-3, 7, 9-10."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = F.sort_array(F.collect_list(F.struct("first", one.alias("t"))))
    return runs(rows, keys, n).groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("runs"))


def missing(have: DataFrame, names: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Expected numbers 0 to size - 1 of each name that aren't there."""
    expected = names.select(key, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(n))
    return expected.join(have.select(key, n).distinct(), [key, n], "left_anti")


def histogram_percentiles(histogram: DataFrame, value: str, n: str, at: list[float]) -> DataFrame:
    """For each share the least value whose cumulated count reaches it. A histogram of bounded size."""
    w = Window.orderBy(value)
    cdf = histogram.withColumn("_c", F.sum(n).over(w)).withColumn("_t", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    cut = [F.min(F.when(F.col("_c") >= q * F.col("_t"), F.col(value))).alias(f"p{round(q * 100):02d}") for q in at]
    return cdf.agg(*cut)


def flags(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, joined; empty if none does."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), "; ")


def dictionary(rows: DataFrame, name: str, number: str) -> DataFrame:
    """Dense numbers of distinct names in order."""
    return rows.select(name).distinct().withColumn(number, F.row_number().over(Window.orderBy(name)) - 1)
