"""Metrics of tiles that are plain aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FLOOR


def tile_metrics(cells: DataFrame, tile_m: float, side: int) -> DataFrame:
    """Shares, areas and heights of each tile; heights are 0 without a building, floors are fractional."""
    area = (tile_m / side) ** 2
    building = F.col("cls") == "building"
    heights = F.coalesce(F.sum(F.when(building, F.col("h"))), F.lit(0))  # whole: divided once, so partitions don't matter
    zero = F.lit(0.0)
    return cells.groupBy("tile_id").agg(
        F.round(100.0 * F.avg(building.cast("int")), 6).alias("coverage_pct"),
        F.round(F.count_if(F.col("cls") == "street") * area, 6).alias("street_area_m2"),
        F.round(F.coalesce(F.avg(F.when(building, F.col("h"))), zero), 6).alias("mean_height_m"),
        F.round(F.coalesce(F.max(F.when(building, F.col("h"))).cast("double"), zero), 6).alias("max_height_m"),
        F.round(heights / (FLOOR * F.count(F.lit(1))), 6).alias("far_proxy"),
        F.round(heights * area / FLOOR, 6).alias("gfa_m2"),
    )


@dataclass(frozen=True)
class Metric:
    """A metric by name: its unit, the places it is shown to, and its aggregate over cells of a given area."""

    unit: str
    places: int
    value: Callable[[float], Column]


def _share(cls: str) -> Callable[[float], Column]:
    return lambda area: 100.0 * F.avg((F.col("cls") == cls).cast("int"))


def _heights() -> Column:
    """Whole metres: summed before the one division, so the result doesn't depend on partitions."""
    return F.coalesce(F.sum(F.when(F.col("cls") == "building", F.col("h"))), F.lit(0))


#: An entry here is all that a new metric needs.
REGISTRY: dict[str, Metric] = {
    "coverage_pct": Metric("%", 2, _share("building")),
    "street_pct": Metric("%", 2, _share("street")),
    "green_pct": Metric("%", 2, _share("green")),
    "mean_height_m": Metric("m", 2, lambda area: F.coalesce(F.avg(F.when(F.col("cls") == "building", F.col("h"))), F.lit(0.0))),
    "far_proxy": Metric("", 3, lambda area: _heights() / (FLOOR * F.count(F.lit(1)))),
    "gfa_m2": Metric("m2", 1, lambda area: _heights() * area / FLOOR),
}


def measure(cells: DataFrame, names: list[str], tile_m: float, side: int) -> DataFrame:
    """Registered metrics of each tile in one aggregation; an unknown name is an error before any work is done."""
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"no such metric: {', '.join(unknown)}")
    area = (tile_m / side) ** 2
    return cells.groupBy("tile_id").agg(*[F.round(REGISTRY[n].value(area), REGISTRY[n].places).alias(n) for n in names])


def form_metrics(cells: DataFrame, buildings: DataFrame, tile_m: float, side: int) -> DataFrame:
    """Form of each tile: floor area ratio and area, coverage, open space ratio, facade area and its ratio to floor area,
    and the count and mean footprint of buildings (tile_id, label: cells that touch are one, whatever their heights).

    Floors are whole, one at least. A wall stands wherever the cell beside isn't as tall, at a cell's full height.
    """
    from .raster import neighbours

    cell = tile_m / side
    built = cells.where("cls = 'building'").select("tile_id", "r", "c", "h")
    same = neighbours(built, ["h"], [(0, 1), (1, 0), (0, -1), (-1, 0)]).where("h = n_h").groupBy("tile_id", "r", "c").agg(F.count(F.lit(1)).alias("_same"))
    walls = built.join(same, ["tile_id", "r", "c"], "left").withColumn("_walls", 4 - F.coalesce("_same", F.lit(0)))
    floors = F.greatest(F.lit(1.0), F.rint(F.col("h") / FLOOR))
    form = walls.groupBy("tile_id").agg(F.count(F.lit(1)).alias("_foot"), F.sum(floors).alias("_floors"), F.sum(F.col("_walls") * F.col("h")).alias("_walls"))
    count = buildings.groupBy("tile_id").agg(F.count_distinct("label").alias("building_count"))
    t = cells.groupBy("tile_id").agg(F.count(F.lit(1)).alias("_site")).join(form, "tile_id", "left").join(count, "tile_id", "left")
    zero = F.lit(0.0)
    foot, n, floors, walls = (F.coalesce(c, F.lit(0)) for c in ("_foot", "building_count", "_floors", "_walls"))
    return t.select(
        "tile_id", F.round(floors / F.col("_site"), 3).alias("far"), F.round(floors * cell * cell, 1).alias("gfa_m2"), F.round(100.0 * foot / F.col("_site"), 2).alias("coverage_pct"),
        F.round(F.coalesce(F.try_divide(F.col("_site") - foot, floors), zero), 3).alias("open_space_ratio"), F.round(walls * cell, 1).alias("facade_area_m2"),
        F.round(F.coalesce(F.try_divide(walls * cell, floors * cell * cell), zero), 3).alias("facade_to_floor"),
        n.cast("long").alias("building_count"), F.round(F.coalesce(F.try_divide(foot * cell * cell, n), zero), 1).alias("mean_footprint_m2"),
    )
