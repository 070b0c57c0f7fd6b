"""Kernels that go through a tile step by step, one grouped map a tile: labels, distances, thinning."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _mask(tile: pd.DataFrame, side: int) -> np.ndarray:
    m = np.zeros((side, side), bool)
    m[tile["r"], tile["c"]] = tile["on"]
    return m


def label(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Least cell number (from 1) of each component, 0 outside: labels spread until they stand still."""
    h, w = mask.shape
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * eight
    while True:
        old = lab.copy()
        padded = np.pad(np.where(mask, lab, h * w + 1), 1, constant_values=h * w + 1)
        near = padded[1:-1, 1:-1]
        for a, b in steps:
            near = np.minimum(near, np.minimum(padded[1 + a : 1 + a + h, 1 + b : 1 + b + w], padded[1 - a : 1 - a + h, 1 - b : 1 - b + w]))
        lab = np.where(mask, near, 0)
        lab[mask] = np.minimum(lab[mask], lab.ravel()[lab[mask] - 1])  # jump to the label of one's label
        if (lab == old).all():
            return lab


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each cell to the nearest cell that isn't in the mask; infinite if there is none."""
    h, w = mask.shape
    gap = np.where(mask, np.inf, 0.0)
    for k in range(1, h):  # nearest in the column
        gap[k] = np.minimum(gap[k], gap[k - 1] + 1)
    for k in range(h - 2, -1, -1):
        gap[k] = np.minimum(gap[k], gap[k + 1] + 1)
    off = np.arange(w)[:, None] - np.arange(w)[None, :]
    return np.sqrt((gap[:, None, :] ** 2 + off[None] ** 2).min(-1))


def nearest_cell(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the mask cell nearest to each cell, the first in row order of equals. The mask has a cell."""
    h, w = mask.shape
    rows, cols = np.nonzero(mask)
    r, c = np.indices((h, w))
    best = np.full((h, w), np.inf)
    at = np.zeros((h, w), np.int64)
    for k in range(0, len(rows), 256):  # in row order, so of equals the first stays
        some = slice(k, k + 256)
        d = (r[..., None] - rows[some]) ** 2 + (c[..., None] - cols[some]) ** 2
        i, low = d.argmin(-1), d.min(-1)
        better = low < best
        best[better], at[better] = low[better], i[better] + k
    return rows[at], cols[at]


def signed_distance(mask: np.ndarray, reach: float) -> np.ndarray:
    """Positive inside, half a cell off the edge on either side, cut at reach."""
    inside, outside = distance(mask), distance(~mask)
    d = np.where(mask, inside - 0.5, 0.5 - outside)
    return np.clip(d, -reach, reach)


@lru_cache(1)
def _thinning() -> np.ndarray:
    """For the two half steps of Zhang and Suen (1984), which of the 256 neighbourhoods of a cell let it go.

    Bit k of a neighbourhood is the neighbour at k eighths of a turn from north, clockwise.
    """
    code = np.arange(256)
    bit = (code[:, None] >> np.arange(8)) & 1
    filled, turns = bit.sum(1), ((bit == 0) & (np.roll(bit, -1, 1) == 1)).sum(1)
    north, east, south, west = bit[:, ::2].T.astype(bool)
    edge = (filled >= 2) & (filled <= 6) & (turns == 1)
    return np.stack([edge & ~(east & south & (north | west)), edge & ~(north & west & (east | south))])


def thin(mask: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Thins a mask to lines, at most so many rounds of two half steps."""
    h, w = mask.shape
    m, go, still = np.pad(mask, 1), _thinning(), 0
    turn = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    for half in range(2 * rounds):
        code = sum(m[1 + a : 1 + a + h, 1 + b : 1 + b + w].astype(np.int64) << k for k, (a, b) in enumerate(turn))
        drop = m[1:-1, 1:-1] & go[half % 2][code]
        m[1:-1, 1:-1] &= ~drop
        still = 0 if drop.any() else still + 1
        if half % 2 and still >= 2:
            break
    return m[1:-1, 1:-1]


def _each(cells: DataFrame, on, side: int, kernel, schema: str) -> DataFrame:
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        return kernel(int(tile["tile_id"].iloc[0]), _mask(tile, side))

    return cells.select("tile_id", "r", "c", on.alias("on")).groupBy("tile_id").applyInPandas(run, schema)


def _long(tile: int, values: np.ndarray, keep: np.ndarray, name: str) -> pd.DataFrame:
    r, c = np.nonzero(keep)
    return pd.DataFrame({"tile_id": tile, "r": r, "c": c, name: values[r, c]})


def components(cells: DataFrame, on, eight: bool, side: int) -> DataFrame:
    """Components of the cells for which on holds: tile_id, r, c, label (the least cell number in it, from 1)."""
    return _each(cells, on, side, lambda t, m: _long(t, label(m, eight), m, "label"), "tile_id int, r int, c int, label int")


def two_labels(side: int):
    """A grouped map of cells (tile_id, r, c, on) to the components, corners included, of those that are on and of the others:
    tile_id, r, c, junction (on), label."""
    def kernel(tile: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for on in (True, False):
            mask = np.zeros((side, side), bool)
            some = tile[tile["on"] == on]
            mask[some["r"], some["c"]] = True
            parts.append(_long(int(tile["tile_id"].iloc[0]), label(mask, True), mask, "label").assign(junction=on))
        return pd.concat(parts)[["tile_id", "r", "c", "junction", "label"]]

    return kernel


def cleaned(cells: DataFrame, on, least: int, side: int) -> DataFrame:
    """Components of at least so many cells: tile_id, r, c, label."""
    parts = components(cells, on, False, side)
    large = parts.groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return parts.join(large.select("tile_id", "label"), ["tile_id", "label"], "left_semi").select("tile_id", "r", "c", "label")


def holes(cells: DataFrame, on, below: int, side: int) -> DataFrame:
    """Cells of holes in a mask with fewer cells than that, none of them at the border."""
    parts = components(cells, ~on, False, side)
    edge = F.max((F.col("r").isin(0, side - 1) | F.col("c").isin(0, side - 1)).cast("int"))
    small = parts.groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("n"), edge.alias("e")).where((F.col("n") < below) & (F.col("e") == 0))
    return parts.join(small.select("tile_id", "label"), ["tile_id", "label"], "left_semi").select("tile_id", "r", "c")


def distances(cells: DataFrame, on, side: int, reach: float = 8.0) -> DataFrame:
    """Signed distances of all cells to the edge of where on holds."""
    return _each(cells, on, side, lambda t, m: _long(t, signed_distance(m, reach), np.ones_like(m), "distance"), "tile_id int, r int, c int, distance double")


def nearest(cells: DataFrame, on, side: int) -> DataFrame:
    """For each cell of a tile in which on holds somewhere, the nearest cell where it does: nr, nc."""
    def kernel(t: int, m: np.ndarray) -> pd.DataFrame:
        r, c = np.indices(m.shape)
        if not m.any():
            return pd.DataFrame({"tile_id": [], "r": [], "c": [], "nr": [], "nc": []})
        nr, nc = nearest_cell(m)
        return pd.DataFrame({"tile_id": t, "r": r.ravel(), "c": c.ravel(), "nr": nr.ravel(), "nc": nc.ravel()})

    return _each(cells, on, side, kernel, "tile_id int, r int, c int, nr int, nc int")


def skeletons(cells: DataFrame, on, side: int) -> DataFrame:
    """Cells of the thinned mask."""
    return _each(cells, on, side, lambda t, m: _long(t, m, thin(m), "on"), "tile_id int, r int, c int, on boolean").drop("on")


def _line_facts(line: np.ndarray, cell_m: float) -> tuple[float, int, int]:
    """Length of thin lines (diagonal steps are longer), junctions (those that touch are one) and dead ends."""
    h, w = line.shape
    padded = np.pad(line, 1)
    straight = sum(padded[1 + a : 1 + a + h, 1 + b : 1 + b + w].astype(int) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    slanted = sum(padded[1 + a : 1 + a + h, 1 + b : 1 + b + w].astype(int) for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1)))
    around = np.where(line, straight + slanted, 0)
    length = (straight[line].sum() + 2**0.5 * slanted[line].sum()) / 2 * cell_m
    return round(float(length), 4), len(np.unique(label(around >= 3, True))) - 1, int((around == 1).sum())


def tile_facts(cells: DataFrame, cell_m: float, side: int) -> DataFrame:
    """Counts and mean sizes of buildings, streets and blocks, and facts of street lines: one grouped map a tile."""
    area = cell_m * cell_m
    schema = "tile_id int, building_count long, street_components long, block_count long, mean_footprint_m2 double, mean_block_m2 double, street_length_m double, intersections long, dead_ends long"

    def parts(mask: np.ndarray, eight: bool) -> tuple[int, float]:
        n = len(np.unique(label(mask, eight)[mask]))
        return n, mask.sum() * area / n if n else None

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        built, street = np.zeros((side, side), bool), np.zeros((side, side), bool)
        built[tile["r"], tile["c"]], street[tile["r"], tile["c"]] = tile["cls"] == "building", tile["cls"] == "street"
        (b, foot), (s, _), (k, block) = parts(built, False), parts(street, True), parts(~street, False)
        return pd.DataFrame([(int(tile["tile_id"].iloc[0]), b, s, k, foot, block, *_line_facts(thin(street), cell_m))], columns=[x.split()[0] for x in schema.split(", ")])

    return cells.select("tile_id", "r", "c", "cls").groupBy("tile_id").applyInPandas(run, schema)


def skeleton_facts(skeleton: DataFrame, cell_m: float, side: int) -> DataFrame:
    """Length of each tile's lines (diagonal steps are longer), junctions and dead ends, from counts of neighbours;
    junction cells that touch are one junction."""
    from .raster import neighbours

    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    near = neighbours(skeleton, ["r", "c"], around)
    far = (F.col("n_r") != F.col("r")) & (F.col("n_c") != F.col("c"))
    one = near.groupBy("tile_id", "r", "c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(far, 2.0**0.5).otherwise(1.0)).alias("l"))
    junctions = components(one, F.col("n") >= 3, True, side).groupBy("tile_id").agg(F.count_distinct("label").alias("intersections"))
    facts = one.groupBy("tile_id").agg(F.round(F.sum("l") / 2 * cell_m, 4).alias("street_length_m"), F.count_if(F.col("n") == 1).alias("dead_ends"))
    return facts.join(junctions, "tile_id", "left").withColumn("intersections", F.coalesce("intersections", F.lit(0)))
