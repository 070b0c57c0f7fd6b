"""Writers: corpora by city, rounded metric tables, reports, logs, rewrites, PNG tiles."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(tiles: DataFrame, path: str) -> None:
    """A tile corpus, one folder a city, so that readers of a few cities skip the rest."""
    tiles.repartition("city").write.mode("overwrite").partitionBy("city").parquet(path)


def metric_csv(rows: DataFrame, path: str, places: int = 4) -> None:
    """Doubles rounded half to even."""
    rounded = [F.bround(F.col(c), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*rounded).write.mode("overwrite").csv(path, header=True)


def report(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


#: Answers of one compressed file. It can't be split, so this bounds what one task reads.
ANSWERS = 5_000


def answers(responses: DataFrame, path: str) -> None:
    """Saves answers of a map service by key; those without elements are never saved."""
    responses.where(F.size("elements") > 0).write.mode("append").option("maxRecordsPerFile", ANSWERS).json(path, compression="gzip")


def rewrite(rows: DataFrame, path: str) -> str:
    """Replaces a table that may be what rows are read from: written aside, then swapped by renames; the first old
    version is kept as a backup, later ones go only once the new one has its name. Returns the backup's path."""
    spark = rows.sparkSession
    mark = uuid.uuid4().hex[:8]
    new, old, backup = f"{path}-new-{mark}", f"{path}-old-{mark}", f"{path}-backup"
    rows.write.parquet(new)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(p(backup))
    for a, b in ((path, old if had else backup), (new, path)):
        if not fs.rename(p(a), p(b)):
            raise OSError(f"{a} could not be renamed to {b}")
    if had:
        fs.delete(p(old), True)
    return backup


def png(rgb: bytes, width: int, height: int) -> bytes:
    """An 8-bit RGB image as PNG."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[3 * width * r : 3 * width * (r + 1)] for r in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def images(cells: DataFrame, side: int) -> DataFrame:
    """Cells (tile_id, r, c, cls, grey) drawn as PNG: tile_id, image. One tile is one group."""
    import numpy as np
    import pandas as pd

    colour = {"street": (255, 0, 0), "green": (128, 255, 0)}

    def draw(tile: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((side, side, 3), np.uint8)
        built = tile[tile["cls"] == "building"]
        a[built["r"], built["c"]] = built["grey"].to_numpy()[:, None]
        for cls, rgb in colour.items():
            some = tile[tile["cls"] == cls]
            a[some["r"], some["c"]] = rgb
        return pd.DataFrame({"tile_id": [tile["tile_id"].iloc[0]], "image": [png(a.tobytes(), side, side)]})

    return cells.groupBy("tile_id").applyInPandas(draw, "tile_id int, image binary")


def summary(rows: DataFrame, lines: list, path: str) -> None:
    """Text lines, a row of text for each row and line expression, in the order of both."""
    text = F.explode(F.array(*lines))
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def manifest(facts: dict, spark, path: str) -> None:
    """One JSON object with a run's facts and the time it was written."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()], F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("written"))
    report(row, path)


def once(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Adds to a store, one folder a key, only the keys that it doesn't have; returns the keys that were added."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    have = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if have else rows
    added = new.select(key).distinct()
    added = spark.createDataFrame(added.collect(), added.schema)  # names of cities or snapshots, before they are there
    new.repartition(key).write.mode("append").partitionBy(key).parquet(path)
    return added
