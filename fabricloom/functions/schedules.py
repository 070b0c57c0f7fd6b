"""Tables of a diffusion sampler's schedule and of the windows of a large canvas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schedule(rows: DataFrame, t: Column, steps: int = 1000, shift: float = 0.008, gamma: float = 5.0) -> DataFrame:
    """Cosine schedule: what is left of the signal at each row's step t, signal to noise up to gamma, and the loss weight."""
    def part(x):
        return F.pow(F.cos((x + shift) / (1 + shift) * math.pi / 2), 2)

    left = part((t + 1) / float(steps)) / part(F.lit(0.0))
    known = rows.columns
    rows = rows.withColumns({"t": t.cast("int"), "a": F.greatest(F.lit(1e-5), F.least(F.lit(1.0), left))})
    snr = F.col("a") / (1 - F.col("a"))
    return rows.select(
        *known, "t", F.round("a", 6).alias("alphas_cumprod"), F.round(F.least(snr, F.lit(gamma)), 4).alias("clipped_snr"),
        F.round(F.least(snr, F.lit(gamma)) / (snr + 1), 6).alias("weight"),
    )


def steps(rows: DataFrame, total: int, count: Column) -> DataFrame:
    """Of each row count evenly spaced steps (two at least) from the last to 0, each with the next one; -1 after the last."""
    at = lambda i: F.rint((total - 1) - i * float(total - 1) / (F.col("_count") - 1)).cast("int")
    t = rows.withColumn("_count", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    return t.select(*rows.columns, "i", at(F.col("i")).alias("t"), F.when(F.col("i") < F.col("_count") - 1, at(F.col("i") + 1)).otherwise(-1).alias("t_next"))


def windows(rows: DataFrame, length: Column, window: int, stride: int) -> DataFrame:
    """Of each row the origins of windows that cover a length (a window's at least), the last one flush with its end. A
    row without a length has none."""
    rows = rows.where(length.isNotNull())
    n = F.greatest(F.lit(1), F.ceil((length - window) / stride) + 1).cast("int")
    origins = F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(i * stride, length - window).cast("int")))
    return rows.withColumn("origin", F.explode(origins))


def window_weights(rows: DataFrame, window: int) -> DataFrame:
    """Of each row the places of a window and each place's Hann weight, 0.01 at least; they are the same at every origin."""
    places = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    return places.withColumn("weight", F.round(F.greatest(0.5 - 0.5 * F.cos(2 * math.pi * F.col("k") / (window - 1)), F.lit(0.01)), 9))


def embedding(rows: DataFrame, t: Column, size: int) -> DataFrame:
    """Of each row the sinusoidal embedding of its step t, place by place."""
    half = size // 2
    known = rows.columns
    rows = rows.withColumn("t", t.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    f = F.exp(-math.log(10000.0) * (F.col("k") % half) / half)
    return rows.select(*known, "t", "k", F.round(F.when(F.col("k") < half, F.cos(F.col("t") * f)).otherwise(F.sin(F.col("t") * f)), 6).alias("value"))
