"""Linear algebra over vectors in rows: sums are made part by part, matrices of the vectors' width are solved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, vector: str, targets: list[str]) -> np.ndarray:
    """The matrix of products of [1, vector, targets], summed over all rows; its size is the vectors' width squared."""
    import pyarrow as pa

    def partial(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist(), np.float64)
            z = np.hstack([np.ones((len(x), 1)), x, *[batch.column(t).to_numpy().reshape(-1, 1) for t in targets]])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.ravel())], ["i", "j", "s"])

    parts = rows.select(F.col(vector).alias("v"), *targets).mapInArrow(partial, "i bigint, j bigint, s double")
    sums = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    n = int(sums["i"].max()) + 1 if len(sums) else 0
    out = np.zeros((n, n))
    out[sums["i"], sums["j"]] = sums["s"]
    return out


def _covariance(g: np.ndarray) -> np.ndarray:
    n = g[0, 0]
    mean = g[0] / n
    return (g / n - np.outer(mean, mean))[1:, 1:]


def components(rows: DataFrame, vector: str, count: int) -> DataFrame:
    """The first principal components: number, deviation, share of variance, direction (largest entry positive)."""
    c = _covariance(gram(rows, vector, []))
    value, direction = np.linalg.eigh(c)
    order = np.argsort(-value)[:count]
    out = []
    for k, j in enumerate(order):
        v = direction[:, j]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        out.append((k, float(np.sqrt(max(value[j], 0))), float(value[j] / value.sum()), [float(x) for x in v]))
    return rows.sparkSession.createDataFrame(out, "component int, deviation double, share double, direction array<double>")


def directions(rows: DataFrame, vector: str, targets: list[str], ridge: float) -> DataFrame:
    """Ridge regression of standardised targets on vectors: R2, then unit directions made orthogonal in order."""
    g = gram(rows, vector, targets)
    n, k = g[0, 0], len(targets)
    c = _covariance(g)
    x, xy, var = c[:-k, :-k], c[:-k, -k:], np.diag(c)[-k:]
    sd = np.sqrt(np.where(var > 0, var, 1.0))
    b = np.linalg.solve(x * n + ridge * np.eye(len(x)), xy * n / sd)
    r2 = (2 * (b * xy / sd).sum(0) - (b * (x @ b)).sum(0)) / np.where(var > 0, 1.0, np.inf)
    found: list[np.ndarray] = []
    for j in range(k):
        v = b[:, j].copy()
        for u in found:
            v -= (v @ u) * u
        norm = np.linalg.norm(v)
        found.append(v / norm if norm else v)
    out = [(t, float(r2[j]), [float(a) for a in found[j]]) for j, t in enumerate(targets)]
    return rows.sparkSession.createDataFrame(out, "target string, r2 double, direction array<double>")
