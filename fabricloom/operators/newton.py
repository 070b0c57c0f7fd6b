"""Damped minimum-norm steps of parameters towards absolute targets, a row an option, batch by batch inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows, filled up with 0, and how long each is: -1 where it or one of its numbers is null."""
    n = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    rows = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), n.max(initial=0)))
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, n)
    length[rows[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, length


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums in the order of the parameters, as the SQL has them."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out = out + a[:, i] * b[:, i]
    return out


def towards(options: DataFrame, start: str, targets: tuple[str, str], offsets: tuple[str, str], slopes: tuple[str, str], damping: float, cap: float, tolerance: float, most: int) -> DataFrame:
    """Adds w (the parameters reached), steps (how many were taken) and miss (the larger of what two metrics are off by).

    A metric is its offset plus its slopes (an array, a number a parameter) times the parameters. Each step is the shortest one that would close both
    gaps, J' (J J' + damping I)^-1 gap, no longer than cap; an option stands still once both gaps are within the tolerance, and stops
    after `most` steps. A null in any of it gives nulls.
    """
    made = [T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("steps", T.IntegerType()), T.StructField("miss", T.DoubleType())]

    def solve(batch: pa.RecordBatch) -> list[pa.Array]:
        (w, length), *js = (matrix(batch.column(c)) for c in (start, *slopes))
        known = [batch.column(c).cast(pa.float64()) for c in (*targets, *offsets)]
        sound = length >= 0
        for other in js:
            sound &= other[1] == length
        for c in known:
            sound &= ~c.is_null().to_numpy(zero_copy_only=False)
        here = np.flatnonzero(sound)
        wide = length[here].max(initial=0)
        w, (j0, j1) = w[here, :wide], (j[here, :wide] for j, _ in js)
        t0, t1, o0, o1 = (c.to_numpy(zero_copy_only=False)[here].astype(np.float64) for c in known)
        aa, bb, ab = dot(j0, j0) + damping, dot(j1, j1) + damping, dot(j0, j1)
        det, steps = aa * bb - ab * ab, np.zeros(len(here), np.int32)
        p, q = t0 - o0 - dot(j0, w), t1 - o1 - dot(j1, w)
        for _ in range(most):
            m = np.flatnonzero(~(np.maximum(np.abs(p), np.abs(q)) <= tolerance))
            if not len(m):
                break
            u, v = (p[m] * bb[m] - q[m] * ab[m]) / det[m], (q[m] * aa[m] - p[m] * ab[m]) / det[m]
            way = j0[m] * u[:, None] + j1[m] * v[:, None]
            norm = np.sqrt(dot(way, way))
            part = np.where(norm == 0, 1.0, np.fmin(1.0, cap / norm))
            w[m] = w[m] + way * part[:, None]
            p[m], q[m] = t0[m] - o0[m] - dot(j0[m], w[m]), t1[m] - o1[m] - dot(j1[m], w[m])
            steps[m] += 1
        size, gone = np.zeros(len(sound), np.int64), ~sound
        size[here] = length[here]
        flat = w[np.arange(wide) < length[here, None]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.concatenate([gone, [False]])), pa.array(flat))
        whole = [np.zeros(len(sound), x.dtype) for x in (steps, p)]
        whole[0][here], whole[1][here] = steps, np.maximum(np.abs(p), np.abs(q))
        return [lists, *(pa.array(x, mask=gone) for x in whole)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                with np.errstate(all="ignore"):
                    yield pa.RecordBatch.from_arrays([*batch.columns, *solve(batch)], [*batch.schema.names, *(f.name for f in made)])

    return options.mapInArrow(run, T.StructType([*options.schema.fields, *made]))
