"""What substring and suffix deduplication share: finding super k-mers that stand in several places."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix, rolled, runs, texts_of, word_symbols
from .common import Staged, short_batches, slices

RUNS = "h bigint, c bigint, v bigint, doc bigint, th bigint, at bigint"
#: A run's first window and how many follow it, in one number: runs are no longer than a segment.
FOLLOW = 1 << 20
#: Stands for a null doc_id: below every other.
NULL_DOC = -(1 << 63)


def ids_repeat(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1))


def keyed(docs: DataFrame, again: bool | None = None, columns: tuple = ("doc_id", "text")) -> DataFrame:
    """Documents with doc (doc_id, null as the least) and th, which together name a row. th is 0 where doc_id
    alone does, else the hash of the text; rows of one doc_id and text are alike in all that follows.
    again: whether a doc_id stands on several rows, if that is known."""
    short_batches(docs.sparkSession)
    again = ids_repeat(docs) if again is None else again
    doc = F.coalesce("doc_id", F.lit(NULL_DOC))
    # not a literal 0, which the optimizer would take out of the join on one side only
    th = F.xxhash64("text") if again else doc.bitwiseAND(F.lit(0).cast("long"))
    return docs.select(*columns, doc.alias("doc"), th.alias("th"))


def super_kmers(rows: DataFrame, size: int, grain: int, in_bytes: bool) -> DataFrame:
    """Each run of windows of keyed rows that share a minimizer: h its hash, c the hash of all it covers, and where
    it is: at holds the first window and, below FOLLOW, how many follow. Over words, v is a second hash of what it
    covers, from another hash of each word; over bytes it is 0."""

    def find(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        def spelled(symbols, first, last):
            view, wide = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
            return np.array([digest(view[wide * a : wide * (b + size)]) for a, b in zip(first, last)], np.uint64).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text", 500_000):
                data, ends = texts_of(part.column("text"))
                symbols = second = data
                if not in_bytes:
                    symbols, begins, stops, ends = word_symbols(data, ends)
                    second = mix(rolled(data, begins, stops, 1))
                starts = np.concatenate([[0], ends[:-1]])
                doc, th = part.column("doc").to_numpy(), part.column("th").to_numpy()
                for first, last, h in runs(symbols, ends, size, grain, in_bytes):
                    row = np.searchsorted(ends, first, side="right")
                    a, b = first.tolist(), last.tolist()
                    c = spelled(symbols, a, b)
                    v = np.zeros(len(c), np.int64) if in_bytes else spelled(second, a, b)
                    columns = [h.astype(np.int64), c, v, doc[row], th[row], (first - starts[row]) * FOLLOW + last - first]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "v", "doc", "th", "at"])

    return rows.select("text", "doc", "th").mapInArrow(find, RUNS)


def repeated(rows: DataFrame, size: int, grain: int, in_bytes: bool, several) -> Staged:
    """Super k-mers whose minimizer stands in several places: h, c, v, doc, th, s, e.

    several: a condition over n, low and high, a minimizer's count and least and greatest doc. Minimizers are counted
    where they are found, and the few that stay are written before they are joined: so a join of two written tables
    is left, of which Spark splits what is hot. What all texts have is dropped as soon as what repeats is known.
    """
    found = Staged(super_kmers(rows, size, grain, in_bytes), "runs")
    by = found.df.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"))
    some = Staged(by.where(several).select("h"), "minimizers")
    s = F.shiftright("at", 20).cast("int")
    shared = found.df.join(some.df.hint("merge"), "h", "left_semi")
    out = Staged(shared.select("h", "c", "v", "doc", "th", s.alias("s"), (s + (F.col("at") % FOLLOW).cast("int")).alias("e")), "shared-runs")
    found.drop()
    some.drop()
    return out


def spans_by_row(spans: DataFrame) -> DataFrame:
    """Stretches (doc, th, start, end) listed for each row of documents; a list is no longer than the text."""
    return spans.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches without overlaps; stretches that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
