"""Packing documents into sequences: shortest-pack-first over the length histogram (Krell et al., 2021)."""

from __future__ import annotations

import heapq
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices, staged, with_rank
from .tokens import encoder, public_path

TOKENS, END = 4096, 2
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def place(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """Fills sequences of `size` from counts by length, longest first, always into the emptiest sequences.

    Returns (length, first rank, first sequence, offset): items of that length from that rank on, until the
    next entry of the length, go to consecutive sequences at the offset. Sequences filled alike are held as one
    pattern with a count, so work and result depend on the number of lengths, at most `size`, not on the items.
    """
    patterns: list[tuple[int, int, int]] = []  # used, first sequence, how many
    made, out = 0, []
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not from 1 to {size}")
        left, rank = histogram[length], 0
        while left:
            if patterns and patterns[0][0] + length <= size:
                used, first, many = heapq.heappop(patterns)
            else:
                used, first, many = 0, made, left
                made += left
            n = min(left, many)
            out.append((length, rank, first, used))
            if used + length < size:
                heapq.heappush(patterns, (used + length, first, n))
            if many > n:
                heapq.heappush(patterns, (used, first + n, many - n))
            left, rank = left - n, rank + n
    return out


def pieces(docs: DataFrame, path: str, size: int = TOKENS, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Each document's ids with the end id, cut into pieces of `size` and a rest; keep_ids adds the ids as binary."""
    short_batches(docs.sparkSession)
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches):
        import pyarrow as pa

        code = encoder(path, False)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), code.encode(part.column("text"))):
                    ids += struct.pack("<I", end)
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        row = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                        rows.append((*row, piece) if keep_ids else row)
                types = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, size: int = TOKENS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to size.

    The driver sees the histogram of lengths, at most `size` rows. Pieces of one length are numbered in a
    distributed way, also if most pieces share it, and find their pattern by that rank; the table of patterns
    is bounded by the lengths, so every task holds it whole.
    """
    import numpy as np

    pieces = staged(pieces.drop("sequence_id", "offset"), "pieces")
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(place(counts, size)), np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def at(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan, key = shared.value, length.to_numpy(np.int64) << 40 | rank.to_numpy(np.int64)
        row = plan[np.searchsorted(plan[:, 0] << 40 | plan[:, 1], key, side="right") - 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + rank.to_numpy(np.int64) - row[:, 1], "offset": row[:, 3]})

    ranked = with_rank(pieces, ["length"], "_rank", "ranked")
    return ranked.withColumn("_at", at("length", "_rank")).select(*pieces.columns, "_at.*")


def pack_documents(docs: DataFrame, path: str, size: int = TOKENS, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text; other columns are dropped) into sequences of at most `size` ids.

    A null or empty text is the end id alone. Repeated rows are packed each for itself. An empty table gives
    an empty one. A text of any length is cut; each id lies in exactly one piece.
    """
    return pack(pieces(docs, path, size, end, keep_ids), size)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from a packing that kept ids: one binary of little-endian 32-bit ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"),
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )


def op3_histogram_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_path("word_bpe_49k.json"))
