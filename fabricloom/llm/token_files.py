"""Files of token ids in patched frame-of-reference blocks (Zukowski et al., 2006).

A file: blocks, an index, the index's size, MAGIC. A block of 1,024 ids: their minimum is taken off, the rest is
packed at the width that holds a given share of them, and ids that need more are listed as exceptions. The index
has each block's place, minimum and width and each document's number and count of ids, so that ids from any
place on can be read without what stands before.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import passing_path, short_batches, slices, staged
from .tokens import encoder, public_path

BLOCK, LANES, MAGIC = 1024, 32, b"PFORids1"
SHARE = 0.95
END = 2


def pack_bits(values, width: int):
    """(blocks, 1024) values below 2**width as (blocks, width, 32) words: 32 lanes side by side."""
    import numpy as np

    v = values.reshape(-1, BLOCK // LANES, LANES)
    out = np.zeros((len(v), width, LANES), np.uint32)
    for i in range(BLOCK // LANES if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out


def unpack_bits(words, width: int):
    import numpy as np

    out = np.zeros((len(words), BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(BLOCK // LANES if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, i] = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, i] |= words[:, word + 1] << np.uint32(32 - shift)
        out[:, i] &= mask
    return out.reshape(-1, BLOCK)


def encode_blocks(ids, share: float = SHARE) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The bytes of each block of (blocks, 1024) ids, and its (minimum, width)."""
    import numpy as np

    low = ids.min(axis=1)
    rest = ids - low[:, None]
    at = min(BLOCK - 1, int(share * BLOCK))
    fits = np.partition(rest, at, axis=1)[:, at].astype(np.int64)
    widths = np.ceil(np.log2(fits + 1)).astype(int)
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        some = rest[rows]
        over = some >> np.uint32(width) if width < 32 else np.zeros_like(some)
        packed = pack_bits(some & np.uint32((1 << width) - 1), width)
        block, place = np.nonzero(over)
        ends = np.searchsorted(block, np.arange(len(rows) + 1))
        for k, row in enumerate(rows.tolist()):
            p, v = place[ends[k] : ends[k + 1]], over[k, place[ends[k] : ends[k + 1]]]
            out[row] = packed[k].tobytes() + struct.pack("<H", len(p)) + p.astype("<u2").tobytes() + v.astype("<u4").tobytes()
    return out, list(zip(low.tolist(), widths.tolist()))


def decode_blocks(data: bytes, starts, lows, widths):
    """Ids of consecutive blocks; starts: the place of each in data."""
    import numpy as np

    out = np.empty((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        rows, size = np.flatnonzero(widths == width), 4 * LANES * width
        words = np.stack([np.frombuffer(data, "<u4", LANES * width, starts[r]).reshape(width, LANES) for r in rows])
        some = unpack_bits(words, width)
        for k, r in enumerate(rows.tolist()):
            at = int(starts[r]) + size
            (n,) = struct.unpack_from("<H", data, at)
            if n:
                place = np.frombuffer(data, "<u2", n, at + 2)
                some[k, place] |= np.frombuffer(data, "<u4", n, at + 2 + 2 * n) << np.uint32(width)
        out[rows] = some + np.asarray(lows, np.uint32)[rows][:, None]
    return out


class Writer:
    """One file, written as ids come in; it holds a few blocks at a time."""

    def __init__(self, sink, share: float = SHARE):
        import numpy as np

        self.sink, self.share, self.at = sink, share, 0
        self.waiting, self.waits, self.index, self.docs = [], 0, [], []
        self.np = np

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc is None, doc or 0, len(ids) // 4))
        self.waiting.append(ids)
        self.waits += len(ids) // 4
        if self.waits >= 256 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = self.np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        if last and len(rest):
            ids, whole = self.np.concatenate([ids, self.np.full(-len(ids) % BLOCK, rest.min(), "<u4")]), len(ids) + -len(ids) % BLOCK
            rest = rest[:0]
        for begin in range(0, whole, 256 * BLOCK):
            blocks, heads = encode_blocks(ids[begin : min(whole, begin + 256 * BLOCK)].reshape(-1, BLOCK), self.share)
            for data, (low, width) in zip(blocks, heads):
                self.index.append((self.at, low, width))
                self.sink.write(data)
                self.at += len(data)
        self.waiting, self.waits = ([rest.tobytes()], len(rest)) if len(rest) else ([], 0)

    def close(self) -> tuple[int, int]:
        """Writes the index; returns the numbers of documents and ids."""
        if self.waits:
            self._flush(True)
        np, total = self.np, sum(n for _, _, n in self.docs)
        blocks = np.array(self.index, np.int64).reshape(-1, 3)
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        foot = struct.pack("<QQ", len(blocks), len(docs)) + blocks.astype("<i8").tobytes() + docs.astype("<i8").tobytes()
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        return len(docs), total


class Reader:
    """Reads a file's index, then ids of any range of blocks."""

    def __init__(self, source):
        import numpy as np

        self.source, size = source, source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        (foot,) = struct.unpack("<Q", tail[:8])
        data = source.read_at(foot, size - 16 - foot)
        n, m = struct.unpack_from("<QQ", data)
        self.blocks = np.frombuffer(data, "<i8", 3 * n, 16).reshape(n, 3)
        self.docs = np.frombuffer(data, "<i8", 3 * m, 16 + 24 * n).reshape(m, 3)
        self.end = size - 16 - foot

    def ids(self, first: int, last: int):
        """Ids of blocks first to last - 1; the last block of a file is filled up."""
        starts, lows, widths = self.blocks[first:last].T
        stop = int(self.blocks[last][0]) if last < len(self.blocks) else self.end
        data = self.source.read_at(stop - int(starts[0]), int(starts[0]))
        return decode_blocks(data, starts - starts[0], lows, widths).reshape(-1)

    def documents(self, step: int = 256):
        """(doc_id, ids as bytes) of each document in order, holding `step` blocks and one document at a time."""
        block, have = 0, b""
        for null, doc, n in self.docs.tolist():
            parts, got = [have], len(have)
            while got < 4 * n:
                more = self.ids(block, min(block + step, len(self.blocks))).astype("<u4").tobytes()
                block += step
                parts.append(more)
                got += len(more)
            have = b"".join(parts) if len(parts) > 1 else have
            yield (None if null else doc), have[: 4 * n]
            have = have[4 * n :]


def write_ids(docs: DataFrame, folder: str, path: str, end: int = END, share: float = SHARE) -> DataFrame:
    """Encodes documents (doc_id, text) and writes their ids in ascending doc_id order into files of a shared folder.

    Returns a staged table of files: file, path, n_docs, n_ids, and start, the ids in all files before it. A
    null doc_id comes first; rows of one doc_id are ordered by their text's hash, and may spread over files. A
    null or empty text has the end id alone; a text of any length lies in one file. No file is written for an
    empty table. A task writes under a name of its own and renames when whole, so a task that runs again does
    no harm.
    """

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        number, code, writer = TaskContext.get().partitionId(), encoder(path, True), None
        final = f"{root}/ids-{number:06d}"
        own = f"{final}-{uuid.uuid4().hex}.part"
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                if writer is None:
                    files.create_dir(root)
                    sink = files.open_output_stream(own)
                    writer = Writer(sink, share)
                for doc, ids in zip(part.column("doc_id").to_pylist(), code.encode(part.column("text"))):
                    writer.add(doc, ids + struct.pack("<I", end))
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            files.move(own, final)
            row = [[number], [folder + "/" + os.path.basename(final)], [n_docs], [n_ids]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["file", "path", "n_docs", "n_ids"])

    short_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    written = staged(ordered.mapInArrow(write, "file bigint, path string, n_docs bigint, n_ids bigint"), "id-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(files: DataFrame, keep_ids: bool = True) -> DataFrame:
    """Reads files back, each in one task: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids as binary."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64()] * 4 + [pa.binary()] * keep_ids

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                at, rows, held = row["start"], [], 0
                with store.open_input_file(name) as source:
                    for doc, ids in Reader(source).documents():
                        one = (doc, at, len(ids) // 4, zlib.crc32(ids))
                        rows.append((*one, ids) if keep_ids else one)
                        at, held = at + len(ids) // 4, held + len(ids) * keep_ids + 64
                        if held > 4_000_000:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(tasks, "path").mapInArrow(read, schema)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_ids(docs, passing_path(spark, "ids"), public_path("byte_bpe_50k.json"))
    return read_ids(files, keep_ids=False)
