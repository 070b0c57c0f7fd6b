"""Repeated passages by compaction of a De Bruijn graph over words.

Edges are runs of 50 words (token k-mers). Edges that follow each other and share a minimizer travel together as
super k-mers, the usual way to build such graphs in pieces. Where a minimizer stands in different words, the edges of
one copy of each content are told apart: a join gives every edge the edges that come before and after it anywhere, an
edge goes on to the next one only if neither has another neighbour, and edges that go on to each other compact into
one path. All that hold a path's first edge hold the path, so the first document that holds it is its source. A path
counts only where a second hash of its words agrees with the words at the source's coordinates.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import SPACE, mix, rolled, texts_of, window_hashes, word_symbols
from .common import Staged, slices
from .repeats import ids_repeat, keyed, merged, repeated

WORDS, GRAIN = 50, 8
SPANS = "array<struct<start: bigint, end: bigint, source: bigint, source_start: bigint>>"


def content_edges(rows: DataFrame, contents: DataFrame, size: int) -> DataFrame:
    """The edges of contents (h, c, doc, th, s, e: one place of each): h, c, i (place in the content), w (its hash), v
    (a hash of other hashes of its words), before and after (w of its neighbours in the content, null at its ends),
    and doc and p, where it is."""
    at = F.struct("h", "c", "s", "e")
    listed = contents.groupBy("doc", "th").agg(F.collect_list(at).alias("at"))

    def spell(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", 500_000):
                data, ends = texts_of(part.column("text"))
                symbols, begins, stops, ends = word_symbols(data, ends)
                w = window_hashes(symbols, size).astype(np.int64)
                v = window_hashes(mix(rolled(data, begins, stops, 1)), size).astype(np.int64)
                base = np.concatenate([[0], ends[:-1]]).tolist()
                rows = [(x["h"], x["c"], doc, x["s"], b + x["s"], b + x["e"] + 1)
                        for b, doc, at in zip(base, part.column("doc").to_pylist(), part.column("at").to_pylist()) for x in at]
                for k in range(0, len(rows), 20_000):
                    h, c, doc, s, a, z = map(np.array, zip(*rows[k : k + 20_000]))
                    offsets = np.concatenate([[0], np.cumsum(z - a)])
                    flat = np.arange(offsets[-1]) - np.repeat(offsets[:-1], z - a) + np.repeat(a, z - a)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x[flat])) for x in (w, v)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, c, doc, s)), *lists], ["h", "c", "doc", "s", "w", "v"])

    joined = rows.join(listed.hint("shuffle_hash"), ["doc", "th"]).select("text", "doc", "th", "at")
    spelled = joined.mapInArrow(spell, "h bigint, c bigint, doc bigint, s bigint, w array<bigint>, v array<bigint>")
    each = spelled.select("h", "c", "doc", "s", F.col("w").alias("_w"), F.posexplode(F.arrays_zip("w", "v")).alias("i", "x"))
    return each.select(
        "h", "c", "i", "x.w", "x.v", F.get("_w", F.col("i") - 1).alias("before"), F.get("_w", F.col("i") + 1).alias("after"),
        "doc", (F.col("s") + F.col("i")).alias("p"),
    )


def edge_nodes(edges: DataFrame) -> DataFrame:
    """Of each edge (h, w): whether its node before and the one after it are nonbranching as far as this edge tells (one
    neighbour everywhere, no end of a content), and its source: the first document that holds it, where, and v there."""

    def single(column: str):
        return (F.count(column) == F.count(F.lit(1))) & (F.min(column) == F.max(column))

    return edges.groupBy("h", "w").agg(
        F.coalesce(single("before"), F.lit(False)).alias("enters"), F.coalesce(single("after"), F.lit(False)).alias("leaves"),
        F.min(F.struct("doc", F.col("p").cast("long").alias("p"), "v")).alias("src"),
    )


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nonbranching paths of each content: h, c, a and b (first and last edge), and src, the source of its first edge.

    An edge begins a path unless it is the only way on from the edge before it and that one the only way to it. An
    edge whose second hash is not that of its source's words leaves the path unproven, and is left out.
    """
    w = Window.partitionBy("h", "c").orderBy("i")
    joined = edges.join(nodes.hint("merge"), ["h", "w"])
    goes_on = F.col("enters") & F.coalesce(F.lag("leaves").over(w), F.lit(False))
    proven = F.col("v") == F.col("src.v")
    walk = joined.withColumn("_new", (~goes_on).cast("int")).withColumn("_proven", proven)
    walk = walk.withColumn("_path", F.sum("_new").over(w))
    path = walk.groupBy("h", "c", "_path").agg(
        F.min("i").alias("a"), F.max("i").alias("b"), F.min(F.struct("i", "src")).alias("_first"), F.bool_and("_proven").alias("_proven")
    )
    return path.where("_proven").select("h", "c", "a", "b", F.col("_first.src").alias("src"))


def repeated_paths(rows: DataFrame, size: int = WORDS, again: bool = True) -> DataFrame:
    """Paths of a keyed row that also stand in a document with a smaller doc_id: doc, th, s and e (first and last
    edge), src_doc and src_s (the first document that has them and where). again: whether rows may repeat."""
    shared = repeated(rows, size, GRAIN, False, F.col("low") < F.col("high"))
    each = Staged(shared.df.groupBy("h", "c").agg(F.min(F.struct("doc", "s", "th", "e", "v")).alias("one")), "contents")
    count = Staged(each.df.groupBy("h").agg((F.min("c") != F.max("c")).alias("branches")).where("branches").select("h"), "branching")
    branching = each.df.join(count.df.hint("merge"), "h", "left_semi").select("h", "c", "one.doc", "one.th", "one.s", "one.e")
    once = rows.dropDuplicates(["doc", "th"]) if again else rows
    edges = Staged(content_edges(once, branching, size), "edges")
    nodes = Staged(edge_nodes(edges.df), "nodes")
    first = each.df.select("h", "c", F.col("one.v").alias("_v"))
    paths = compact(edges.df, nodes.df).join(first.hint("merge"), ["h", "c"])
    paths = paths.select("h", "c", "a", "b", F.col("src.doc").alias("src_doc"), F.col("src.p").alias("src_s"), "_v")
    # where a minimizer always stands in the same words, its edges are one path
    alone = each.df.join(count.df.hint("merge"), "h", "left_anti").select(
        "h", "c", F.lit(0).alias("a"), (F.col("one.e") - F.col("one.s")).alias("b"), F.col("one.doc").alias("src_doc"),
        F.col("one.s").cast("long").alias("src_s"), F.col("one.v").alias("_v"),
    )
    paths = Staged(paths.unionByName(alone), "paths")
    for table in (each, count, edges, nodes):
        table.drop()
    found = shared.df.join(paths.df.hint("merge"), ["h", "c"]).where((F.col("v") == F.col("_v")) & (F.col("src_doc") < F.col("doc")))
    s = F.col("s").cast("long")
    return found.select("doc", "th", (s + F.col("a")).alias("s"), (s + F.col("b")).alias("e"), "src_doc", "src_s")


def long_spans(paths: DataFrame, size: int) -> DataFrame:
    """Paths that continue each other in a row and in their source document, as one span of words with the source's
    coordinates; listed for each row of documents. A list is no longer than the text."""
    w = Window.partitionBy("doc", "th").orderBy("s", "e")
    step = paths.withColumn("_new", (
        (F.lag("e").over(w) + 1 < F.col("s"))
        | (F.lag("src_doc").over(w) != F.col("src_doc"))
        | (F.lag(F.col("src_s") - F.col("s")).over(w) != F.col("src_s") - F.col("s"))
    ).cast("int"))
    step = step.withColumn("_span", F.sum(F.coalesce("_new", F.lit(1))).over(w))
    span = step.groupBy("doc", "th", "_span").agg(
        F.min("s").alias("start"), (F.max("e") + size).alias("end"), F.first("src_doc").alias("source"), F.min("src_s").alias("source_start")
    )
    return span.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "source", "source_start"))).alias("spans"))


def _cut(keep_text: bool):
    """Cuts the words that spans cover out of each text."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text, spans in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "spans"))):
                    words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split(b" ")
                    words = [x for x in words if x]
                    gone = merged([(s["start"], s["end"]) for s in spans or []])
                    kept, at = [], 0
                    for a, b in gone:
                        kept += words[at:a]
                        at = b
                    left = b" ".join(kept + words[at:] if gone else words)
                    row = (doc, len(words), sum(b - a for a, b in gone), hashlib.sha256(left).hexdigest(), spans or [])
                    rows.append((*row, left.decode("utf-8", "surrogatepass")) if keep_text else row)
                span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "source", "source_start")]))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span] + [pa.string()] * keep_text
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + ["kept_text"] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return cut


_PLAIN = bytes(32 if SPACE[b] else b for b in range(256))


def remove_repeats(docs: DataFrame, size: int = WORDS, keep_text: bool = True) -> DataFrame:
    """Documents (doc_id, text) without the words of passages that also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256, spans (removed words as start and end, which may overlap, with
    the doc_id they first stand in and the word where) and kept_text (the rest, joined by single spaces). Passages
    are judged on the input. A null or empty text has no words; a null doc_id counts as the smallest; rows of one
    doc_id are never smaller than each other, so repeated rows stay. An empty table gives an empty one. Words are
    told apart by two 64-bit hashes, and so are passages; nothing is removed where either differs.
    """
    again = ids_repeat(docs)
    rows = keyed(docs, again)
    spans = long_spans(repeated_paths(rows, size, again), size)
    schema = f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans {SPANS}" + (", kept_text string" if keep_text else "")
    joined = rows.join(spans.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(keep_text), schema)


def op6_debruijn_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).drop("spans")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS s FROM d, unnest(range(1, len(ws) - 48)) AS u(i)),
rep AS (SELECT rid, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
gone AS (SELECT DISTINCT rid, i + k AS i FROM rep, unnest(range(0, 50)) AS v(k)),
g AS (SELECT rid, list(i) AS gone, count(*) AS n FROM gone GROUP BY rid),
pos AS (SELECT rid, i, ws[i] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN kept USING (rid)
"""
