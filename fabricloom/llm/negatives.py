"""Hard negatives by a two-dimensional block matrix product: rows of anchors times rows of candidates, cut along
both rows and dimensions.

A panel holds a block of rows and a chunk of dimensions. Each anchor panel meets each candidate panel of its chunk,
their product is a partial tile of int64 scores, a shuffle brings a tile's chunks together to be added, and what leaves
a tile is the best few of each anchor's windows. A third of all rows may have one label: blocks have a fixed number of
rows, so no task holds a label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, with_rank


@dataclass(frozen=True)
class Shape:
    """Rows of an anchor block and of a candidate block, dimensions of a chunk. A partial tile has anchors * candidates
    numbers of 8 bytes; more chunks mean smaller panels but more tiles to add."""

    anchors: int = 256
    candidates: int = 2048
    chunk: int = 32


SCALE = 256  # fixed value: a component x counts as floor(256 * x)
PANEL = "k int, rids binary, ids binary, labels binary, windows binary, q binary"
TILE = "ag string, ab bigint, j bigint, a_rids binary, a_ids binary, a_labels binary, windows binary, b_rids binary, b_ids binary, b_labels binary, tile binary"
BEST = "a_rid bigint, anchor_id bigint, p_rid bigint, positive_id bigint, positive_score bigint, rid bigint, id bigint, score bigint"


def quantised(rows: DataFrame, vec_id: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """Rows that take part, as rid, id, label, code, anchor, q: whole numbers floor(256 * x). Rows with a null id, label
    or vector, or with a null or non-finite component, do not. code is the label, or a hash of one that isn't a number."""
    whole = rows.select(label.alias("label")).schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    out = rows.select(F.col(vec_id).alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("x"))
    out = out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull()), F.lit(False)))
    sound = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform("x", lambda v: F.floor(SCALE * v.cast("double")).cast("long"))
    code = F.col("label").cast("long") if whole else F.xxhash64("label")
    return out.where(sound).select(F.monotonically_increasing_id().alias("rid"), "id", "label", code.alias("code"), "anchor", q.alias("q"))


def blocks(rows: DataFrame, size: int, rank: str, name: str, staged: Scratch):
    """Deals rows out to numbered blocks of one label each, and of all labels with fewer rows than a block together.
    Returns rows with g (the group of labels), block, and the range of blocks of a group; and how many blocks there are."""
    large = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).select("code", F.lit(True).alias("large"))
    named = rows.join(staged(large, f"{name}-labels"), "code", "left").withColumn("g", F.when(F.col("large"), F.col("code").cast("string")).otherwise("rest")).drop("large")
    ranked = with_rank(named, ["g"], rank, f"{name}-rows").withColumn("nth", F.floor(F.col(rank) / size))
    count = staged(ranked.groupBy("g").agg((F.max("nth") + 1).alias("n")), f"{name}-groups")
    # one row a label with at least a block of rows
    first = count.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = staged(first.select("g", "first", (F.col("first") + F.col("n") - 1).alias("last")), f"{name}-first")
    total = count.agg(F.sum("n")).first()[0] or 0
    return ranked.join(groups, "g").withColumn("block", F.col("first") + F.col("nth")), groups, total


def _longs(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64)


def panels(rows: DataFrame, keys: list[str], chunk: int, dims: int) -> DataFrame:
    """Each block of rows as one row a chunk of dimensions. Rows stand by id, so that equal scores later stand so too.
    Chunk 0 carries the rows' own columns. A vector that is shorter than others counts as filled up with zeros."""
    kinds = {"string": "string", "bigint": "bigint"}
    schema = ", ".join(f"{k} {kinds[dict(rows.dtypes)[k]]}" for k in keys) + ", " + PANEL
    count = max(1, -(-dims // chunk))

    def pack(table):
        import pyarrow as pa

        rids, ids = _longs(table["rid"]), _longs(table["id"])
        order = np.lexsort([rids, ids])
        lists = table["q"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        full = np.zeros((len(ids), count * chunk), "<i8")
        flat = _longs(lists.flatten())
        row = np.repeat(np.arange(len(ids)), lengths)
        full[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        full = full[order]
        labels = _longs(table["code"])[order].astype("<i8").tobytes()
        windows = b""
        if "windows" in table.column_names:
            kept = table["windows"].to_pylist()
            parts = [(at, w["p_rid"], w["positive_id"], w["score"]) for at, i in enumerate(order.tolist()) for w in kept[i]]
            windows = np.array(parts, "<i8").reshape(-1, 4).tobytes()
        own = [rids[order].astype("<i8").tobytes(), ids[order].astype("<i8").tobytes(), labels, windows]
        head = [table[k][0].as_py() for k in keys]
        out = [[*head, k, *(own if k == 0 else [None] * 4), np.ascontiguousarray(full[:, k * chunk : (k + 1) * chunk]).tobytes()] for k in range(count)]
        types = [table.schema.field(k).type for k in keys] + [pa.int32()] + [pa.binary()] * 5
        names = [*keys, "k", "rids", "ids", "labels", "windows", "q"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    columns = [*keys, "rid", "id", "code", "q", *(["windows"] if "windows" in rows.columns else [])]
    return rows.select(columns).groupBy(*keys).applyInArrow(pack, schema)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 matrix of inner products; by way of doubles where no partial sum can leave the range in which they are
    exact. Beyond int64 it wraps."""
    most = lambda x: int(np.abs(x.astype(float)).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype("<i8")
    return a @ b.T


def partial_tiles(anchors: DataFrame, candidates: DataFrame, chunk: int) -> DataFrame:
    """Products of the panels of one chunk; anchors hold a row a candidate block that they have to meet."""
    a = anchors.select("ag", "ab", "j", "k", F.col("rids").alias("a_rids"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), "windows", F.col("q").alias("a_q"))
    b = candidates.select("j", "k", F.col("rids").alias("b_rids"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("q").alias("b_q"))
    names = [x.split()[0] for x in TILE.split(", ")]

    def multiply(batches):
        import pyarrow as pa

        for batch in batches:
            place = {n: batch.schema.get_field_index(n) for n in [*names[:-1], "a_q", "b_q"]}
            for r in range(batch.num_rows):
                both = [np.frombuffer(batch.column(place[n])[r].as_py(), "<i8").reshape(-1, chunk) for n in ("a_q", "b_q")]
                kept = [batch.column(place[n]).slice(r, 1) for n in names[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([product(*both).tobytes()], pa.binary())], names)

    return a.join(b, ["j", "k"]).mapInArrow(multiply, TILE)


def reduced(tiles: DataFrame, best) -> DataFrame:
    """Adds the partial tiles of each pair of blocks and hands the sum to best(a, b, windows, scores), which gives rows of
    BEST; a and b are (rids, ids, labels)."""

    def add(table):
        import pyarrow as pa

        numbers = lambda name: next((np.frombuffer(x, "<i8") for x in table[name].to_pylist() if x is not None), np.zeros(0, "<i8"))
        a, b = ([numbers(f"{s}_{n}") for n in ("rids", "ids", "labels")] for s in "ab")
        scores = np.zeros(len(a[0]) * len(b[0]), np.int64)
        for part in table["tile"]:
            scores += np.frombuffer(part.as_buffer(), "<i8")
        rows = best(a, b, numbers("windows").reshape(-1, 4), scores.reshape(len(a[0]), len(b[0])))
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in rows], names=[x.split()[0] for x in BEST.split(", ")])

    return tiles.groupBy("ag", "ab", "j").applyInArrow(add, BEST)


def _ordered(scores: np.ndarray, valid: np.ndarray):
    """Columns of each row by falling score, valid ones first; equal scores keep their order. And how many are valid."""
    key = np.where(valid, ~scores, np.iinfo(np.int64).max)
    return np.argsort(key, axis=1, kind="stable"), valid.sum(axis=1)


def best_positives(count: int):
    def best(a, b, windows, scores):
        order, n = _ordered(scores, (a[2][:, None] == b[2][None, :]) & (a[0][:, None] != b[0][None, :]))
        take = np.minimum(n, count)
        row = np.repeat(np.arange(len(n)), take)
        col = order[row, np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)]
        zero = np.zeros(len(row), np.int64)
        return a[0][row], a[1][row], zero, zero, zero, b[0][col], b[1][col], scores[row, col]

    return best


def best_negatives(count: int, low: int, high: int):
    def best(a, b, windows, scores):
        order, n = _ordered(scores, a[2][:, None] != b[2][None, :])
        out = [[] for _ in range(8)]
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        sorted_row, falling = -1, None
        for row, p_rid, p_id, score in windows.tolist():
            if row != sorted_row:
                sorted_row, falling = row, ~scores[row, order[row, : n[row]]]  # rising
            top, bottom = high * score // 100, -(-low * score // 100)
            begin = int(np.searchsorted(falling, ~np.int64(min(max(top, least), most)), side="left"))
            end = int(np.searchsorted(falling, ~np.int64(min(max(bottom, least), most)), side="right"))
            cols = order[row, begin : min(end, begin + count)]
            if end > begin:
                many = len(cols)
                for part, x in zip(out, ([a[0][row]] * many, [a[1][row]] * many, [p_rid] * many, [p_id] * many, [score] * many, b[0][cols], b[1][cols], scores[row, cols])):
                    part.extend(x)
        return out

    return best


def first_by_score(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Numbers the first `count` rows of each key: highest score first, then least id. A task gets at most as many of a
    key from each tile, and drops its own surplus before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "rid"))
    return rows.withColumn("rank", nth).where(F.col("rank") <= count)


def mine(
    rows: DataFrame, vec_id: str, vector: str, label: Column, anchor: Column,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shape: Shape = Shape(),
) -> DataFrame:
    """For each anchor and each of its best rows of the same label (its positives), the best rows of other labels whose
    score is low to high percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. A score is the inner product of whole numbers floor(256 * x); ties go to the smaller id.

    Rows without id, label or vector, or with a null or non-finite component, take no part. A repeated row is a row of
    its own: it may be its copy's positive, and an anchor that stands twice is answered twice. Of vectors of different lengths
    the shorter counts as filled up with zeros; an empty one scores 0. Anchors without positives, and windows without
    rows, give none; a positive with a score below 0 has an empty window. Empty tables give none.
    """
    staged = Scratch()
    base = staged(quantised(rows, vec_id, vector, label, anchor), "negatives")
    dims = base.agg(F.max(F.size("q"))).first()[0] or 0
    placed, groups, total = blocks(base, shape.candidates, "nth_row", "candidates", staged)
    right = staged(panels(placed.select(F.col("block").alias("j"), "rid", "id", "code", "q"), ["j"], shape.chunk, dims), "candidate-panels")
    asking = with_rank(placed.where("anchor").select("rid", "id", "code", "q", "g"), ["g"], "nth_anchor", "anchors")
    asking = staged(asking.withColumn("ab", F.floor(F.col("nth_anchor") / shape.anchors)).select(F.col("g").alias("ag"), "ab", "rid", "id", "code", "q"), "anchors-dealt")

    def meet(a: DataFrame, j: Column) -> DataFrame:
        return panels(a, ["ag", "ab"], shape.chunk, dims).join(groups, F.col("ag") == F.col("g")).withColumn("j", F.explode(j))

    own = F.sequence("first", "last")
    found = reduced(partial_tiles(meet(asking, own), right, shape.chunk), best_positives(positives))
    chosen = staged(first_by_score(found, ["a_rid"], positives), "positives")
    windows = chosen.groupBy(F.col("a_rid").alias("rid")).agg(F.collect_list(F.struct(F.col("rid").alias("p_rid"), F.col("id").alias("positive_id"), "score")).alias("windows"))
    # blocks of the anchors' own label hold nothing that they ask for, but for the block of rare labels
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(0, total - 1)).cast("long")), lambda j: (F.col("ag") == "rest") | (j < F.col("first")) | (j > F.col("last")))
    found = reduced(partial_tiles(meet(asking.join(windows, "rid"), others), right, shape.chunk), best_negatives(negatives, low, high))
    found = first_by_score(found, ["a_rid", "p_rid"], negatives)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS id, a.label = b.label AS same,
    coalesce(CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) AS INT) AS rank, n.id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) <= 10
"""
