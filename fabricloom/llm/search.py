"""Ranked lexical search over a tiered index.

The postings of a term stand in three tiers by falling impact (what one posting adds for a term of weight 1); for each
term and tier the index knows the residual bound, the highest impact that lower tiers still hold. A search reads the
first tier. An item is done when no document that it hasn't seen can reach the score of its tenth: when the sum of its terms'
weighted residual bounds is below it. Items without that proof fall through to the next tier, where only terms matter
whose bounds together could still lift an unseen document that high. The last tier leaves nothing unseen, so every item ends exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import mix, rolled, texts_of
from .common import Scratch, short_batches, slices

#: Postings at most of a term in the first tier, and in the first two together.
TIERS = (512, 16_384)
#: Impacts are counted in steps of this size to find where a tier ends. All impacts are below 1,000,000.
STEP = 8_192
#: Terms at most that are shipped to tasks: so few that each takes part in a search. With more of them the index holds all
#: terms and joins stay shuffles.
SHIPPED = 200_000
#: Candidates of an item whose scores are worked out first, to find a tenth score to compare bounds with.
FIRST = 100

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True  # fixed value: digits, letters, all beyond ASCII
FORWARD = "rid bigint, key bigint, n bigint, terms array<bigint>, tfs array<bigint>"


def terms_of(data: np.ndarray, ends: np.ndarray):
    """64-bit hashes of the terms of consecutive texts, only A-Z lower-cased, and the text that each is in."""
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = np.concatenate([_TERM[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = edge[0] = True
    before = np.concatenate([[False], solid[:-1]])
    begins = np.flatnonzero(solid & (~before | edge))
    stops = np.flatnonzero(before & (~solid | edge))
    return mix(rolled(lower, begins, stops)).astype(np.int64), np.searchsorted(ends, begins, side="right")


def forward(texts: DataFrame, key: str, text: str, only: np.ndarray | None = None) -> DataFrame:
    """Each text's number of terms with repeats (n), and its terms with their counts; of the sorted hashes `only`, if
    given. rid numbers the rows; a null text has no terms."""
    short_batches(texts.sparkSession)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                data, ends = texts_of(part.column(2))
                found, whose = terms_of(data, ends) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                n = np.bincount(whose, minlength=len(ends))
                if only is not None and len(found):
                    at = np.minimum(np.searchsorted(only, found), max(0, len(only) - 1))
                    known = only[at] == found if len(only) else np.zeros(len(found), bool)
                    found, whose = found[known], whose[known]
                order = np.lexsort([found, whose])
                found, whose = found[order], whose[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
                first = np.flatnonzero(new)
                tfs = np.diff(np.append(first, len(found)))
                offsets = pa.array(np.searchsorted(whose[first], np.arange(len(ends) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (found[first], tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), *lists], ["rid", "key", "n", "terms", "tfs"])

    rows = texts.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, FORWARD)


def postings(forward: DataFrame) -> DataFrame:
    """A row a document and term: rid, term, impact, step."""
    rows = forward.select("rid", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("impacts").alias("impact"))))
    return rows.select("rid", "term", "impact", F.expr(f"impact div {STEP}").alias("step"))


@dataclass
class Index:
    """forward: rid, key, terms, impacts. terms: term, df, weight, and for tiers 0 and 1 the residual bounds r0, r1.
    postings: rid, term, impact, tier, on disk by tier. small: whether the terms are few enough to be shipped."""

    forward: DataFrame
    terms: DataFrame
    postings: DataFrame
    small: bool


def shipped(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def build(docs: DataFrame, key: str, text: str, staged: Scratch, only: np.ndarray | None = None) -> Index:
    """The tiered index of documents: of all terms, or of the sorted hashes `only`.

    A term of df of N documents weighs floor(1000 ln((2N + 2) / (2 df + 1))); a posting's impact is
    (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L. N counts documents with a term, L all their terms.
    """
    small = only is not None and len(only) <= SHIPPED
    plain = staged(forward(docs, key, text, only), "search-forward")
    count, total = plain.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"25 + (75L * n * {count}L) div {max(1, total)}L")
    impacts = F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * m))")
    ahead = plain.where("size(terms) > 0").withColumn("m", m).select("rid", "key", "terms", impacts.alias("impacts"))
    steps = staged(postings(ahead).groupBy("term", "step").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most")), "search-steps")
    down = Window.partitionBy("term").orderBy(F.desc("step"))  # at most 1,000,000 / STEP rows
    tiered = steps.withColumn("held", F.sum("n").over(down))
    tier = F.when(F.col("held") <= TIERS[0], 0).when(F.col("held") <= TIERS[1], 1).otherwise(2)
    tiered = tiered.withColumn("tier", tier)
    left = lambda k: F.coalesce(F.max(F.when(F.col("tier") > k, F.col("most"))), F.lit(0))
    least = lambda k: F.coalesce(F.min(F.when(F.col("tier") <= k, F.col("step"))), F.lit(1 << 40))
    weight = F.floor(1000 * F.log(F.lit(float(2 * count + 2)) / (2 * F.col("df") + 1))).cast("long")
    terms = tiered.groupBy("term").agg(F.sum("n").alias("df"), left(0).alias("r0"), left(1).alias("r1"), least(0).alias("s0"), least(1).alias("s1"))
    terms = staged(terms.withColumn("weight", weight), "search-terms")
    placed = postings(ahead).join(shipped(terms.select("term", "s0", "s1"), small), "term")
    placed = placed.withColumn("tier", F.when(F.col("step") >= F.col("s0"), 0).when(F.col("step") >= F.col("s1"), 1).otherwise(2))
    by_tier = staged(placed.select("rid", "term", "impact", "tier"), "search-postings", "tier")
    return Index(ahead, terms.drop("s0", "s1"), by_tier, small)


def _first(rows: DataFrame, count: int, by: Column, *ties: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("item").orderBy(by.desc(), *ties))
    return rows.withColumn("rank", nth).where(F.col("rank") <= count)


def exact(index: Index, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The whole scores of pairs of item and document: item, rid, key, score."""
    held = pairs.select("item", "rid").join(index.forward, "rid")
    rows = held.select("item", "rid", "key", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("impacts").alias("impact"))))
    scored = rows.join(asked.select("item", "term", "weight"), ["item", "term"]).groupBy("item", "rid").agg(F.first("key").alias("key"), F.sum(F.col("weight") * F.col("impact")).alias("score"))
    return scored


def search(index: Index, items: DataFrame, staged: Scratch, top: int = 10) -> DataFrame:
    """The `top` documents of each item: item, rank, key, score, tier. items: rows of forward(). Scores are over 0, equal
    ones by ascending key (null last); tier says where the item's result was proven."""
    rows = items.select(F.col("rid").alias("item"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("times"))))
    work = Scratch()  # goes when the last tier is done
    asked = rows.join(index.terms, "term").select("item", "term", (F.col("times") * F.col("weight")).alias("weight"), "r0", "r1")
    asked = work(asked.where("weight > 0"), "search-asked")
    open_items = work(asked.select("item").distinct().withColumn("least", F.lit(0).cast("long")), "search-open")
    done, last = [], len(TIERS)
    for k in range(last + 1):
        # terms whose weighted bounds sum to less than the tenth score can't lift an unseen document to it by themselves
        rising = Window.partitionBy("item").orderBy(F.col("weight") * F.col("r0"), "term").rowsBetween(Window.unboundedPreceding, 0)
        mine = asked.join(open_items, "item").withColumn("needed", F.sum(F.col("weight") * F.col("r0")).over(rising) >= F.col("least"))
        rest = F.lit(0) if k == last else F.col(f"r{k}")
        mine = work(mine.withColumn("bound", F.col("weight") * F.when(F.col("needed"), rest).otherwise(F.col("r0"))), f"search-asked-{k}")
        lists = index.postings.where(F.col("tier") <= k).join(mine.select("item", "term", "weight", "bound", "needed"), "term")
        seen = lists.where(F.col("needed") | (F.col("tier") == 0)).groupBy("item", "rid").agg(
            F.sum(F.col("weight") * F.col("impact")).alias("part"), F.sum("bound").alias("known")
        )
        seen = work(seen, f"search-seen-{k}")
        some = work(_first(seen, FIRST, F.col("part"), F.col("rid")).select("item", "rid"), f"search-some-{k}")
        tenth = _first(exact(index, asked, some), top, F.col("score")).where(F.col("rank") == top).select("item", "score")
        bounds = mine.groupBy("item").agg(F.sum("bound").alias("unseen"), F.first("least").alias("least")).join(tenth, "item", "left")
        bounds = work(bounds.select("item", "unseen", F.greatest("least", F.coalesce("score", F.lit(0))).alias("least")), f"search-bounds-{k}")
        proven = bounds if k == last else bounds.where("unseen < least")
        able = seen.join(proven, "item").where(F.col("part") + F.col("unseen") - F.col("known") >= F.greatest("least", F.lit(1)))
        able = work(able.select("item", "rid"), f"search-able-{k}")
        ranked = _first(exact(index, asked, able).where("score > 0"), top, F.col("score"), F.asc_nulls_last("key"), F.asc("rid"))
        done.append(staged(ranked.select("item", "rank", "key", "score", F.lit(k).alias("tier")), f"search-done-{k}"))
        if k < last:
            open_items = bounds.where("unseen >= least").select("item", "least")
            if open_items.isEmpty():
                break
    work.drop()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ranked_search(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, top: int = 10) -> DataFrame:
    """The `top` documents of each item, of all documents: item_id, rank, doc_id, score, tier.

    Null and empty texts have no terms; an item without terms, or whose terms no document has, gets no rows. A document or an
    item that stands twice counts twice. Ids are whole numbers; equal scores go by ascending doc_id, null last. Terms are told apart by 64-bit
    hashes.
    """
    staged, tables = Scratch(), Scratch()
    asked = staged(forward(items, item_id, item_text), "search-items")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    few = terms.limit(SHIPPED + 1).collect()
    only = np.sort(np.array([r[0] for r in few], np.int64)) if len(few) <= SHIPPED else None
    found = search(build(docs, doc_id, text, tables, only), asked, staged, top)
    tables.drop()
    return found.join(asked.select(F.col("rid").alias("item"), F.col("key").alias("item_id")), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score", "tier"
    )


def op13_tiered_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked_search(docs, "doc_id", "text", items, "item_id", "text").drop("tier")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS total FROM d WHERE len(ws) > 0),
q AS (SELECT item, item_id, term, count(*) AS times FROM b GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
i AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS score FROM p JOIN w USING (term), s),
r AS (SELECT item, item_id, rid, doc_id, CAST(sum(times * score) AS BIGINT) AS score FROM i JOIN q USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, rid) AS INT) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, rid) <= 10
"""
