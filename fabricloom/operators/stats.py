"""Statistics over metric tables: distances between distributions, ranks, neighbours, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def quantiles(rows: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """Quantiles of each group, between neighbours where they fall between: groups, q (its place in the list), x.

    Values are counted, cumulated in ranges and looked up by rank, so a group may hold most rows and no task sees
    all its values. Null values don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    below = cumulated(counts, value, "_n", "_below", groups=groups, keep_part=True)
    ends = below.groupBy(*groups, "_part").agg(F.min("_below").alias("_first"), F.max(F.col("_below") + F.col("_n")).alias("_last"))
    total = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    q = F.posexplode(F.array(*[F.lit(float(x)) for x in at])).alias("q", "_q")
    want = total.select(*groups, "_total", q).withColumn("_at", F.col("_q") * (F.col("_total") - 1))
    low = F.floor("_at")
    sides = F.array(F.struct(low.alias("k"), (1 - (F.col("_at") - low)).alias("w")), F.struct(F.least(low + 1, F.col("_total") - 1).alias("k"), (F.col("_at") - low).alias("w")))
    want = want.select(*groups, "q", F.explode(sides).alias("s")).select(*groups, "q", F.col("s.k").alias("_k"), F.col("s.w").alias("_w"))
    placed = want.join(ends, groups).where("_k >= _first and _k < _last").select(*groups, "_part", "q", "_k", "_w")
    found = below.join(placed, [*groups, "_part"]).where("_k >= _below and _k < _below + _n")
    return found.groupBy(*groups, "q").agg(F.sum(F.col(value) * F.col("_w")).alias("x"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    return quantiles(rows, [group], value, [0.5]).select(group, F.col("x").alias(value))


def w1(made: DataFrame, real: DataFrame, key: str, value: str, n: int = 200) -> DataFrame:
    """Mean distance of n quantiles from 1 to 99 percent of two tables, by key: key, distance."""
    at = [0.01 + i * (0.98 / (n - 1)) for i in range(n)]
    both = made.select(key, value, F.lit(0).alias("_side")).unionByName(real.select(key, value, F.lit(1).alias("_side")))
    t = quantiles(both, [key, "_side"], value, at).groupBy(key, "q").agg(F.max(F.when(F.col("_side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("_side") == 1, F.col("x"))).alias("b"))
    return t.where("a is not null and b is not null").groupBy(key).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("distance"))


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where there is none). Rows with a null or
    infinite value are dropped first."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    facts = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = rows.join(F.broadcast(facts), F.lit(True))  # one row
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-9, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    return joined.withColumns(z).select(*rows.columns)


def percentile_rank(options: DataFrame, corpus: DataFrame, key: str, value: str) -> DataFrame:
    """100 times the share of corpus values below an option's, to one decimal.

    Values are ranked once over both tables: distinct values with their counts are cumulated in ranges, so no
    task sees the whole corpus, and each option finds its value by an equi-join.
    """
    counts = corpus.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    both = counts.unionByName(options.select(value, F.lit(0).cast("long").alias("_n"))).groupBy(value).agg(F.sum("_n").alias("_n"))
    below = cumulated(both, value, "_n", "_below")
    total = corpus.agg(F.count(F.lit(1)).alias("_total"))
    ranked = options.join(below.select(value, "_below"), value, "left").join(F.broadcast(total), F.lit(True))
    return ranked.select(key, value, F.round(100.0 * F.col("_below") / F.col("_total"), 1).alias("percentile"))


#: Rows of one range of a cumulated table, about.
RANGE = 250_000


def cumulated(rows: DataFrame, order: str, n: str, name: str, groups: list[str] | None = None, keep_part: bool = False) -> DataFrame:
    """Adds the sum of n over rows of the same group with a smaller order value: sums of ranges first, then within each
    range. There are as many ranges as RANGE asks for; their edges are approximate quantiles, and any edges give the
    same sums. The rows are written once, as they are read for the edges, the sums and the result.
    """
    groups = groups or []
    rows = written(rows, "cumulated")
    ranges = max(1, -(-rows.count() // RANGE))
    edges = sorted(set(rows.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    part = F.lit(0)
    if edges:  # a search in the sorted edges: as many steps as the logarithm of their number
        array = F.array(*map(F.lit, edges))
        bits = range(len(edges).bit_length() - 1, -1, -1)
        for b in bits:
            step = part + (1 << b)
            part = F.when((step <= len(edges)) & (F.get(array, F.least(step, F.lit(len(edges))) - 1) < F.col(order)), step).otherwise(part)
    dealt = rows.withColumn("_part", part)
    sums = dealt.groupBy(*groups, "_part").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a group and range
    sums = sums.select(*groups, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum(n).over(within), F.lit(0)))
    out = dealt.join(sums, [*groups, "_part"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_in", "_base")
    return out if keep_part else out.drop("_part")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, key: str, vector: str, block: int = 64) -> DataFrame:
    """The k nearest corpus rows of each query by Euclidean distance, ties by key: rank, distance.

    Queries come in blocks, each sent to every part of the corpus once. A part keeps its own k best of each query before
    anything is shuffled: products of some queries and rows at a time say which rows may be among them, and those get
    their exact distance, so copies of a vector are told apart by key alone, and memory doesn't grow with either table.
    """
    import numpy as np
    import pyarrow as pa

    q = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v"))
    passes = max(1, -(-q.count() // (block * 64)))
    blocks = q.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(passes)))
    out = None
    spark = queries.sparkSession
    for b in range(passes):
        some = blocks.where(F.col("_b") == b).select("q", "v").toPandas()
        if not len(some):
            continue
        shared = spark.sparkContext.broadcast((some["q"].to_numpy(), np.array(some["v"].tolist(), np.float64)))

        def best(batches, shared=shared):
            ids, x = shared.value
            n, xx = len(ids), (x * x).sum(1)
            have_d, have_i = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    y = np.array(piece.column("v").to_pylist(), np.float64)
                    i, yy = piece.column("i").to_numpy(), (y * y).sum(1)
                    for s in range(0, n, block * 4):
                        own = slice(s, s + block * 4)
                        d = xx[own, None] + yy - 2 * x[own] @ y.T
                        slack = 1e-9 * (1 + xx[own] + yy.max())  # far more than products round off
                        bound = have_d[own, -1] ** 2
                        if d.shape[1] >= k:
                            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
                        a, c = np.nonzero(~(d > (bound + slack)[:, None]))
                        if not len(a):
                            continue
                        exact = np.concatenate([np.sqrt(np.cumsum((x[own][a[f : f + 8192]] - y[c[f : f + 8192]]) ** 2, axis=1)[:, -1]) for f in range(0, len(a), 8192)])
                        touched = np.unique(a)
                        a, e, g = (np.concatenate(z) for z in ((a, np.repeat(touched, k)), (exact, have_d[own][touched].ravel()), (i[c], have_i[own][touched].ravel())))
                        order = np.lexsort((g, e, a))
                        a, e, g = a[order], e[order], g[order]
                        place = np.arange(len(a)) - np.searchsorted(a, a)
                        top = place < k
                        have_d[s + a[top], place[top]], have_i[s + a[top], place[top]] = e[top], g[top]
            found = have_i < np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], found.shape)[found]), pa.array(have_i[found]), pa.array(have_d[found])], ["q", "i", "distance"])

        part = corpus.select(F.col(key).alias("i"), F.col(vector).alias("v")).mapInArrow(best, "q bigint, i bigint, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{query_key} bigint, {key} bigint, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "i"))
    left = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return left.select(F.col("q").alias(query_key), F.col("i").alias(key), F.round("distance", 6).alias("distance"), "rank")


def walk(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How a value moves along an ordered walk: its total change, and the share of steps in that direction. A total that is 0
    to nine places is no change: steps that cancel out leave a rest of their binary sum, which has no direction."""
    step = F.lead(value).over(Window.partitionBy(key).orderBy(order)) - F.col(value)
    steps = rows.withColumn("_d", step).where(F.col("_d").isNotNull() & F.col(key).isNotNull())
    t = steps.groupBy(key).agg(F.sum("_d").alias("change"), F.count(F.lit(1)).alias("_n"), *[F.count_if(F.signum("_d") == sign).alias(n) for n, sign in (("_up", 1), ("_down", -1))])
    same = F.when(F.round("change", 9) == 0, 0).when(F.col("change") > 0, F.col("_up")).otherwise(F.col("_down"))
    return t.select(key, "change", F.round(same / F.col("_n"), 6).alias("monotone"))


def nearest_rank_quantile(value: str, q: float) -> Column:
    """The value at place q * (n - 1), half to even, of an aggregated column of bounded groups (repeats of a run)."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.rint(q * (F.size(ordered) - 1)).cast("int"))


def smoothed(rows: DataFrame, key: str, order: str, value: str, keep: float) -> DataFrame:
    """The exponentially smoothed last value of each key's series. The smoothing is a weighted sum by the place from the
    end, the first value weighing what is left; so a series is never gathered."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    v = F.col(value).cast("double")
    t = rows.select(key, order, v.alias("_v"), back.alias("_k"))
    first = F.min_by("_v", order) * F.pow(F.lit(keep), F.max("_k") + 1)
    return t.groupBy(key).agg((F.sum((1 - keep) * F.pow(F.lit(keep), F.col("_k")) * F.col("_v")) + first).alias("smoothed"))
