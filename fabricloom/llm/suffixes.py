"""Repeated byte strings by suffix arrays, built shard by shard with induced sorting (Nong, Zhang and Chan, 2009).

Windows of 400 bytes are grouped by their minimizers, so equal windows meet in one shard whatever their documents.
Of each content of a super k-mer one copy goes to its minimizer's shard, and two if it stands in several places; the
shard's suffix array and permuted common prefixes tell which windows repeat, and so what goes wherever it stands.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix, runs
from .common import Staged, slices
from .repeats import keyed, merged, repeated, spans_by_row

BYTES, GRAIN = 400, 64
#: Bytes of a shard; a minimizer with more is split by the minimizers of further hashes.
SHARD = 1_500_000
#: Ends each string of a shard; no UTF-8 text has this byte.
SEPARATOR = 255
SPANS = "array<struct<start: bigint, end: bigint>>"


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S-type); the last is not."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    return step[decides] > 0


def _deal(lists: list[list], symbols: np.ndarray, places: np.ndarray) -> None:
    """Appends places to the lists of their symbols, keeping order."""
    order = np.argsort(symbols, kind="stable")
    symbols, places = symbols[order], places[order]
    cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), len(symbols)]
    for begin, end, c in zip(cuts, cuts[1:], symbols[cuts[:-1]].tolist()):
        lists[c].append(places[begin:end])


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes in the order that the given order of leftmost-smaller suffixes induces.

    Bucket by bucket: larger-type suffixes from the smaller end, then smaller-type ones from the larger end.
    """
    none = np.zeros(0, np.int64)
    seeds: list[list] = [[] for _ in range(alphabet)]
    if len(lms):
        _deal(seeds, t[lms], lms)
    before = _before(t, ~small, alphabet)
    larger: list[list] = [[] for _ in range(alphabet)]
    larger[int(t[-1])].append(np.array([len(t) - 1]))
    for c in range(alphabet):
        _step_bucket(before, larger, c)
        if seeds[c]:
            _step(before, larger, np.concatenate(seeds[c]))
    before = _before(t, small, alphabet)
    smaller: list[list] = [[] for _ in range(alphabet)]
    out: list[np.ndarray] = []
    for c in range(alphabet - 1, -1, -1):
        _step_bucket(before, smaller, c)
        down = np.concatenate(larger[c])[::-1] if larger[c] else none
        _step(before, smaller, down)
        out += [*smaller[c], down]
    return np.concatenate(out)[::-1]


def _before(t: np.ndarray, wanted: np.ndarray, alphabet: int) -> np.ndarray:
    """At each place the symbol before it, where that is wanted, else -1."""
    out = np.full(len(t), -1, np.int16 if alphabet <= 256 else np.int64)
    np.copyto(out[1:], t[:-1], where=wanted[:-1], casting="unsafe")
    return out


def _step(before: np.ndarray, lists: list[list], places: np.ndarray) -> None:
    symbols = before[places]
    some = np.flatnonzero(symbols >= 0)
    if len(some):
        _deal(lists, symbols[some], places[some] - 1)


def _step_bucket(before: np.ndarray, lists: list[list], c: int) -> None:
    """Steps from all that a bucket holds at once, then from what runs of its symbol add to it meanwhile."""
    done = 0
    while done < len(lists[c]):
        some, done = lists[c][done:], len(lists[c])
        _step(before, lists, np.concatenate(some))


#: A run of larger-type or smaller-type suffixes beyond this is induced bucket by bucket.
LONG_RUN = 256


def ranked(spelled: np.ndarray, begins: np.ndarray, stops: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranks of stretches of a spelled string, both ends included, by their symbols and then by last (none below 0);
    equal ones get equal ranks, from 0 without gaps.

    As many symbols as fit into 63 bits, if four do beside a place, are compared at once, from the last block of a
    stretch to its first.
    """
    if not len(begins):
        return last
    bits, wide = max(1, int(spelled.max()).bit_length()), len(begins).bit_length()
    per = (63 - wide) // bits
    if per < 4:  # too few to leave room for places beside them
        per = 63 // bits
    packed, have = spelled, 1
    while have < per:  # what is packed already, twice or as often as there is room for
        more = min(have, per - have)
        head = packed << (more * bits)
        head[:-have] |= packed[have:] >> ((have - more) * bits)
        packed, have = head, have + more
    length = stops - begins + 1
    blocks = -(-length // per)
    long = np.flatnonzero(blocks > 1)
    long = long[np.argsort(-blocks[long], kind="stable")]
    falling = -blocks[long]
    rank = last.astype(np.int64)
    for k in range(int(blocks.max()) - 1, -1, -1):
        some = long[: np.searchsorted(falling, -k, side="left")] if k else slice(None)
        over = np.maximum(per - (length[some] - k * per), 0) * bits
        key, after = (packed[begins[some] + k * per] >> over) << over, rank[some]
        order, new = _ordered(key)
        if after.any():
            again, new = _ordered((new << int(after.max()).bit_length()) | after[order])
            order = order[again]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = new + 1
        rank[some] = ranks
    return rank - 1


def _ordered(x: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of numbers (0 or more) in their order, and their ranks in that order, from 0 without gaps.

    stable: equal numbers stay in the order of their places. Where a number and its place fit into 63 bits, one sort
    of plain values finds both.
    """
    wide = len(x).bit_length()
    if int(x.max()).bit_length() + wide <= 63:
        both = np.sort((x << wide) | np.arange(len(x)))
        order, x = both & ((1 << wide) - 1), both >> wide
    else:
        order = np.argsort(x, kind="stable" if stable else None)
        x = x[order]
    rank = np.zeros(len(x), np.int64)
    np.cumsum(x[1:] != x[:-1], out=rank[1:])
    return order, rank


def induce_runs(spelled: np.ndarray, small: np.ndarray, lms: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the ranks of leftmost-smaller suffixes induce, for large alphabets.

    A larger-type suffix falls to a leftmost-smaller one, a smaller-type suffix rises to a larger-type one; its
    symbols until there and the rank found there place it.
    """
    large, rising = np.flatnonzero(~small), np.flatnonzero(small)
    falls = np.searchsorted(lms, large)
    down = ranked(spelled, large, np.append(lms, len(small))[falls], np.append(rank + 1, 0)[falls])
    rises = np.searchsorted(large, rising)
    up = ranked(spelled, rising, large[rises], down[rises] + 1)
    both = np.empty(len(small), np.int64)
    both[down], both[len(large) + up] = large, rising
    return both[_ordered(spelled[both], stable=True)[0]]


def _dense(t: np.ndarray) -> np.ndarray:
    """Symbols numbered from 0 without gaps, in their order; names are already."""
    if t.dtype != np.uint8:
        return t.astype(np.int64)
    return (np.cumsum(np.bincount(t, minlength=256) > 0) - 1)[t]


def suffix_array(t: np.ndarray, alphabet: int = 256) -> np.ndarray:
    """The suffix array of t: symbols below alphabet, a shorter suffix before a longer one it begins.

    Leftmost-smaller substrings are named in their order; if two are equal, the string of names is sorted by the
    same steps, whatever its alphabet. Bytes are induced bucket by bucket, and so is any string with a long run;
    other strings of names by runs, as most of their buckets hold a symbol or two.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    spelled = np.append(((_dense(t) + 1) << 1) | small, 0)  # of equal symbols the larger type goes first
    names = ranked(spelled, lms, np.append(lms[1:], n)[: len(lms)], np.zeros(len(lms), np.int64))
    count = int(names.max()) + 1 if len(lms) else 0
    rank = names
    if count < len(lms):
        rank = np.empty(len(lms), np.int64)
        rank[suffix_array(names, count)] = np.arange(len(lms))
    turns = np.flatnonzero(np.diff(small)) + 1
    if alphabet <= 256 or np.diff(turns, prepend=0, append=n).max() > LONG_RUN:
        order = np.empty(len(lms), np.int64)
        order[rank] = lms
        return induce(t, small, order, alphabet)
    return induce_runs(spelled, small, lms, rank)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: at each place, what its suffix shares with the one before it in order.

    Only places whose preceding symbols differ are compared; the others follow from the place before.
    """
    n = len(t)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    starts = before <= 0
    starts[0] = True
    # a place after one without a suffix before it has nothing to follow from
    starts[1:] |= (t[:-1] != t[before[1:] - 1]) | (before[:-1] < 0)
    at = np.flatnonzero(starts)
    length = np.zeros(len(at), np.int64)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    todo = np.flatnonzero(before[at] >= 0)
    x, y = at[todo], before[at[todo]]
    while len(todo):  # eight bytes at a time
        differ = words[x] ^ words[y]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        length[todo] += np.minimum(same, n - np.maximum(x, y))
        more = np.flatnonzero(differ == 0)
        todo, x, y = todo[more], x[more] + 8, y[more] + 8
        if len(todo) and max(int(x.max()), int(y.max())) >= n:
            inside = np.maximum(x, y) < n
            todo, x, y = todo[inside], x[inside], y[inside]
    return np.maximum(np.repeat(at + length, np.diff(at, append=n)) - np.arange(n), 0)


def repeated_windows(strings: list[bytes], size: int) -> list[np.ndarray]:
    """For each string, which of its windows also start anywhere else in the strings."""
    t = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in strings), np.uint8)
    order = suffix_array(t)
    shared = common_prefixes(t, order)
    again = shared >= size
    pairs = again[order[1:]]
    again[order[:-1][pairs]] = True
    out, begin = [], 0
    for s in strings:
        out.append(again[begin : begin + len(s) - size + 1])
        begin += len(s) + 1
    return out


def _stretches(flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where flags are set without a break: the number of their array, where they begin in it and where they end."""
    gap = np.zeros(1, bool)
    joined = np.concatenate([gap, *(x for f in flags for x in (f, gap))])
    edges = np.flatnonzero(joined[1:] != joined[:-1])
    begins = np.cumsum([0, *(len(f) + 1 for f in flags)])
    row = np.searchsorted(begins, edges[::2], side="right") - 1
    return row, edges[::2] - begins[row], edges[1::2] - begins[row]


PARTS = "key bigint, h bigint, c bigint, many boolean, first boolean, doc bigint, th bigint, base bigint, s bigint, size bigint, bytes binary"


def _rows(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.int64()] * 3 + [pa.bool_()] * 2 + [pa.int64()] * 5 + [pa.binary()]
    names = [x.split()[0] for x in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _fetch(size: int):
    """The bytes of each wanted super k-mer of a text; the key of its shard is its minimizer."""

    def fetch(batches):
        for batch in batches:
            for part in slices(batch, "text", 500_000):
                rows = []
                for text, doc, th, at in zip(*(part.column(n).to_pylist() for n in ("text", "doc", "th", "at"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    for x in at:
                        piece = raw[x["s"] : x["e"] + size]
                        rows.append((x["h"], x["h"], x["c"], x["many"], x["first"], doc, th, x["s"], x["s"], len(piece), piece))
                yield _rows(rows)

    return fetch


def _split(size: int, level: int):
    """Parts of a key with too many bytes, cut where the minimizers of another hash change."""

    def split(batches):
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(row[-1], np.uint8)
                for first, last, g in runs(raw, np.array([len(raw)]), size, GRAIN, True, level):
                    keys = (mix(g + np.uint64(row[0] % (1 << 64)))).astype(np.int64).tolist()
                    for a, b, key in zip(first.tolist(), last.tolist(), keys):
                        piece = row[-1][a : b + size]
                        rows.append((key, *row[1:8], row[8] + a, len(piece), piece))
                if len(rows) > 2_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return split


def _sort_shard(size: int):
    """Stretches of windows that repeat in a shard, of the first copy of each content."""

    def sort_shard(table):
        import pyarrow as pa

        found = repeated_windows(table.column("bytes").to_pylist(), size)
        first = table.column("first").to_pylist()
        row, a, b = _stretches([f for f, one in zip(found, first) if one])
        table = table.filter(table.column("first")).take(pa.array(row))
        s = table.column("s").to_numpy()
        table = table.select(["h", "c", "many", "doc", "th", "base"])
        return table.append_column("start", pa.array(s + a)).append_column("end", pa.array(s + b - 1 + size))

    return sort_shard


FOUND = "h bigint, c bigint, many boolean, doc bigint, th bigint, base bigint, start bigint, end bigint"


def _count_windows(parts: DataFrame, size: int) -> DataFrame:
    """The windows of parts that repeat under their key, by 64-bit hashes beside the key."""

    def spell(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                raw = memoryview(row[-1])
                w = np.array([digest(raw[p : p + size]) for p in range(len(raw) - size + 1)], np.uint64).astype(np.int64)
                one = [pa.array([x] * len(w), t) for x, t in zip(row[:8], [pa.int64()] * 3 + [pa.bool_()] * 2 + [pa.int64()] * 3)]
                yield pa.RecordBatch.from_arrays([*one, pa.array(row[8] + np.arange(len(w))), pa.array(w)], ["key", "h", "c", "many", "first", "doc", "th", "base", "p", "w"])

    windows = Staged(parts.mapInArrow(spell, "key bigint, h bigint, c bigint, many boolean, first boolean, doc bigint, th bigint, base bigint, p bigint, w bigint"), "hot-windows").df
    twice = Staged(windows.groupBy("key", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "w"), "hot-repeats").df
    again = windows.where("first").join(twice.hint("merge"), ["key", "w"], "left_semi")
    return again.select("h", "c", "many", "doc", "th", "base", F.col("p").alias("start"), (F.col("p") + size).alias("end"))


#: How often the parts of a key that is too large for a shard are split before their windows are counted by hash.
LEVELS = 4


def repeated_spans(rows: DataFrame, size: int = BYTES, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """Stretches (doc, th, start, end) of the bytes of keyed rows under windows that start in two places or more.

    Every content of a minimizer that stands in several places goes to a shard, twice if it stands in several places
    itself, and the shard's common prefixes decide on it; what they say of a content holds in all its places.
    """
    shared = repeated(rows, size, GRAIN, True, F.col("n") >= 2)
    place = F.struct("doc", "th", "s", "e")
    each = shared.df.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    both = F.when(F.col("n") > 1, F.array("a", "b")).otherwise(F.array("a"))
    each = each.select("h", "c", (F.col("n") > 1).alias("many"), F.posexplode(both).alias("k", "at"))
    at = F.struct("h", "c", "many", (F.col("k") == 0).alias("first"), "at.s", "at.e")
    listed = each.groupBy(F.col("at.doc").alias("doc"), F.col("at.th").alias("th")).agg(F.collect_list(at).alias("at"))
    wanted = rows.join(listed.hint("shuffle_hash"), ["doc", "th"]).select("text", "doc", "th", "at")
    rest = Staged(wanted.mapInArrow(_fetch(size), PARTS), "parts")
    ready, left = [], [rest]
    for level in range(levels + 1):
        loads = rest.df.groupBy("key").agg(F.sum(F.col("size") + 1).alias("load"))
        large = Staged(loads.where(F.col("load") > shard).select("key"), "large-keys")
        left.append(large)
        if not large.df.head(1):
            ready.append(rest.df)
            break
        ready.append(rest.df.join(large.df, "key", "left_anti"))
        over = rest.df.join(large.df, "key", "left_semi").select(rest.df.columns)
        if level < levels:
            rest = Staged(over.mapInArrow(_split(size, level + 1), PARTS), "split-parts")
            left.append(rest)
    usual = ready[0]
    for more in ready[1:]:
        usual = usual.unionByName(more)
    total = usual.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    usual = usual.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // shard)))))
    columns = ["shard", "h", "c", "many", "first", "doc", "th", "base", "s", "bytes"]
    found = usual.select(columns).groupBy("shard").applyInArrow(_sort_shard(size), FOUND)
    if large.df.head(1):
        found = found.unionByName(_count_windows(over, size))
    found = Staged(found, "sorted")
    for table in left:
        table.drop()
    once = found.df.where("not many").select("doc", "th", "start", "end")
    content = found.df.where("many").select("h", "c", (F.col("start") - F.col("base")).alias("a"), (F.col("end") - F.col("base")).alias("b"))
    every = shared.df.join(content.hint("merge"), ["h", "c"])
    return once.unionByName(every.select("doc", "th", (F.col("s") + F.col("a")).alias("start"), (F.col("s") + F.col("b")).alias("end")))


def _cut(keep_text: bool):
    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text, spans in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "spans"))):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    gone = merged([(s["start"], s["end"]) for s in spans or []])
                    edges = [0, *(x for span in gone for x in span), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    row = (doc, len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [dict(start=a, end=b) for a, b in gone])
                    rows.append((*row, left) if keep_text else row)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                types = [pa.int64()] * 4 + [pa.string(), span] + [pa.binary()] * keep_text
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return cut


def remove_repeats(docs: DataFrame, size: int = BYTES, shard: int = SHARD, keep_text: bool = True) -> DataFrame:
    """Documents (doc_id, text) without the bytes under a string of `size` bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes) and kept (binary: a cut may
    split a character). Strings are judged on the input, within documents; a null text is empty; of repeated
    rows with size bytes or more none keeps anything. An empty table gives an empty one. Which places hold the
    same content is told by 128 bits of hashes, and what of a content repeats byte by byte in the shards.
    """
    rows = keyed(docs)
    spans = spans_by_row(repeated_spans(rows, size, shard))
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {SPANS}" + (", kept binary" if keep_text else "")
    joined = rows.join(spans.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(keep_text), schema)


def op8_induced_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).drop("spans")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT *, length(x) // 2 AS n FROM d),
win AS (SELECT rid, i, hash(substr(x, 2 * i + 1, 800)) AS s FROM n, unnest(range(0, n - 399)) AS u(i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
isle AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k
         FROM (SELECT rid, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 400, true) AS INT) AS new FROM rep)),
gone AS (SELECT rid, k, min(i) AS a, max(i) + 400 AS b FROM isle GROUP BY rid, k),
edge AS (SELECT rid, b AS a, lead(a) OVER (PARTITION BY rid ORDER BY a) AS b FROM gone
         UNION ALL SELECT rid, 0, min(a) FROM gone GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS x FROM edge JOIN n USING (rid) GROUP BY rid),
g AS (SELECT rid, sum(b - a) AS removed, count(*) AS spans FROM gone GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.x, n.x))) AS kept_sha256
FROM n LEFT JOIN g USING (rid) LEFT JOIN kept USING (rid)
"""
