"""Exact Jaccard self-join of word shingles by partition of the universe (Deng, Li, Wen and Feng, 2016).

Two sets of sizes x and y reach the threshold only if they differ in at most d = floor((x + y) / 7) elements (for
0.75). Elements are hashed into segments, the same for all sets of a size band; sets that differ in d elements
agree on all but d segments. So a set's segment contents are its signatures, and a set of which more than d
signatures stand in no other set has no partner. Bands of tiny sets take few segments whose one-deletion
neighbourhoods are signatures too. What is left is verified exactly and joined to components.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import A, B, U, mix, texts_of, word_symbols
from .common import Scratch, Staged, slices, staged
from .repeats import NULL_DOC, keyed

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Sets up to this size have a scheme for each size of the larger set.
TINY = 12
#: How many standard deviations of the count of filled segments a band's segments must leave.
MARGIN = 7
#: An entity number that stands for no entity: its set is known to share the signature.
KNOWN = 0xFFFF
#: Rows of one slice, so that its entities fit in 16 bits.
ROWS = 10_000
META = "doc bigint, th bigint, x int, s1 bigint, s2 bigint"


def difference(x: int, y: int) -> int:
    """The most elements by which sets of sizes x and y that are linked differ."""
    return (x + y) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def largest_partner(x: int) -> int:
    return x * DENOMINATOR // NUMERATOR


@lru_cache(None)
def bands() -> list[tuple[int, int]]:
    """Sizes of the larger set, from and to, by scheme: one each up to TINY, then growing by 16/9."""
    out = [(x, x) for x in range(1, TINY + 1)]
    low = TINY + 1
    while low < 1 << 40:
        high = low * 16 // 9
        out.append((low, high))
        low = high + 1
    return out


@lru_cache(None)
def schemes(x: int) -> list[int]:
    """Schemes in which a set of size x may be the larger or the smaller of a pair."""
    return [s for s, (low, high) in enumerate(bands()) if high >= x and low <= largest_partner(x)]


@lru_cache(None)
def allowed(scheme: int, x: int) -> int:
    """The most elements by which a set of size x differs from a partner in a scheme."""
    return difference(x, min(largest_partner(x), bands()[scheme][1]))


@lru_cache(None)
def segments(scheme: int, attempt: int = 0) -> int:
    """The fewest segments (so the fewest signatures) that leave every set of a band more filled segments than
    differences, but for a chance of about MARGIN standard deviations; 0: every element is a segment."""
    low, high = bands()[scheme]
    sizes = {max(1, -(-low * NUMERATOR // DENOMINATOR)), low, (low + high) // 2, high * NUMERATOR // DENOMINATOR, high}

    def enough(m: int) -> bool:
        for x in sizes:
            miss = (1 - 1 / m) ** x
            both = (1 - 2 / m) ** x if m > 2 else 0.0
            mean, variance = m * (1 - miss), m * miss + m * (m - 1) * both - (m * miss) ** 2
            if mean - MARGIN * math.sqrt(max(variance, 0)) <= allowed(scheme, x) + 1:
                return False
        return True

    if attempt > 2:
        return 0
    m = max(2, high // 3)
    while not enough(m):
        m = m * 5 // 4 + 1
        if m > 8 * high:
            return 0
    return m


def tiny_signatures(scheme: int, elements: list[int]) -> list[int]:
    """Signatures of a set in a scheme of one larger size: enough segments for its differences, where exact
    segments cover one and segments with one-deletion neighbourhoods two; the cheaper exact ones go last."""
    d = allowed(scheme, bands()[scheme][0])
    deleting, exact = divmod(d + 1, 2)
    parts: list[list[int]] = [[] for _ in range(deleting + exact)]
    for e in elements:
        parts[(e >> 17) % len(parts)].append(e)
    out = set()
    for i, part in enumerate(parts):
        total = sum(part)
        for content in [total, *([total - e for e in part] if i < deleting else [])]:
            out.add((content * int(B) + i * 0x51ED27 + scheme * 0x2545F491) % (1 << 64))
    return sorted(out)


def signatures(elements: np.ndarray, owner: np.ndarray, sizes: np.ndarray, attempt: int):
    """Signatures of sets (elements with the row of their owner, in order of it): entity of each, and the
    signature; then for each entity its row, scheme, and how many signatures must be shared to have a partner."""
    sig, of, rows, kinds, need, hard, made = [], [], [], [], [], 0, 0
    begins = np.concatenate([[0], np.cumsum(sizes)])
    by_scheme: dict[int, list] = {}
    for x in np.unique(sizes).tolist():
        if x:
            for s in schemes(x):
                by_scheme.setdefault(s, []).append(np.flatnonzero(sizes == x))
    for s in sorted(by_scheme):
        row = np.sort(np.concatenate(by_scheme[s]))
        entity = np.full(len(sizes), -1)
        entity[row] = np.arange(len(row))
        if s < TINY:
            for e, r in enumerate(row.tolist()):
                found = tiny_signatures(s, elements[begins[r] : begins[r + 1]].tolist())
                sig.append(mix(np.array(found, np.uint64)))
                of.append(np.full(len(found), made + e))
            need.append(np.ones(len(row), np.int64))
        else:
            mine = entity[owner]
            some, mine = elements[mine >= 0], mine[mine >= 0]
            m = segments(s, attempt)
            if m:
                cell = mine * m + (mix(some + U(attempt + 1) * A) % U(m)).astype(np.int64)
                content = np.zeros(len(row) * m, np.uint64)
                np.add.at(content, cell, mix(some ^ B))
                full = np.flatnonzero(content)
                sig.append(mix(content[full] * A + (full % m).astype(np.uint64) * B + U(s)))
                mine = full // m
            else:
                sig.append(mix(some * A + U(s)))
            of.append(mine + made)
            slack = np.array([allowed(s, x) for x in sizes[row].tolist()], np.int64)
            left = np.bincount(mine, minlength=len(row)) - slack
            hard += int((left <= 0).sum())
            need.append(left)
        rows.append(row)
        kinds.append(np.full(len(row), s))
        made += len(row)
    if not made:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z, 0
    return *(np.concatenate(a) for a in (of, sig, rows, kinds, need)), hard


def shingle_sets(column):
    """Distinct shingles of each text of a string column: elements sorted in each row, their rows, and sizes."""
    data, ends = texts_of(column)
    upper = (data >= 65) & (data <= 90)
    words, _, _, ends = word_symbols(np.where(upper, data + 32, data).astype(np.uint8), ends)
    counts = np.diff(ends, prepend=0)
    n = len(words)
    if n >= SHINGLE:
        h = words[: n - SHINGLE + 1]
        for k in range(1, SHINGLE):
            h = mix(h * A + words[k : n - SHINGLE + 1 + k])
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[: n - SHINGLE + 1] == row[SHINGLE - 1 :]
        h, row = h[whole], row[: n - SHINGLE + 1][whole]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        starts = ends - counts
        one = np.zeros(len(short), np.uint64)
        for j, r in enumerate(short.tolist()):
            for w in words[starts[r] : ends[r]].tolist():
                one[j] = mix(one[j : j + 1] * A + U(w))[0]
        h, row = np.concatenate([h, one]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, row, np.bincount(row, minlength=len(counts))


def _sums(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, 128 bits in all."""
    out = []
    for salt in (A, B):
        total = np.concatenate([[U(0)], np.cumsum(mix(elements * salt + U(1)))])
        ends = np.cumsum(sizes)
        out.append((total[ends] - total[ends - sizes]).astype(np.int64))
    return out[0], out[1]


def _batch(columns: dict, schema: list[tuple]):
    import pyarrow as pa

    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in schema], [k for k, _ in schema])


#: Rows of three kinds: documents (x is set), a slice's entities, and packed signatures or counts of a bucket.
POSTED = META + ", bucket int, batch bigint, kind int, hard boolean, body binary"
DOCUMENT, ENTITIES, SIGNATURES, COUNTS = 0, 1, 2, 3


def _fields():
    import pyarrow as pa

    i64, i32 = pa.int64(), pa.int32()
    return [("doc", i64), ("th", i64), ("x", i32), ("s1", i64), ("s2", i64), ("bucket", i32), ("batch", i64), ("kind", i32), ("hard", pa.bool_()), ("body", pa.binary())]


def _packed(rest: np.ndarray, of: np.ndarray) -> bytes:
    """Sorted 24-bit numbers with their entities: the high 8 bits as they are, or counted where there are many."""
    n = len(rest)
    high = (rest >> 16).astype(np.uint8).tobytes() if n < 512 else np.bincount(rest >> 16, minlength=256).astype("<u2").tobytes()
    return n.to_bytes(4, "little") + high + (rest & 0xFFFF).astype("<u2").tobytes() + of.astype("<u2").tobytes()


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    if n < 512:
        high, at = np.frombuffer(body, np.uint8, n, 4).astype(np.int64), 4 + n
    else:
        high, at = np.repeat(np.arange(256), np.frombuffer(body, "<u2", 256, 4)), 516
    return high << 16 | np.frombuffer(body, "<u2", n, at).astype(np.int64), np.frombuffer(body, "<u2", n, at + 2 * n)


def _post(buckets: int, attempt: int):
    """Describes every document, and for each slice of rows its entities and their signatures packed by bucket.

    Of a signature that several entities of a slice have, one copy is sent and all of them count it as shared, so
    large groups of copies arrive as one row a slice. A packed signature takes 24 bits and 16 for its entity;
    what such short signatures mistake for shared is caught by verifying.
    """

    def post(batches):
        from pyspark import TaskContext

        schema, number = _fields(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text", 1_500_000):
                for begin in range(0, piece.num_rows, ROWS):
                    part = piece.slice(begin, ROWS)
                    number += 1
                    elements, row, sizes = shingle_sets(part.column("text"))
                    doc, th = part.column("doc").to_numpy(), part.column("th").to_numpy()
                    s1, s2 = _sums(elements, sizes)
                    yield _batch({"doc": doc, "th": th, "x": sizes.astype(np.int32), "s1": s1, "s2": s2, "bucket": np.arange(len(doc), dtype=np.int32) % buckets, "kind": np.full(len(doc), DOCUMENT, np.int32)}, schema)
                    of, sig, rows, kinds, need, hard = signatures(elements, row, sizes, attempt)
                    if not len(rows):
                        continue
                    order = np.argsort(sig)
                    sig, of = sig[order], of[order]
                    first = np.ones(len(sig), bool)
                    first[1:] = sig[1:] != sig[:-1]
                    group = np.cumsum(first) - 1
                    several = np.bincount(group) > 1
                    shared = np.bincount(of[several[group]], minlength=len(rows))
                    sig, of = sig[first], np.where(several, KNOWN, of[first])
                    facts = np.stack([doc[rows], th[rows], need - shared]).astype("<i8").tobytes()
                    yield _batch({"bucket": [number % buckets], "batch": [number], "kind": [ENTITIES], "hard": [bool(hard)], "body": [facts]}, schema)
                    bucket = ((sig >> U(40)) * U(buckets) >> U(24)).astype(np.int64)
                    rest = ((sig >> U(8)) & U(0xFFFFFF)).astype(np.int64)
                    order = np.argsort(bucket << 24 | rest)
                    bucket, rest, of = bucket[order], rest[order], of[order]
                    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                    bodies = [_packed(rest[a:b], of[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
                    used = np.flatnonzero(np.diff(cuts)).astype(np.int32)
                    yield _batch({"bucket": used, "batch": np.full(len(used), number), "kind": np.full(len(used), SIGNATURES, np.int32), "body": bodies}, schema)

    return post


def _match(batches):
    """Passes documents and entities on; of packed signatures it returns for each slice how many of each entity's
    signatures others have, one row a slice."""
    import pyarrow.compute as pc

    held: dict[int, list] = {}
    for batch in batches:
        packed = pc.equal(batch.column("kind"), SIGNATURES)
        plain = batch.filter(pc.invert(packed))
        if plain.num_rows:
            yield plain
        some = batch.filter(packed)
        for bucket, number, body in zip(*(some.column(n).to_pylist() for n in ("bucket", "batch", "body"))):
            held.setdefault(bucket, []).append((number, body))
    counts: dict[int, np.ndarray] = {}
    while held:
        _, found = held.popitem()
        pairs = [_unpacked(body) for _, body in found]
        sig, of = (np.concatenate(a) for a in zip(*pairs))
        number = np.repeat(np.array([n for n, _ in found]), [len(a) for a, _ in pairs])
        _, group, times = np.unique(sig, return_inverse=True, return_counts=True)
        hit = (times[group] > 1) & (of != KNOWN)
        key, n = np.unique(number[hit] << 16 | of[hit].astype(np.int64), return_counts=True)
        cuts = np.flatnonzero(np.diff(key >> 16)) + 1
        for some, c in zip(np.split(key, cuts), np.split(n, cuts)):
            if len(some):
                total = counts.setdefault(int(some[0] >> 16), np.zeros(0, np.int64))
                entity = some & 0xFFFF
                if entity[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(entity[-1] + 1 - len(total), np.int64)])
                total[entity] += c
                counts[int(some[0] >> 16)] = total
    if counts:
        bodies = [c.astype("<i4").tobytes() for c in counts.values()]
        yield _batch({"batch": list(counts), "kind": np.full(len(counts), COUNTS, np.int32), "body": bodies}, _fields())


def _alive(batches):
    """Sums the counts of each slice's entities and returns the documents with one that may have a partner."""
    import pyarrow as pa

    facts: dict[int, np.ndarray] = {}
    shared: dict[int, list] = {}
    for batch in batches:
        for number, kind, body in zip(*(batch.column(n).to_pylist() for n in ("batch", "kind", "body"))):
            if kind == ENTITIES:
                facts[number] = np.frombuffer(body, "<i8").reshape(3, -1)
            else:
                shared.setdefault(number, []).append(np.frombuffer(body, "<i4"))
    for number, (doc, th, need) in facts.items():
        left = need.copy()
        for c in shared.get(number, ()):
            left[: len(c)] -= c
        rows = left <= 0
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(th[rows])], ["doc", "th"])


def components(edges: DataFrame, nodes: tuple[str, str], put=staged) -> DataFrame:
    """The least node that each node of an edge list reaches: node, least, for nodes other than their least. Edges are staged after each round; a
    round is two joins on nodes with their least neighbour, and rounds grow as the logarithm of a component."""
    a, b = nodes
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = put(e, "links")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = put(large.where("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        after = put(small.distinct(), "small-star")
        if not after.exceptAll(e).head(1) and not e.exceptAll(after).head(1):
            break
        e = after
    return e.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "node")


def sketch(elements: np.ndarray) -> bytes:
    """The parity of how many elements fall into each of some bits, about two an element. Sets that differ in d
    elements have sketches that differ in at most d bits; halves of a sketch taken together give a smaller one."""
    bits = 1 << min(14, max(8, (2 * len(elements) - 1).bit_length()))
    hit = np.bincount((mix(elements ^ A) >> U(50)).astype(np.int64) % bits, minlength=bits)
    return np.packbits(hit & 1).tobytes()


def _folded(body: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(body, np.uint8).reshape(-1, size), axis=0)


def _sets(batches):
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch, "text", 1_000_000):
            elements, _, sizes = shingle_sets(part.column("text"))
            ends = np.cumsum(sizes)
            each = [elements[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
            columns = [part.column("doc"), part.column("th"), pa.array(sizes, pa.int32()), pa.array([e.tobytes() for e in each], pa.binary()), pa.array(map(sketch, each), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "th", "x", "body", "sketch"])


def _plausible(batches):
    """Pairs whose sketches don't rule a link out."""
    import pyarrow as pa

    for batch in batches:
        keep = []
        for a, b, x, y in zip(*(batch.column(n).to_pylist() for n in ("sketch_a", "sketch_b", "x_a", "x_b"))):
            size = min(len(a), len(b))
            differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
            keep.append(max(differ, abs(x - y)) <= difference(x, y))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sign(attempt: int):
    """Signatures of each set; meta holds the scheme and, in the low half, how many a partner must share."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                bodies = [np.frombuffer(b, np.uint64) for b in part.column("body").to_pylist()]
                sizes = np.array([len(b) for b in bodies])
                rid = part.column("rid").to_numpy()
                of, sig, rows, kinds, need, _ = signatures(np.concatenate(bodies), np.repeat(np.arange(len(sizes)), sizes), sizes, attempt)
                meta = kinds << 32 | np.maximum(need, 1)
                yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), pa.array(rid[rows[of]]), pa.array(meta[of])], ["sig", "rid", "meta"])

    return sign


#: Elements of all sets of one block, about.
BLOCK = 200_000


def _compare(table):
    """Links between the probing and the other sets of one pair of blocks, where their components differ."""
    import pyarrow as pa
    import pyarrow.compute as pc

    probes, others = table.filter(table.column("probe")), table.filter(pc.invert(table.column("probe")))
    a, b = [], []
    if probes.num_rows and others.num_rows:
        bodies = [np.frombuffer(x, np.uint64) for x in others.column("body").to_pylist()]
        sizes = np.array([len(x) for x in bodies])
        elements = np.concatenate(bodies)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(elements, kind="stable")
        ranked, owner = elements[order], owner[order]
        rid, part = others.column("rid").to_numpy(), others.column("part").to_numpy()
        for r, p, x in zip(*(probes.column(n).to_pylist() for n in ("rid", "part", "body"))):
            mine = np.frombuffer(x, np.uint64)
            low, high = np.searchsorted(ranked, mine), np.searchsorted(ranked, mine, side="right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sizes))
            linked = (DENOMINATOR * both >= NUMERATOR * (len(mine) + sizes - both)) & (part != p)
            b += rid[linked].tolist()
            a += [r] * int(linked.sum())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


#: Sets at most that are paired through one signature; more of them meet block by block.
MANY = 8


def _across(apart: DataFrame, sets: DataFrame, put=staged) -> DataFrame:
    """Links between sets of different parts that share signatures (sig, rid, meta, part).

    A set that must share k of its n signatures shares one of any n - k + 1; so each keeps its rarest, in one order
    for all, and sets with a link have one of those in common. Where few sets have a signature, they are paired;
    sketches of the pairs rule most out before whole sets are compared. Where many do, sets that reach each other by
    such signatures form a cluster, unless its sets meet at less cost signature by signature, as those of a long
    chain do. All but a cluster's largest part probe; each block of probing sets meets each block of the cluster's
    sets in a task that holds those two blocks and returns links only, so a large group gives no row for each of
    its pairs.
    """
    times = put(apart.groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sharers")
    own = Window.partitionBy("rid", "meta")
    t = apart.join(times.hint("merge"), "sig").withColumn("k", F.row_number().over(own.orderBy("n", "sig"))).withColumn("all", F.count(F.lit(1)).over(own))
    rare = put(t.where(F.col("k") <= F.col("all") - F.col("meta") % (1 << 32) + 1).select("sig", "rid", "part"), "rare")
    members = F.sum(F.xxhash64("rid").cast("decimal(38, 0)"))
    size = rare.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), members.alias("members"), (F.min("part") != F.max("part")).alias("open")).where("open")
    size = put(size.select("sig", "n", "members"), "open-signatures")
    rare = put(rare.join(size.hint("merge"), "sig"), "meetings")
    few = rare.where(F.col("n") <= MANY)
    left, right = (few.select("sig", F.col("rid").alias(r), F.col("part").alias(p)) for r, p in (("a", "part_a"), ("b", "part_b")))
    pairs = left.join(right, "sig").where("a < b and part_a != part_b").select("a", "b").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("rid").alias(c), F.col("x").alias(f"x_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
    pairs = put(pairs.mapInArrow(_plausible, "a bigint, b bigint"), "plausible")
    found = _met(pairs.select(F.col("b").alias("rid"), F.col("a").alias("cluster")).join(sets.select("rid", "x"), "rid"), sets)
    many = rare.where(F.col("n") > MANY)
    if not many.head(1):
        return found
    # signatures with the same members by count and sum of hashes stand for each other
    one = put(many.groupBy("n", "members").agg(F.min("sig").alias("sig")).select("sig"), "member-lists")
    many = many.join(one.hint("merge"), "sig", "left_semi").select("sig", "rid", "part")
    many = put(many.join(sets.select("rid", F.col("x").cast("long").alias("x")), "rid"), "members")
    nodes = put(_meetings(many, put), "nodes")
    whole = _loads(nodes, ["cluster"]).where("probing > 0")
    t = put(nodes.join(whole, "cluster"), "placed")
    block = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    all_ = t.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("probing") - 1))).select("cluster", "i", block.alias("j"), "rid", "part", F.lit(False).alias("probe"))
    some = t.where("part != main").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    some = some.select("cluster", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("probing")).alias("i"), "j", "rid", "part", F.lit(True).alias("probe"))
    return found.unionByName(_compared(all_.unionByName(some), sets))


def _loads(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """For each group of sets (rid, part, x): main (its largest part), how many blocks its sets and its probing sets fill,
    and cost, the elements that are sent so that each block of probing sets meets each block of all."""
    sizes = nodes.groupBy(*groups, "part").agg(F.sum("x").alias("x"))
    whole = sizes.groupBy(*groups).agg(F.max(F.struct("x", "part")).alias("most"), F.sum("x").alias("x"))
    rest = F.col("x") - F.col("most.x")
    blocks, probing = F.ceil(F.col("x") / BLOCK), F.ceil(rest / BLOCK)
    cost = F.when(rest > 0, F.col("x") * probing + rest * blocks).otherwise(F.lit(0).cast("long"))
    return whole.select(*groups, F.col("most.part").alias("main"), blocks.alias("blocks"), probing.alias("probing"), cost.alias("cost"))


def _meetings(many: DataFrame, put=staged) -> DataFrame:
    """Where sets (rid, part, x) of signatures meet: cluster, with the sets that reach each other by signatures in one, or
    with those of one signature where that costs less in all."""
    least = put(many.groupBy("sig").agg(F.min("rid").alias("first")), "firsts")
    edges = many.select("sig", "rid").join(least.hint("merge"), "sig").select("rid", "first").distinct()
    reached = put(components(edges, ("rid", "first"), put), "clusters").withColumnRenamed("node", "rid")
    own = many.join(reached, "rid", "left").withColumn("whole", F.coalesce("least", "rid")).drop("least")
    own = put(own, "reached")
    together = _loads(own.select("whole", "rid", "part", "x").distinct(), ["whole"]).select("whole", "cost")
    apart = _loads(own, ["whole", "sig"]).groupBy("whole").agg(F.sum("cost").alias("each"))
    split = put(together.join(apart, "whole").where("each < cost").select("whole", F.lit(True).alias("split")), "split-clusters")
    placed = own.join(split, "whole", "left")
    key = F.when(F.col("split"), F.xxhash64(F.lit(1), "sig")).otherwise(F.xxhash64(F.lit(0), "whole"))
    return placed.select(key.alias("cluster"), "rid", "part", "x").distinct()


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of sets (rid, x) to the set that each is to meet (cluster), block by block of those that meet it."""
    blocks = pairs.groupBy("cluster").agg(F.ceil(F.sum("x") / BLOCK).alias("blocks"))
    zero = F.lit(0).cast("long").alias("i")
    some = pairs.join(blocks, "cluster").select("cluster", zero, F.pmod(F.xxhash64("rid"), F.col("blocks")).alias("j"), "rid", F.col("rid").alias("part"), F.lit(False).alias("probe"))
    stars = blocks.select("cluster", zero, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    stars = stars.select("cluster", "i", "j", F.col("cluster").alias("rid"), F.col("cluster").alias("part"), F.lit(True).alias("probe"))
    return _compared(some.unionByName(stars), sets)


def _compared(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) found in each block (cluster, i, j) of placed sets (rid, part, probe)."""
    both = placed.join(sets.select("rid", "body"), "rid")
    return both.groupBy("cluster", "i", "j").applyInArrow(_compare, "a bigint, b bigint")


def _stars(shared: DataFrame, sets: DataFrame, put=staged) -> DataFrame:
    """Links of sets to the star that they share most signatures with.

    A signature's star is the member whose signatures are the most common, as the original of a group of copies
    is. A star meets its followers block by block.
    """
    fame = shared.groupBy("rid").agg(F.sum("times").alias("fame"))
    best = shared.select("sig", "rid").join(fame, "rid").groupBy("sig").agg(F.max(F.struct("fame", F.col("rid").alias("star"))).alias("best"))
    best = put(best.select("sig", "best.star"), "best")
    votes = shared.select("sig", "rid").join(best.hint("merge"), "sig").where("rid != star")
    star = votes.groupBy("rid", "star").agg(F.count(F.lit(1)).alias("n")).groupBy("rid").agg(F.max(F.struct("n", "star")).alias("b"))
    pairs = put(star.select("rid", F.col("b.star").alias("cluster")).join(sets.select("rid", "x"), "rid"), "stars")
    return _met(pairs, sets)


def _grouped(keyed_rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each keyed row with the size of its set (x), its group of linked sets, and the least doc of the group (component)."""
    spark = keyed_rows.sparkSession
    if buckets is None:
        buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    put = Scratch()
    attempt = 0
    while True:
        posted = keyed_rows.select("text", "doc", "th").mapInArrow(_post(buckets, attempt), POSTED)
        posted = Staged(posted.repartition("bucket").mapInArrow(_match, POSTED), "posted")
        found = posted.df
        # a set with no more filled segments than differences has no bound: deal all elements anew
        if not found.where("hard").head(1):
            break
        posted.drop()
        attempt += 1
    meta = found.where(f"kind = {DOCUMENT}").select("doc", "th", "x", "s1", "s2")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = found.where(f"kind in ({ENTITIES}, {COUNTS})").select("batch", "kind", "body")
    alive = put(counted.repartition(parts, "batch").mapInArrow(_alive, "doc bigint, th bigint").distinct(), "alive")
    sets_of = meta.where("x > 0").join(alive, ["doc", "th"], "left_semi")
    first = put(sets_of.groupBy("s1", "s2", "x").agg(F.min(F.struct("doc", "th")).alias("one")), "distinct-sets")
    wanted = first.select("one.doc", "one.th")
    texts = keyed_rows.select("text", "doc", "th").join(wanted.hint("shuffle_hash"), ["doc", "th"])
    sets = texts.select("text", "doc", "th").mapInArrow(_sets, "doc bigint, th bigint, x int, body binary, sketch binary")
    sets = put(sets.withColumn("rid", F.monotonically_increasing_id()), "sets")
    signed = put(sets.select("rid", "body").mapInArrow(_sign(attempt), "sig bigint, rid bigint, meta bigint"), "signed")
    # written before they are joined, so that Spark can split what is hot
    times = put(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times")
    signed = put(signed.join(times.hint("merge"), "sig"), "shared-signatures")
    links = put(_stars(signed, sets, put), "star-links")
    label = put(components(links, ("a", "b"), put), "star-components")
    # what is still apart: signatures whose members lie in several components
    parted = signed.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("sig", "rid", "meta", F.coalesce("least", "rid").alias("part"))
    parted = put(parted, "parts")
    open_ = parted.groupBy("sig").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("sig")
    open_ = put(open_, "open")
    apart = put(parted.join(open_.hint("merge"), "sig", "left_semi"), "apart")
    # a set that shares too few signatures with other components has no link left to find
    enough = apart.groupBy("rid", "meta").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("meta") % (1 << 32))
    apart = put(apart.join(enough.select("rid", "meta"), ["rid", "meta"], "left_semi"), "close")
    more = put(_across(apart, sets, put), "more-links")
    label = components(links.unionByName(more), ("a", "b"), put)
    least = sets.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("doc", "th", F.coalesce("least", "rid").alias("least"))
    group = put(least, "labels")
    ids = group.groupBy("least").agg(F.min("doc").alias("component"))
    named = group.join(ids, "least").join(first.select("s1", "s2", "x", "one.doc", "one.th"), ["doc", "th"])
    named = staged(named.select("s1", "s2", "x", "component", "least").distinct(), "classes")
    put.drop()
    own = F.struct(F.lit(0).alias("kind"), F.col("s1").alias("a"), F.col("s2").alias("b"))
    reached = F.struct(F.lit(1).alias("kind"), F.col("least").alias("a"), F.lit(0).cast("long").alias("b"))
    out = meta.join(named, ["s1", "s2", "x"], "left").withColumn("group", F.when(F.col("least").isNull(), own).otherwise(reached))
    return out.select("doc", "th", "x", F.coalesce("component", "doc").alias("component"), "group")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, all columns and doc and th, which name a row, and for each row x (its shingles), group and component.
    Other than a component, which is a doc_id and may stand on several rows, a group is never shared by unlinked texts."""
    rows = keyed(docs, columns=tuple(docs.columns))
    return rows, _grouped(rows.select("text", "doc", "th"))


def classes(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document (doc_id, text) with its shingles and the component of links it is in.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by links of similarity 0.75 or
    more. A null, empty or blank text has no shingles and no links; a text of under five words is one shingle.
    Equal sets link, so repeated rows share a component. A null doc_id counts as the smallest; its component_id
    is null, as is that of whatever links with it. An empty table gives an empty one. Shingles are told apart
    by 64-bit hashes and equal sets by 128 bits.

    Signatures meet in buckets; what meets there is bounded by the number of slices, not by a group of copies.
    Of the sets that may have a partner, each is first verified against the star of its signatures; then sets still
    in different components are compared, if they share enough signatures.
    """
    out = _grouped(keyed(docs), buckets)

    def back(c: str):
        return F.when(F.col(c) != NULL_DOC, F.col(c))

    return out.select(back("doc").alias("doc_id"), F.col("x").cast("long").alias("n_shingles"), back("component").alias("component_id"))


def op9_jaccard_partition(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS t
      FROM d, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (t) WHERE a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
