"""Benchmark decontamination with one Aho-Corasick automaton over the windows of benchmark items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices, staged

WINDOW = 10
#: Nodes at most of one automaton, at about 55 bytes each. An item has about WINDOW nodes for each of its characters.
#: Items beyond it are dealt to several passes, each of which is written before the next.
AUTOMATON_NODES = 6_000_000
SPANS = "array<struct<start: bigint, end: bigint, word: bigint, words: bigint>>"


def _fold() -> bytes:
    """Bytes to bytes: A-Z to a-z, other ASCII than letters and digits to a space; the rest stays."""
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz"
    table = bytearray(b if b > 127 or b in keep else 32 for b in range(256))
    for b in range(65, 91):
        table[b] = b + 32
    return bytes(table)


FOLD = _fold()


def normal(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, int]]:
    """Each window of an item, with its number of words; a shorter item is one window."""
    n = min(size, len(words))
    return [(b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1)] if n else []


def automaton(items: list[tuple], size: int):
    """Finds every window of (id, text) items at once; a window knows the ids of all items that have it."""
    import ahocorasick

    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        for window, n in windows(normal(text), size):
            found.setdefault(window, (n, set()))[1].add(item)
    tree = ahocorasick.Automaton()
    for window, (n, ids) in found.items():
        spelled = f" {window.decode('latin-1')} "
        tree.add_word(spelled, (len(spelled), n, tuple(ids)))
    if found:
        tree.make_automaton()
    return tree if found else None


_built: dict[str, object] = {}


def built(name: str, items: list[tuple], size: int):
    """The automaton of a name, built once by each Python worker; only the last one is held."""
    if name not in _built:
        _built.clear()
        _built[name] = automaton(items, size)
    return _built[name]


def scan(text: str | None, tree) -> tuple[int, list[tuple[int, int]], set]:
    """The number of words, the hit stretches as (first word, words) and the items found. One pass over the text."""
    words = normal(text)
    if tree is None or not words:
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    found = [(end, *what) for end, what in tree.iter(line)]
    if not found:
        return len(words), [], set()
    import numpy as np

    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    lasts = np.searchsorted(gaps, [f[0] for f in found])
    stretches: list[tuple[int, int]] = []
    for first, last in sorted((int(e) - f[2], int(e)) for e, f in zip(lasts, found)):
        if stretches and first <= stretches[-1][1]:
            stretches[-1] = (stretches[-1][0], max(last, stretches[-1][1]))
        else:
            stretches.append((first, last))
    return len(words), [(a, b - a) for a, b in stretches], {i for f in found for i in f[3]}


def original(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Stretches of words as (start, end) characters of the text itself, and the words again."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    solid = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[begins[a]]), int(chars[ends[a + n - 1]]), a, n) for a, n in stretches]


def _blocks(benchmark: DataFrame, size: int, limit: int):
    """Items in blocks of about `limit` nodes (or one item), each small enough for every task and the driver."""
    sized = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = sized.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = max(1, -(-total * size // limit))
    if parts == 1:
        yield sized.collect()
        return
    dealt = staged(sized.distinct().withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts))), "items")
    for b in range(2 * parts):
        if block := dealt.where(F.col("_b") == b).select("item_id", "text").collect():
            yield block


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = AUTOMATON_NODES) -> DataFrame:
    """Adds n_words, items (ids of the benchmark items found, sorted as strings) and spans to documents.

    A span is a maximal stretch of hit words: start and end are characters of the original text, word and words
    its place among the words. Null and empty texts have no words. Items with a null id or text are left out;
    repeated items count once. Repeated documents are each searched. Columns of these names are replaced. The
    documents are read in one pass without a shuffle; items past the limit of one automaton are searched for
    in further passes, whose spans are merged; every pass is written, so a task holds one automaton at a time.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("n_words", "items", "spans")
    added = [F.lit(None).cast(t).alias(n) for n, t in (("n_words", "bigint"), ("items", "array<string>"), ("spans", SPANS))]
    schema = docs.select(*docs.columns, *added).schema
    out, width, names = docs, len(docs.columns), schema.names
    for k, block in enumerate(_blocks(benchmark, size, limit)):
        out = staged(out, "searched") if k else out
        name = uuid.uuid4().hex
        shared = docs.sparkSession.sparkContext.broadcast([(str(i), t) for i, t in block])

        def search(batches, shared=shared, name=name, again=bool(k)):
            import pyarrow as pa

            tree = built(name, shared.value, size)
            span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "word", "words")]))
            for batch in batches:
                for part in slices(batch, "text"):
                    columns = list(part.columns)
                    before = [part.column(n).to_pylist() for n in ("items", "spans")] if again else None
                    counts, items, spans = [], [], []
                    for r, text in enumerate(part.column("text").to_pylist()):
                        n, stretches, ids = scan(text, tree)
                        if again:
                            ids |= set(before[0][r])
                            stretches = _merge(stretches + [(s["word"], s["words"]) for s in before[1][r]])
                        counts.append(n)
                        items.append(sorted(ids))
                        spans.append([dict(zip(("start", "end", "word", "words"), s)) for s in original(text, stretches)] if stretches else [])
                    columns = columns[:width] + [pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
                    yield pa.RecordBatch.from_arrays(columns, names)

        out = out.mapInArrow(search, schema)
    return out


def _merge(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, n in sorted(stretches):
        if out and a <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), a + n) - out[-1][0])
        else:
            out.append((a, n))
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(ws) - n + 2)) AS u(i)),
hit AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, s)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, n)) AS v(k) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
