"""The registered queries against their SQL or against brute force, on the smallest table."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from fabricloom.llm import queries as llm
from fabricloom.llm import sharding
from oracle import SMALL, assert_same

ORACLES = llm.oracle_sql()


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_same(llm.queries()[name](spark, SMALL), ORACLES[name])


def test_sharding(spark):
    rows = llm.queries()["op1_jump_sharding"](spark, SMALL).collect()
    texts = dict(documents())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    for k in range(40):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))


def whole_ids(name):
    from tokenizers import Tokenizer

    from fabricloom.llm.tokens import public_path

    t = Tokenizer.from_file(public_path(name))
    return {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in documents()}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(spark):
    rows = llm.queries()["op3_histogram_packing"](spark, SMALL).collect()
    ids, seen, used = whole_ids("word_bpe_49k.json"), Counter(), {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert crc(piece) == r.ids_crc32 and len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(seen) == sum(map(len, ids.values())) and set(seen.values()) == {1}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(map(len, ids.values())) / (4096 * len(used)) > 0.95


def test_token_files(spark):
    rows = sorted(llm.queries()["op10_token_files"](spark, SMALL).collect(), key=lambda r: r.doc_id)
    ids, at = whole_ids("byte_bpe_50k.json"), 0
    assert [r.doc_id for r in rows] == sorted(ids)
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens


def test_suffixes(spark):
    got = {r.doc_id: tuple(r)[1:] for r in llm.queries()["op8_induced_suffixes"](spark, SMALL).collect()}
    texts = [(d, (x or "").encode()) for d, x in documents()]
    count = Counter(x[p : p + 400] for _, x in texts for p in range(len(x) - 399))
    for d, x in texts:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 399):
            if count[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(b for b, g in zip(x, gone) if not g)
        assert got[d] == (len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())


def licence_scores(texts):
    """Of each text the best cosine of any of its spans to each licence, span by span; SPDX tags aside."""
    import math

    from fabricloom.llm import licenses

    def terms(x):
        return Counter(re.findall(licenses.TERM, x.lower()))

    corpus = [terms(line) for t in texts.values() for line in (t or "").split("\n") if re.search(licenses.NOTICE, line)] + [terms(x) for _, x in licenses.TEMPLATES]
    df = Counter(x for c in corpus for x in c)

    def weigh(c):
        w = {x: n * (1 + math.log((1 + len(corpus)) / (1 + df[x]))) for x, n in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()} if norm else {}

    templates = [(name, weigh(terms(x))) for name, x in licenses.TEMPLATES]
    anchors = {x for _, t in templates for x in t}
    out = {}
    for path, text in texts.items():
        lines = (text or "").split("\n")
        worded, comment = [bool(terms(x)) for x in lines], [bool(re.match(licenses.COMMENT, x)) for x in lines]
        spans = {(i, i + k) for k in range(1, 7) for i in range(len(lines) - k + 1) if all(worded[i : i + k])}
        for flags in (worded, comment):
            for i in range(len(lines)):
                if flags[i] and (i == 0 or not flags[i - 1]):
                    spans.add((i, next((j for j in range(i, len(lines)) if not flags[j]), len(lines))))
        best = {}
        for a, b in spans:
            mine = terms("\n".join(lines[a:b]))
            if not anchors & set(mine):
                continue
            w = weigh(mine)
            for name, t in templates:
                best[name] = max(best.get(name, 0), sum(v * t.get(x, 0) for x, v in w.items()))
        out[path] = best
    return out


def test_licences(spark):
    from fabricloom.llm import licenses

    docs = duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SMALL}/documents.parquet'").fetchall()
    path = {d: f"{s or 'unknown'}/{g or 'unknown'}/{d}" for d, _, s, g in docs}
    scores = licence_scores({path[d]: t for d, t, _, _ in docs})
    top = {p: max(v.values(), default=0) for p, v in scores.items()}
    found = {d: top[path[d]] for d, *_ in docs if round(top[path[d]], 6) >= licenses.LEAST}
    first = {}
    for d, _, s, _ in docs:
        if d in found:
            first[s] = min(d, first.get(s, d))
    rows = {r.doc_id: r for r in llm.queries()["op2_license_scan"](spark, SMALL).collect()}
    assert set(rows) == set(path) and first
    for d, _, s, _ in docs:
        r = rows[d]
        assert r.path == (f"{s or 'unknown'}/LICENSE" if first.get(s) == d else path[d])
        best = scores[path[d if d in found else first[s]]] if d in found or s in first else {}
        if not best:
            assert r.licence is None and r.score is None and r.inherited_from is None
            continue
        assert abs(r.score - max(best.values())) < 2e-6 and best[r.licence] > max(best.values()) - 2e-6
        assert r.inherited_from == (None if d in found else (s or "unknown"))


def test_pseudonyms(spark, tmp_path):
    from brute_pii import pseudonymised

    odd = [
        "Card 4111-1111-1111-1111, again 4111111111111111 and 3782 822463 10005; not 4111111111111112. Mail Ann.Lee9@Mail.example.com!",
        "+1 (743) 555-3824, 743-555-3824, +44 20 7946 0958, +17435553824; ip 10.0.0.255 not 10.0.0.256 nor v2.0.",
        f"key {'0a' * 20} {'0A' * 16} AKIA{'Q7' * 8} born 1999-02-28 or 28/2/1999, 2/28/1999, 31.12.2024, not 1999-02-30, nor 1700-01-01",
        "123-45-6789 665-01-0001 667-99-9999 not 666-01-0001, 900-11-1111", "", None, "\n@ 1.1 \u00e9 \u4e2d 12-12",
    ]
    have = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    rows = have + [(10**6 + k, t) for k, t in enumerate(odd)] + [(10**6, odd[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in llm.queries()["op7_feistel_pseudonyms"](spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in rows:
        new, kinds = pseudonymised(t or "", "demonstration key, not a secret")
        n = Counter(kinds)
        want.append((d, None if t is None else new, sum(n[k] for k in ("card", "phone", "ssn", "ip")), n["date"], n["email"] + n["secret"]))
    assert got == sorted(want, key=str) and sum(r[2] for r in got) > 20


def jump_by_hand(key, shards):
    """Jump consistent hashing, one key at a time, as published."""
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_by_hand():
    keys = np.array([0, 1, -1, 7919, 1 << 40, -(1 << 62)])
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]


def link_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for e in s:
            holders.setdefault(e, []).append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for e in s for j in holders[e] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_pipeline(spark):
    """Every stage by brute force on the texts that the one before it keeps."""
    import corpus_pipeline
    from brute_pii import pseudonymised
    from fabricloom.llm import decontamination, pii

    rows = corpus_pipeline.run(spark, SMALL).collect()
    quality = ORACLES["op4_quality_cascade"].replace("FROM documents", f"FROM '{SMALL}/documents.parquet' ")
    kept = {d for (d,) in duckdb.sql(f"WITH q AS ({quality}) SELECT doc_id FROM q WHERE kept").fetchall()}
    docs = [(d, t) for d, t in documents() if d in kept]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    docs = [docs[k] for k, least in enumerate(link_components(sets)) if least == k]
    items = duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet' WHERE text IS NOT NULL").fetchall()
    windows = {w for (t,) in items for w, _ in decontamination.windows(decontamination.normal(t), 10)}
    sizes = {len(w.split()) for w in windows}
    clean = []
    for d, t in docs:
        w = decontamination.normal(t)
        if not any(b" ".join(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append((d, pseudonymised(t, pii.DEMO_KEY)[0]))
    from tokenizers import Tokenizer

    from fabricloom.llm.tokens import public_path

    coder = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    ids = {d: coder.encode(t, add_special_tokens=False).ids + [2] for d, t in clean}
    assert {r.doc_id for r in rows} == set(ids) and 0 < len(ids) < len(kept)
    for r in rows:
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
    for d, whole in ids.items():
        assert sum(r.length for r in rows if r.doc_id == d) == len(whole)


def test_near_duplicates_of_rows_with_one_id(spark):
    """Two unlinked texts under one doc_id both stay; of linked ones one stays, though they have no doc_id."""
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, a + " end", "x"), (None, b + " end", "x"), (None, b + " tail", "x"), (3, "", "x"), (4, "", "x"), (4, "", "x"), (5, None, "x")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, t, "").collect()), key=str)
    gone_b = [x for x in out if x[1] in (b, b + " end", b + " tail")]
    assert len(gone_b) == 1 and gone_b[0][0] is None
    assert [x for x in out if x[1] not in (b, b + " end", b + " tail")] == sorted([(1, a), (3, ""), (4, ""), (5, None)], key=str)


def test_odd_doc_ids_have_their_results(spark):
    """Null and repeated doc_ids: a null is the least id, rows of one id are never before each other."""
    from fabricloom.llm import jaccard, substrings, suffixes

    a = " ".join(f"w{i}" for i in range(120))
    rows = [(None, a), (None, a), (3, a), (3, a + " x"), (4, "short"), (None, None), (5, "")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(t).collect()), key=str)
    assert cut == sorted([(None, 120, 0), (None, 120, 0), (3, 120, 120), (3, 121, 120), (4, 1, 0), (None, 0, 0), (5, 0, 0)], key=str)
    n = len(a)
    bytes_ = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(t).collect()), key=str)
    assert bytes_ == sorted([(None, n, n), (None, n, n), (3, n, n), (3, n + 2, n), (4, 5, 0), (None, 0, 0), (5, 0, 0)], key=str)
    linked = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(t).collect()), key=str)
    assert linked == sorted([(None, 116, None), (None, 116, None), (3, 116, None), (3, 117, None), (4, 1, 4), (None, 0, None), (5, 0, 5)], key=str)


def test_texts_beyond_a_segment_and_a_slice(spark):
    """A text of more words than a segment of windows and one of more bytes than a slice, each beside a copy of its middle."""
    import random

    from fabricloom.llm import substrings, suffixes

    rng = random.Random(9)
    words = [f"u{rng.randrange(10**9)}" for _ in range(140_000)]
    long = " ".join(words)
    part = " ".join(words[131_000:131_400])
    t = spark.createDataFrame([(1, long), (2, part), (3, "z" * 2_500_000)], "doc_id bigint, text string")
    cut = {r.doc_id: (r.n_words, r.n_removed, [tuple(s) for s in r.spans]) for r in substrings.remove_repeats(t, keep_text=False).collect()}
    assert cut == {1: (140_000, 0, []), 2: (400, 400, [(0, 400, 1, 131_000)]), 3: (1, 0, [])}
    gone = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(t, keep_text=False).collect()}
    assert gone == {1: (len(long), len(part)), 2: (len(part), len(part)), 3: (2_500_000, 2_500_000)}
