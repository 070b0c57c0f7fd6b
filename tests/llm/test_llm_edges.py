"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; and bijections and blocks."""

import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fabricloom.llm import decontamination, jaccard, licenses, packing, pii, quality, sharding, substrings, suffixes, token_files
from fabricloom.llm.common import passing_path
from fabricloom.llm.tokens import Encoder, public_path

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.Random(5).choices(WORDS, k=60_000))


def some_docs(spark, empty=False):
    rng = random.Random(1)
    text = " ".join(rng.choices(WORDS, k=120))
    rows = [
        (None, text, None), (None, None, "x"), (1, "", "x"), (2, " \n\t ", "x"), (3, text, "x"), (3, text, "x"), (4, text, None),
        (5, LONG, "x"), (6, "one two", "x"), (7, "one two", "x"), (8, "Ünïcödé 中文 \x00   end", "x"), (9, "a" * 3000, "x"),
    ]
    return spark.createDataFrame([] if empty else rows, "doc_id bigint, text string, lang string").withColumns(
        {"source": F.lit("s"), "n_chars": F.char_length("text").cast("long")}
    )


def clashing(docs):
    names = ["shard", "slot", "n_words", "kept", "spans", "items", "found", "x", "h", "c", "doc", "th", "rid", "part", "length", "start", "_w", "_m"]
    return docs.withColumns({n: F.lit("clash") for n in names})


RUNS = {
    "shard": lambda s, d: sharding.shard(d, "doc_id", 4, 5),
    "quality": lambda s, d: quality.judge(d),
    "keep": lambda s, d: quality.keep(d),
    "decontaminate": lambda s, d: decontamination.find(d, s.createDataFrame([(1, "one two"), (None, "x"), (2, None), (3, "")], "item_id bigint, text string")),
    "words": lambda s, d: substrings.remove_repeats(d),
    "bytes": lambda s, d: suffixes.remove_repeats(d),
    "classes": lambda s, d: jaccard.classes(d),
    "pii": lambda s, d: pii.pseudonymise(d, "k"),
    "pack": lambda s, d: packing.pack_documents(d, public_path("word_bpe_49k.json")),
    "files": lambda s, d: token_files.read_ids(token_files.write_ids(d, passing_path(s, "ids"), public_path("byte_bpe_50k.json"))),
    "licences": lambda s, d: licenses.detect(d.select(F.col("source").alias("path"), "text")),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    one_each = {"shard": 12, "quality": 12, "decontaminate": 12, "words": 12, "bytes": 12, "classes": 12, "pii": 12, "files": 12}
    rows = RUNS[name](spark, clashing(some_docs(spark))).collect()
    if name in one_each:
        assert len(rows) == one_each[name]


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](spark, some_docs(spark, empty=True)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    for docs in (clashing(some_docs(spark)), some_docs(spark, empty=True)):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(-5000, 5000) * 7919
    for n in (1, 2, 39, 40, 1000):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02


def test_hot_key_slots(spark):
    rows = sharding.shard(spark.range(3000).select(F.lit(1).alias("k")).repartition(7), "k", 4).collect()
    assert sorted(r.slot for r in rows) == list(range(3000))


def test_places_are_full_and_gapless():
    rng = random.Random(2)
    for size in (16, 64, 4096):
        histogram = Counter(rng.randint(1, size) for _ in range(2000))
        histogram[size // 3] += 5000
        used = {}
        plan = packing.place(histogram, size)
        for length, rows in itertools.groupby(sorted(plan), key=lambda p: p[0]):
            rows = list(rows)
            for (_, rank, first, offset), nxt in zip(rows, [r[1] for r in rows[1:]] + [histogram[length]]):
                for k in range(nxt - rank):
                    used.setdefault(first + k, []).append((offset, length))
        assert sorted(used) == list(range(len(used)))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size


@pytest.mark.parametrize("width", [0, 1, 7, 13, 31, 32])
def test_blocks_round_trip(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, max(1, (1 << width) - 1), (5, 1024)).astype(np.uint32) + np.uint32(0 if width == 32 else 9)
    ids[2, ::50] = 2**32 - 1
    blocks, heads = token_files.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    low, widths = zip(*heads)
    assert (token_files.decode_blocks(b"".join(blocks), starts, np.array(low), np.array(widths)) == ids).all()


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_the_library_s(name, spaced):
    import pyarrow as pa

    rng = random.Random(3)
    bits = ["a", "B", "é", ",", ".", " ", "  ", "\n", "'s", "»", "1", "!", "<|endoftext|>", "\t", "Σ", "_", "the", "́", "中", ". ", ", ", ".\n", "\xa0", "don't", "\0", "I", "̇", " ", "’", "\x1f", "　"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(5000)] + [None, "", LONG[:5000]]
    coder = Encoder(public_path(name), spaced)
    whole = [x.ids for x in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert coder.encode(pa.array(texts)) == [struct.pack(f"<{len(w)}I", *w) for w in whole]


def test_other_tokenizer_files_go_whole(tmp_path):
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "ab": 3, " a": 4}, [("a", "b"), (" ", "a")]))
    t.pre_tokenizer = pre_tokenizers.Split(" ", "merged_with_next")
    t.save(str(tmp_path / "other.json"))
    texts = ["ab ab", " a  b", None, "", "ba ab ab"]
    for spaced in (False, True):
        coder = Encoder(str(tmp_path / "other.json"), spaced)
        assert not coder.by_word
        assert coder.encode(pa.array(texts)) == [struct.pack(f"<{len(i)}I", *i) for i in (t.encode(x or "").ids for x in texts)]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        assert Encoder(public_path(name), spaced).by_word and not Encoder(public_path(name), not spaced).by_word


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, symbols in [(1, 2), (2, 2), (60, 2), (300, 3), (800, 250)]:
        t = rng.integers(0, symbols, n).astype(np.uint8)
        t[n // 2 : n // 2 + n // 4] = t[: n // 4]
        order = sorted(range(n), key=lambda i: t.tobytes()[i:])
        assert suffixes.suffix_array(t).tolist() == order
        assert suffixes.suffix_array(t.astype(np.int64), 1000).tolist() == order
        shared = suffixes.common_prefixes(t, np.array(order))
        for a, b in zip(order, order[1:]):
            k = 0
            while max(a, b) + k < n and t[a + k] == t[b + k]:
                k += 1
            assert shared[b] == k


def test_suffix_arrays_of_long_runs():
    for text in (b"ab" * 3000, b"a" * 4000 + b"b", b"b" * 900 + b"a" * 900, b"abcabd" * 500 + b"zz" * 700):
        t = np.frombuffer(text, np.uint8)
        order = suffixes.suffix_array(t).tolist()
        assert order == sorted(range(len(t)), key=lambda i: text[i:])


def test_reduced_strings_are_sorted_by_the_same_steps(monkeypatch):
    """The string of names of ordinary text has thousands of symbols; it comes back to suffix_array all the same."""
    asked, whole = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t, alphabet=256: asked.append(alphabet) or whole(t, alphabet))
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(9000)).encode()
    suffixes.repeated_windows([text, text[500:9000]], 400)
    assert asked[0] == 256 and max(asked[1:]) > 2048


def test_buckets_are_stepped_from_at_once(monkeypatch):
    """A bucket's steps don't grow with the buckets that dealt to it: one a bucket and pass, and those within it."""
    steps, step = [], suffixes._step
    monkeypatch.setattr(suffixes, "_step", lambda *args: steps.append(1) or step(*args))
    t = np.random.default_rng(3).integers(0, 60, 20_000).astype(np.uint8)
    small = suffixes.classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = np.array(sorted(lms.tolist(), key=lambda i: t.tobytes()[i:]))
    order = suffixes.induce(t, small, lms, 256)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t.tobytes()[i:])
    assert len(steps) <= 60 * 4 + 2 * 60 * 4 + 256


def test_ranks_of_stretches():
    """Symbols of few and of many bits, so that numbers are sorted with their places and without, in one block and in several."""
    rng = np.random.default_rng(5)
    for symbols in (1, 3, 100, 1 << 14, 1 << 20, 1 << 40):
        ends = np.unique(np.append(rng.integers(0, 3000, 250), 2999))
        spelled = rng.choice(rng.integers(1, symbols + 1, 6), 3000) << 1
        spelled[ends] |= 1  # as in use, no stretch begins another
        begins = rng.integers(0, 3000, 500)
        stops = ends[np.searchsorted(ends, begins)]
        last = rng.integers(0, 4, 500)
        keys = [(*spelled[a : b + 1].tolist(), x) for a, b, x in zip(begins, stops, last)]
        order = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert suffixes.ranked(np.append(spelled, 0), begins, stops, last).tolist() == [order[k] for k in keys]


def test_hot_minimizers_split_or_count(spark):
    rng = random.Random(4)
    passage = " ".join(rng.choices(WORDS, k=150))
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 120))) + " " + passage + " " + " ".join(rng.choices(WORDS, k=40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = suffixes.keyed(docs)
    found = [
        {(r.doc, s.start, s.end) for r in suffixes.spans_by_row(suffixes.repeated_spans(keyed, 400, shard, levels)).collect() for s in map(lambda x: type("S", (), dict(start=x[0], end=x[1])), suffixes.merged([(x.start, x.end) for x in r.spans]))}
        for shard, levels in ((10**6, 4), (20_000, 4), (3000, 2), (3000, 0))
    ]
    assert found[0] and all(f == found[0] for f in found)
    assert {d for d, _, _ in found[0]} == set(range(60))


def test_compaction_decides(spark, monkeypatch):
    """Paths are far fewer than edges, and where they break decides what goes: without breaks the result is wrong."""
    rng = random.Random(7)
    a, b, c = (rng.choices(WORDS, k=300) for _ in range(3))
    texts = [a, a[:170] + b, c[:90] + a[100:260] + c[90:], b[20:] + a[40:200], a[:220] + c[200:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")

    def removed():
        return {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs, keep_text=False).collect()}

    first, want = {}, {}
    for i, t in enumerate(texts):
        gone = set()
        for p in range(len(t) - 49):
            if first.setdefault(tuple(t[p : p + 50]), i) < i:
                gone |= set(range(p, p + 50))
        left = " ".join(x for k, x in enumerate(t) if k not in gone)
        want[i] = (len(gone), hashlib.sha256(left.encode()).hexdigest())
    assert removed() == want
    seen, whole = [], substrings.compact

    def counted(edges, nodes):
        out = whole(edges, nodes)
        seen.append((edges.count(), out.count()))
        return out

    monkeypatch.setattr(substrings, "compact", counted)
    assert removed() == want and 0 < 5 * seen[0][1] < seen[0][0]
    monkeypatch.setattr(substrings, "compact", lambda edges, nodes: whole(edges, nodes.withColumns({"enters": F.lit(True), "leaves": F.lit(True)})))
    assert removed() != want


def test_source_words_are_compared(spark, monkeypatch):
    """Where the first hashes agree and the second ones don't, nothing goes."""
    rng = random.Random(8)
    a, b = (" ".join(rng.choices(WORDS, k=200)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (2, a), (3, b + " " + a)], "doc_id bigint, text string")
    assert sum(r.n_removed for r in substrings.remove_repeats(docs).collect()) == 400
    spans = [s for r in substrings.remove_repeats(docs).collect() for s in r.spans]
    assert all(s.source == 1 and s.source_start == 0 for s in spans)
    whole = substrings.repeated
    monkeypatch.setattr(substrings, "repeated", lambda *x: SimpleNamespace(df=whole(*x).df.withColumn("v", F.col("v") + F.col("doc"))))
    assert sum(r.n_removed for r in substrings.remove_repeats(docs).collect()) < 400


def sets_of(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block,many", [(200_000, 8), (3_000, 200), (3_000, 3)])
def test_jaccard_on_hard_groups(spark, monkeypatch, block, many):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "MANY", many)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = []
    base = rng.choices(vocabulary, k=120)
    for _ in range(150):  # near copies, many only linked through their original or not at all
        t = base[:]
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    passage = rng.choices(vocabulary, k=40)
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60)) + passage + rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(80)]
    texts += [" ".join(rng.choices(vocabulary[:4], k=n)) for n in list(range(14)) * 8]
    short = rng.choices(vocabulary, k=18)
    for _ in range(80):
        t = short[: rng.randint(12, 18)]
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = "z"
        texts.append(" ".join(t))
    texts += [None, "", " \n "]
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_a_long_chain_of_signatures_meets_in_linear_work(spark, monkeypatch):
    """Each signature has ten sets and shares five with the next: one cluster by reach, but work follows the signatures."""
    monkeypatch.setattr(jaccard, "BLOCK", 1000)

    def work(n):
        rows = [(s, 5 * s + k, 5 * s + k, 100) for s in range(n) for k in range(10)]
        nodes = jaccard._meetings(spark.createDataFrame(rows, "sig bigint, rid bigint, part bigint, x bigint"))
        assert nodes.groupBy("cluster").agg(F.collect_set("rid").alias("r")).select(F.size("r")).distinct().collect() == [(10,)]
        return jaccard._loads(nodes, ["cluster"]).agg(F.sum("cost")).first()[0]

    assert work(240) == 4 * work(60)


def test_sets_of_many_signatures_meet_once(spark):
    rows = [(s, k, k, 100) for s in range(40) for k in range(30)]
    nodes = jaccard._meetings(spark.createDataFrame(rows, "sig bigint, rid bigint, part bigint, x bigint"))
    assert nodes.count() == 30 and nodes.select("cluster").distinct().count() == 1


def test_pseudonyms_link_spellings(spark):
    same = [
        ("4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111"), ("(743) 555-3824", "+1 743-555-3824", "743.555.3824", "+17435553824"),
        ("ann.lee@mail.example.com", "Ann.Lee@mail.example.com", "ANN.LEE@MAIL.example.com"), ("0a" * 20, "0A" * 20), ("10.0.0.7", "010.0.0.007"), ("1999-02-28", "1999/02/28"),
    ]
    rows = [(k, f"see {x} there") for k, group in enumerate(same) for x in group]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()
    for k, group in enumerate(same):
        new = [r.found[0].pseudonym for r in got if r.doc_id == k]
        plain = {re.sub("[^0-9a-z]", "", x.split("@")[0].lower().removeprefix("+1")) for x in new}
        assert len(new) == len(group) and len(plain) == 1 and not plain & {re.sub("[^0-9a-z]", "", group[0])}
        if k < 3:
            assert [re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x.split("@")[0]))) for x in new] == [re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x.split("@")[0]))) for x in group]


def test_numbers_and_dates_are_permutations(spark):
    n = pii.DAYS_HIGH * pii.DAYS_LOW
    t = spark.range(n).select(pii.feistel_number(F.col("id"), pii.DAYS_HIGH, pii.DAYS_LOW, "k", "date").alias("v"))
    r = t.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count_distinct("v").alias("n")).first()
    assert (r.a, r.b, r.n) == (0, n - 1, n)


def test_decontamination_spans_and_passes(spark):
    passage = " ".join(f"Q{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"Start, é! {passage.upper().replace(' ', '--')} end"), (2, "short one!"), (3, "nothing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage), (8, "SHORT one"), (8, "SHORT one"), (10, passage)], "item_id bigint, text string")
    for limit in (10**6, 400):
        got = {r.doc_id: r for r in decontamination.find(docs, items, limit=limit).collect()}
        assert got[1]["items"] == ["10", "7"] and got[2]["items"] == ["8"] and got[3]["items"] == []
        (span,) = got[1].spans
        text = docs.where("doc_id = 1").first().text
        assert text[span.start : span.end] == passage.upper().replace(" ", "--") and span.words == 14 and span.word == 2


def test_licences_by_brute_force(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "hi"), ("a/b/y.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z", "z"), ("q", None), ("q2/r", "All about licensing in general and nothing else at all, really nothing")]
    t = spark.createDataFrame(files * 2, "path string, text string")
    found = {r.path: r for r in licenses.detect(t).collect()}
    notices = [line for _, text in files * 2 for line in (text or "").split("\n") if re.search(licenses.NOTICE, line)]

    def terms(s):
        return Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", s.lower()))

    corpus = [terms(x) for x in notices] + [terms(x) for _, x in licenses.TEMPLATES]

    def weigh(c):
        return {k: v * (1 + math.log((1 + len(corpus)) / (1 + sum(k in d for d in corpus)))) for k, v in c.items()}

    def cosine(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    for path, text in files:
        best = max((round(cosine(weigh(terms(line)), weigh(terms(x))), 6) for line in (text or "").split("\n") if re.search(licenses.NOTICE, line) for _, x in licenses.TEMPLATES), default=0)
        assert (path in found) == (best >= licenses.LEAST)
        if path in found:
            assert abs(found[path].score - best) < 2e-6
    out = {r.path: (r.licence, r.inherited_from) for r in licenses.inherit(t, licenses.detect(t)).collect()}
    assert out == {"a/LICENSE": ("MIT", None), "a/b/x.py": ("MIT", "a"), "a/b/y.py": ("CC-BY-NC-4.0", None), "a/b/c/COPYING": ("GPL-3.0", None), "a/b/c/d/z": ("GPL-3.0", "a/b/c"), "q": (None, None), "q2/r": (None, None)}


def gnu_header(version, mark):
    lines = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
             f"the Free Software Foundation, either version {version} of the License, or", "(at your option) any later version.", "",
             "This program is distributed in the hope that it will be useful,", "but WITHOUT ANY WARRANTY; without even the implied warranty of"]
    return "\n".join(mark + x for x in lines)


def test_wrapped_notices(spark):
    rows = [
        ("three/a.py", gnu_header(3, "# ") + "\nimport os\n"), ("two/a.c", "/*\n" + gnu_header(2, " * ") + "\n */\nint x;"), ("plain/COPYING", gnu_header(2, "")),
        ("plain/src/x", "x"), ("apache/LICENSE", "                Apache License\n          Version 2.0, January 2004\n"),
        ("gnu/COPYING", "           GNU GENERAL PUBLIC LICENSE\n              Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
        ("narrow/a.sql", "-- Licensed under the\n-- GNU General\n-- Public License,\n-- version 2.\nselect 1"), ("prose/a", "An essay on the public\nand its terms\nof trade and\nlicence in general."),
    ]
    t = spark.createDataFrame(rows, "path string, text string")
    out = {r.path: r.licence for r in licenses.inherit(t, licenses.detect(t)).collect()}
    assert out == {"three/a.py": "GPL-3.0", "two/a.c": "GPL-2.0", "plain/COPYING": "GPL-2.0", "plain/src/x": "GPL-2.0", "apache/LICENSE": "Apache-2.0",
                   "gnu/COPYING": "GPL-2.0", "narrow/a.sql": "GPL-2.0", "prose/a": None}


def test_notices_without_keywords_and_spdx_tags(spark, monkeypatch):
    rows = [
        ("a", "Dedicated under CC0 1.0.", "CC0-1.0"), ("b", "// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("c", "# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("d", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0"), ("e", "<!-- spdx-license-identifier: (MIT OR BSD-2-Clause) -->", "BSD-2-Clause"),
        ("i", "int x;\nThis is free\nand unencumbered software\nreleased into\nthe domain\nof the public.\n" * 3, "Unlicense"),
        ("f", "SPDX-License-Identifier: ISC more words", "ISC"), ("g", "SPDX-License-Identifier: NOASSERTION", None), ("h", "Dedicated under protest, to the public, by the author.", None),
    ]
    t = spark.createDataFrame(rows, "path string, text string, wanted string")
    assert {r.path: r.licence for r in licenses.detect(t).collect()} == {p: w for p, _, w in rows if w}
    # the bound loses nothing that the cosine takes
    bounded = {tuple(r) for r in licenses.detect(t, least=0.2).collect()}
    monkeypatch.setattr(licenses, "_bound", lambda *_: None)
    assert {tuple(r) for r in licenses.detect(t, least=0.2).collect()} == bounded and {"a", "h"} <= {r[0] for r in bounded}


def test_op2_rows(spark):
    from fabricloom.llm import queries

    rows = queries.queries()["op2_license_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and any(r.licence for r in rows)


def test_cascade_order_does_not_change_the_verdict(spark):
    docs = some_docs(spark)
    rules = quality.rules(quality.measures(F.col("text")))
    verdicts = {tuple(sorted((str(r.text), r.rejected_by is None) for r in quality.cascade(docs, rules, list(o)).collect())) for o in (sorted(rules), sorted(rules, reverse=True))}
    assert len(verdicts) == 1
    judged = {(str(r.text), r.kept) for r in quality.judge(docs).collect()}
    assert set(*verdicts) == judged and {str(r.text) for r in quality.keep(docs).collect()} == {t for t, k in judged if k}


def test_rules_are_credited_with_what_is_left():
    hits = {"a": {1, 2, 3}, "b": {1, 2, 3, 4}, "c": {5}, "d": set()}
    assert quality.by_rejection_per_cost(hits, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.1}) == ["b", "c", "d", "a"]
    assert quality.by_rejection_per_cost(hits, {"a": 1.0, "b": 9.0, "c": 0.1, "d": 0.1}) == ["c", "a", "b", "d"]


def test_rejected_rows_never_reach_later_rules(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "x " * 12)], "doc_id bigint, text string")
    costly = F.when(F.col("text").startswith("one"), F.raise_error("asked")).otherwise(F.lit("")) != ""
    found = {"few_words": quality.measures(F.col("text"))["n_words"] < 10, "costly": costly}
    out = {r.doc_id: r.rejected_by for r in quality.cascade(docs, found, ["few_words", "costly"]).collect()}
    assert out == {1: "few_words", 2: None}


def test_measures_are_worked_out_when_asked_for(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (2, "some words " * 12 + "x y z"), (3, "# " * 30), (4, " ".join(f"{a}{b}ord" for a in "abcdef" for b in "ghij"))], "doc_id bigint, text string")
    plain = quality.measures
    verdicts = {r.doc_id: r.rejected_by for r in docs.withColumn("rejected_by", quality.first_rejection(F.col("text"), list(quality.RULES))).collect()}
    assert verdicts == {1: "few_words", 2: "repeated_words", 3: "repeated_words", 4: None}
    assert verdicts == {r.doc_id: r.rejected_by for r in quality.cascade(docs, quality.rules(plain(F.col("text"))), list(quality.RULES)).collect()}

    def watched(text):
        late = F.when(text.rlike("^(one|some|#)"), F.raise_error("asked for")).otherwise(F.lit(0)).cast("long")
        return plain(text) | {n: plain(text)[n] + late for n in ("n_symbols", "n_letters", "n_capitals", "n_dup_lines", "n_lines")}

    monkeypatch.setattr(quality, "measures", watched)
    again = docs.withColumn("rejected_by", quality.first_rejection(F.col("text"), list(quality.RULES)))
    assert {r.doc_id: r.rejected_by for r in again.collect()} == verdicts
    with pytest.raises(Exception, match="asked for"):
        docs.withColumn("rejected_by", quality.first_rejection(F.col("text"), list(quality.RULES)[::-1])).collect()


def test_order_saves_work(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    flags = quality.measure(docs).select("doc_id", *[c.alias(n) for n, c in quality.rules({m: F.col(m) for m in quality.MEASURES}).items()]).collect()
    asks = {n: a for n, (a, _) in quality.RULES.items()}
    costs = dict(zip(quality.MEASURES, [1.0, 1.0, 1.0, 1.0, 1.0, 16.0, 4.0, 4.0]))
    best = quality.by_rejection_per_cost({n: {r.doc_id for r in flags if r[n]} for n in asks}, costs, asks)

    def work(order):
        total = 0
        for r in flags:
            known = set()
            for n in order:
                total += sum(costs[m] for m in set(asks[n]) - known)
                known |= set(asks[n])
                if r[n]:
                    break
        return total

    assert work(best) < 0.97 * work(best[::-1]) and work(best) < 0.95 * sum(costs.values()) * len(flags)
    assert sorted(quality.order(docs)) == sorted(best)


def test_single_characters_are_permuted(spark):
    for alphabet, hexadecimal in ((pii.LOWER, False), (pii.DIGITS, False), (pii.HEX, True)):
        rows = spark.createDataFrame([(c,) for c in alphabet], "c string")
        got = {r.c: r.p for r in rows.select("c", pii.feistel_text(F.col("c"), "key", F.lit("kind"), F.lit(hexadecimal)).alias("p")).collect()}
        assert sorted(got.values()) == sorted(alphabet)
        assert len({(alphabet.index(v) - alphabet.index(k)) % len(alphabet) for k, v in got.items()}) > 2  # no constant shift
