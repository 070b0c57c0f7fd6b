"""Tiered search against a plain one: every tier gets used, odd rows, ties, no shipped terms."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fabricloom.llm import queries as llm
from fabricloom.llm import search
from oracle import assert_same

PATTERN = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def test_query(spark):
    assert_same(llm.queries()["op13_tiered_search"](spark, "/root/testdata/sf0.001"), llm.oracle_sql()["op13_tiered_search"], "/root/testdata/sf0.001")


def split(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plainly(docs, items, top=10):
    counts = [(d, Counter(split(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, found = split(text), []
        for (d, c), n in zip(counts, sizes):
            if n:
                m = 25 + 75 * n * n_docs // total
                found.append((sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t]), d))
        ranked = sorted(((s, d) for s, d in found if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(ranked)]
    return sorted(out, key=repr)


def found(spark, docs, items, clash=True):
    frames = [spark.createDataFrame(rows, "id bigint, text string") for rows in (docs, items)]
    if clash:
        frames = [f.withColumns({c: F.lit("clash") for c in ("rid", "key", "n", "terms", "item", "term", "rank", "tier", "score")}) for f in frames]
    return search.ranked_search(frames[0], "id", "text", frames[1], "id", "text").collect()


def test_tiers(spark, monkeypatch):
    monkeypatch.setattr(search, "TIERS", (12, 40))
    monkeypatch.setattr(search, "STEP", 1 << 10)
    monkeypatch.setattr(search, "FIRST", 15)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    items = [(i, text(rng.randint(2, 12))) for i in range(12)] + [(90, "planted rare words here"), (91, "w59"), (92, "w0 w0 w1"), (93, "w0 w3 w9 w58")]
    docs = [(i, text(rng.randint(1, 80))) for i in range(260)] + [(300 + i, "planted rare words here") for i in range(11)]
    rows = found(spark, docs, items)
    assert sorted([tuple(r)[:4] for r in rows], key=repr) == plainly(docs, items)
    assert {r.tier for r in rows} == {0, 1, 2}


@pytest.mark.parametrize("shipped", [search.SHIPPED, 0])
def test_odd_rows(spark, monkeypatch, shipped):
    monkeypatch.setattr(search, "SHIPPED", shipped)
    copies = [(i, "Apple pie, été 中文") for i in range(30, 10, -1)]
    docs = [(None, "apple pie"), (1, None), (2, ""), (3, " ,.! \x00"), (4, "APPLE apple Éclair"), (4, "APPLE apple Éclair"), (5, "pie " * 40_000), *copies]
    items = [(None, "apple"), (1, None), (2, ""), (3, "!!"), (4, "apple pie pie"), (4, "apple pie pie"), (5, "ÉCLAIR éclair"), (6, "unheard of"), (7, "été 中文")]
    assert sorted([tuple(r)[:4] for r in found(spark, docs, items)], key=repr) == plainly(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
