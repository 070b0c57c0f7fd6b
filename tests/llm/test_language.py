"""The random field against plain enumeration, held-out accuracy, spans of texts that switch, odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabricloom.llm import language
from fabricloom.llm import queries as llm


def random_model(languages, seed=1):
    rng, n = np.random.default_rng(seed), len(languages)
    return language.Model(languages, rng.normal(size=((1 << language.BITS) + n, n)).astype(np.float32), rng.normal(size=(n, n)), rng.normal(size=n))


def test_marginals_equal_enumeration():
    model, rng = random_model(["a", "b", "c"]), np.random.default_rng(3)
    lengths = np.array([1, 6, 3])
    scores = 2 * rng.normal(size=(10, 3))
    got, at = language.marginals(scores, lengths, model), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = model.first[path[0]] + sum(scores[at + t, k] for t, k in enumerate(path)) + sum(model.moves[i, j] for i, j in zip(path, path[1:]))
            for t, k in enumerate(path):
                want[t, k] += np.exp(w)
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_marginals_over_stretches():
    model, rng = random_model(["a", "b"], 5), np.random.default_rng(4)
    lengths = np.array([5, language.STRETCH, language.STRETCH + 1, 3000, 64, 1])
    scores = 30 * rng.normal(size=(lengths.sum(), 2))
    got, at = language.marginals(scores, lengths, model), 0
    for n in lengths:
        x, ahead, back = scores[at : at + n], np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = model.first + x[0]
        for t in range(1, n):
            ahead[t] = x[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + model.moves, axis=0)
        for t in range(n - 2, -1, -1):
            back[t] = np.logaddexp.reduce(model.moves + (x[t + 1] + back[t + 1])[None], axis=1)
        both = ahead + back
        assert np.allclose(got[at : at + n], np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]), atol=1e-9)
        at += n


def test_pairs_equal_enumeration():
    model, rng = random_model(["a", "b", "c"], 8), np.random.default_rng(9)
    sizes = np.array([4, 1, 3])
    scores = rng.normal(size=(8, 3))
    last = np.zeros(8, bool)
    last[np.cumsum(sizes) - 1] = True
    got = language._pairs(scores, language.marginals(scores, sizes, model), np.flatnonzero(~last), sizes, model)
    want, at = np.zeros((3, 3)), 0
    for n in sizes:
        mine, total = np.zeros((3, 3)), 0
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(model.first[path[0]] + sum(scores[at + t, k] for t, k in enumerate(path)) + sum(model.moves[i, j] for i, j in zip(path, path[1:])))
            total += w
            for i, j in zip(path, path[1:]):
                mine[i, j] += w
        want, at = want + mine / total, at + n
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(6)
    syllables = {"aa": ["ka", "ro", "ti", "mun", "sé"], "bb": ["qua", "lor", "vi", "dex", "ny"]}
    word = lambda g: "".join(rng.choices(syllables[g], k=rng.randint(1, 4)))
    return lambda g, n: " ".join(word(g) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark, tongues):
    rows = [(f"{tongues(g, 60)}.", g) for g in ("aa", "bb") for _ in range(60)]
    return language.train(spark.createDataFrame([*rows, (None, "aa"), ("unlabelled", None)], "text string, lang string"), "text", "lang")


def test_spans_of_switching_text(spark, model, tongues):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        parts = [(g, tongues(g, rng.randint(15, 400 if k % 9 == 0 else 40))) for g in rng.choice([["aa", "bb"], ["bb", "aa", "bb"]])]
        rows.append((k, "; ".join(t for _, t in parts), [g for g, _ in parts], [len(t) for _, t in parts]))
    df = spark.createDataFrame(rows, "doc_id int, text string, want array<string>, sizes array<int>")
    right = 0
    for r in language.identify(df, model).collect():
        spans = [(s.start, s.stop, s.lang) for s in r.spans]
        assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        words = sum(len(r.text[a:b].replace(";", "").split()) for a, b, _ in spans)
        assert words == len(r.text.replace(";", "").split())
        right += [g for _, _, g in spans] == r.want and all(abs(b - a - n) <= 16 for (a, b, _), n in zip(spans, r.sizes))
    assert right >= 36


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = llm.queries()["op12_crf_language"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    joined = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    n, right, low, high = joined.agg(F.count("*"), F.avg(F.expr("cast(lang = lang_pred as int)")), F.min("score"), F.max("score")).first()
    assert n > 200 and right >= 0.97 and 0 <= low <= high <= 1
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_odd_rows(spark, model, tongues):
    long = tongues("bb", 50_000)
    rows = [(None, None), (1, ""), (2, "123 ... \x00 --"), (3, tongues("aa", 30)), (3, tongues("aa", 30)), (4, long), (5, "é"), (6, "x" * 5000), (7, "𝔘 中文"), (8, "ka")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("score", "spans", "lang_pred", "word", "n", "language")})
    got = language.identify(df, model).collect()
    assert [(r.doc_id, r.text) for r in got] == rows and {r.word for r in got} == {"clash"}
    said = [r.lang_pred for r in got]
    assert said[:3] == ["und"] * 3 and said[3:6] == ["aa", "aa", "bb"] and set(said[6:]) <= {"aa", "bb"} and said[-1] == "aa"
    assert [r.score for r in got[:3]] == [0, 0, 0] and all(0.33 < r.score <= 1 for r in got[3:]) and [r.spans for r in got[:3]] == [[]] * 3
    assert got[5].spans[0].start == 0 and got[5].spans[-1].stop == len(long)
    nothing = language.train(df.limit(0), "text", "lang_pred")
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), model).collect() == []
    one = language.train(spark.createDataFrame([("only this", "zz")], "text string, lang string"), "text", "lang")
    assert {r.lang_pred for r in language.identify(df, one).collect()} == {"und", "zz"}
