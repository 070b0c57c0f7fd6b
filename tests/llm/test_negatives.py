"""Hard negatives against a plain search: hot labels over many blocks, odd rows, ties, scores beyond exact doubles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fabricloom.llm import negatives
from fabricloom.llm import queries as llm
from oracle import assert_same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    assert_same(llm.queries()["op11_hard_negatives"](spark, f"/root/testdata/{sf}"), llm.oracle_sql()["op11_hard_negatives"], f"/root/testdata/{sf}")


def plainly(rows, positives=5, negatives_=10, low=30, high=90):
    """Rows of the result, in order; rows are (id, label, vector, anchor)."""
    kept = [
        (i, g, [min(2**63 - 1, math.floor(256 * x)) for x in v], a) for i, g, v, a in rows
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, g, v, a) in enumerate(kept):
        if not a:
            continue
        score = [sum(x * y for x, y in zip(v, w[2])) for w in kept]
        order = sorted((j for j in range(len(kept)) if j != k), key=lambda j: (-score[j], kept[j][0]))
        for p in [j for j in order if kept[j][1] == g][:positives]:
            found = [j for j in order if kept[j][1] != g and low * score[p] <= 100 * score[j] <= high * score[p]][:negatives_]
            out += [(i, kept[p][0], r + 1, kept[j][0], score[p], score[j]) for r, j in enumerate(found)]
    return sorted(out)


def mined(spark, rows, label="string", shape=None):
    df = spark.createDataFrame(rows, f"id bigint, label {label}, v array<double>, a boolean")
    df = df.withColumns({c: F.lit("clash") for c in ("rid", "code", "q", "g", "block", "first", "score", "rank")})
    return sorted(tuple(r) for r in negatives.mine(df, "id", "v", F.col("label"), F.col("a"), shape=shape or negatives.Shape(4, 7, 3)).collect())


def test_hot_label_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 20 + ["warm"] * 8 + list("abcdef")), [rng.randint(-3, 9) / 64 for _ in range(8)], i % 3 == 0) for i in range(90)]
    assert (got := mined(spark, rows)) == plainly(rows) and len(got) > 300


def test_odd_rows(spark):
    same = [0.5, 0.25]
    rows = [
        (1, "a", same, True), (1, "a", same, True), (2, "a", same, False), (3, "a", [0.5], False), (4, "b", [0.25, 0.125], False), (4, "b", [0.25, 0.125], False),
        (5, "b", [0.25, 0.125, 0.5], False), (6, None, same, True), (None, "a", same, True), (7, "a", None, True), (8, "b", [0.25, None], True),
        (9, "b", [float("nan"), 0.1], True), (10, "c", [float("inf"), 0.1], True), (11, "c", [], True), (12, "c", [0.3], False), (13, "lonely", same, True),
        (14, "d", [-0.5, 0.0], True), (15, "d", [0.5, 0.0], True), (16, "e", [-0.001], None),
    ]
    assert (got := mined(spark, rows)) == plainly(rows) and {r[0] for r in got} >= {1}
    assert mined(spark, []) == [] and mined(spark, [r for r in rows if r[1] == "c"]) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, i % 2, [2.0**20 + i / 256, 3.0**10, float(i)], i < 2) for i in range(12)]
    assert mined(spark, rows, "int", negatives.Shape(4, 5, 2)) == plainly(rows)
