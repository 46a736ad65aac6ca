"""Hard negatives against a plain scan of all pairs."""

import random

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from corvella.llm import negatives, queries

SF = "/root/testdata/sf0.01"


def plain(rows, positives=5, most=3, low=50, high=95):
    """rows: (id, label, whole numbers, is anchor); all results, sorted."""
    out = []
    for at, (a, label, x, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(-int(np.dot(x, y)), i, other) for j, (i, other, y, _) in enumerate(rows) if j != at and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            s = -s
            fits = sorted((n, i) for n, i, other in scored if other != label and low * s <= -100 * n <= high * s)
            out += [(a, p, k + 1, i, s, -n) for k, (n, i) in enumerate(fits[:most])]
    return sorted(out)


def mined(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, y, [v / 256 for v in x], a) for i, y, x, a in rows], "vec_id long, label int, embedding array<double>, a boolean").repartition(parts)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("a"), F.col("label"), **kw).collect())


@pytest.mark.parametrize("name", ["op11_negatives"])
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


@pytest.mark.parametrize("dims,seed", [(1, 0), (2, 1), (5, 2), (16, 3)])
def test_equals_plain_scan(spark, dims, seed, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "SIDE", 2)
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dims))
    x = np.floor(256 * (centres[r.integers(0, 4, 300)] + 0.4 * r.normal(size=(300, dims)))).astype(int)
    x[100:180] = x[100]  # a large group of copies: ties
    rows = [(i, int(r.integers(0, 3)), x[i].tolist(), i % 11 == 0) for i in range(300)]
    assert mined(spark, rows) == plain(rows)


def test_windows_and_few_candidates(spark):
    rows = [(1, 0, [10, 0], True), (2, 0, [10, 0], False), (3, 1, [5, 0], False), (4, 1, [9, 0], False), (5, 1, [10, 0], False), (6, 1, [4, 0], False), (7, 1, [9, 0], False), (8, 2, [-3, 0], True), (9, 2, [3, 1], False), (10, 3, [0, 7], True), (11, 3, [7, 0], False)]
    got = mined(spark, rows)
    assert got == plain(rows)
    assert [r for r in got if r[0] == 1] == [(1, 2, 1, 4, 100, 90), (1, 2, 2, 7, 100, 90), (1, 2, 3, 11, 100, 70)]
    assert not [r for r in got if r[0] == 8]  # a negative positive score has an empty window
    assert [r for r in got if r[0] == 10] == [(10, 11, i, i, 0, 0) for i in (1, 2, 3)]  # a zero score allows zero scores


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (50, 2, [0.8, 0.4]), (1, 1, [0.9, 0.5]), (2, 2, [0.7, 0.4]), (3, 2, [0.7, 0.4]), (3, 2, [0.7, 0.4]), (4, None, [0.7, 0.4]), (None, 2, [0.7, 0.4]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [None, 1.0]), (8, 2, [inf, 1.0]), (9, 2, []), (10, 2, [1.0]), (100, 3, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    for c in ("row", "codes", "levels", "anchor", "length", "score"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, F.col("label")).collect())
    good = [(i, y, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), i % 50 == 0) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    assert got == plain(good) and {r[0] for r in got} == {0}
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_large_numbers(spark):
    r = random.Random(4)
    rows = [(i, i % 3, [r.randrange(-(10**7), 10**7) for _ in range(6)], i % 5 == 0) for i in range(120)]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="scores"):
        mined(spark, [(0, 0, [2**29, 0], True)])


def test_bounds_hold_and_rule_out():
    r = np.random.default_rng(5)
    x = np.floor(40 * r.normal(size=(3000, 64))).astype(np.int64)
    cells = negatives.Cells(x[:1000], x.min(0), x.max(0))
    codes, a = cells.codes(x), x[::100]
    assert codes.shape == (3000, 32)
    low, high = negatives.bounds(cells.tables(a), codes)
    s = a @ x.T
    assert (low <= s).all() and (s <= high).all()
    tenth = np.sort(s, axis=1)[:, -10]
    assert (high >= tenth[:, None]).mean() < 0.2  # most rows are ruled out unread


def test_results_do_not_follow_partitions(spark):
    r = np.random.default_rng(6)
    rows = [(i, int(r.integers(0, 2)), np.floor(30 * r.normal(size=8)).astype(int).tolist(), i % 9 == 0) for i in range(200)]
    assert mined(spark, rows, 1) == mined(spark, rows, 13) == plain(rows)
