import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import exact_topk as topk
from peakloom.llm import hard_negatives as hard
from peakloom.llm import tiles

from .helpers import of, oracle


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumn("x", F.lit("clash")).withColumn("dim", F.lit(1)).repartition(3)


def whole(rows, factor):
    return {i: [math.floor(factor * c) for c in v] for i, v, *_ in rows}


def plain_topk(rows, factor, step, k):
    v, out = whole(rows, factor), []
    for q in v:
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def plain_hard(rows, factor, step):
    v, label, out = whole(rows, factor), {i: y for i, _, y in rows}, []
    for a in v:
        if a % step:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v[a], x)), i) for i, x in v.items() if i != a and len(x) == len(v[a]))
        for s, p in [(-s, i) for s, i in scores if label[i] == label[a]][:5]:
            fine = [(-t, i) for t, i in scores if label[i] != label[a] and 50 * s <= -100 * t <= 95 * s]
            out += [(a, p, r, i, s, t) for r, (t, i) in enumerate(fine[:3], 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for module in (topk, hard):
        monkeypatch.setattr(module, "ROWS", 30)
        monkeypatch.setattr(module, "QUERIES", 7)
        monkeypatch.setattr(module, "STEP", 4)
    monkeypatch.setattr(tiles, "RUN", 2)
    monkeypatch.setattr(tiles, "FAN", 3)


def test_tiles_and_trees(spark, small):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 5)), 1)
    x[100:200] = x[100]  # ties at every edge
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(0, 3, 400)))]
    df = table(spark, rows, "double")
    assert sorted(map(tuple, topk.exact_topk(df, df.filter("vec_id % 20 = 0"), k=9).collect())) == plain_topk(rows, 64, 20, 9)
    assert sorted(map(tuple, hard.hard_negatives(df, df.filter("vec_id % 10 = 0"), F.col("label")).collect())) == plain_hard(rows, 256, 10)


def test_near_copies_and_hot_label(spark, small):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 7)), rng.normal(size=(150, 7)) * 0.02 + 1])
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, rng.choice(4, 300, p=[0.7, 0.1, 0.1, 0.1])))]
    df = table(spark, rows, "double")
    assert sorted(map(tuple, hard.hard_negatives(df, df.filter("vec_id % 5 = 0"), F.col("label")).collect())) == plain_hard(rows, 256, 5)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e6])
def test_all_widths_are_exact(spark, scale):
    """Products in single and double precision and in 64 bits."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * scale).tolist(), i % 2) for i in range(60)]
    df = table(spark, rows, "double")
    assert sorted(map(tuple, topk.exact_topk(df, df.filter("vec_id % 20 = 0")).collect())) == plain_topk(rows, 64, 20, 20)
    if scale < 1e6:
        assert sorted(map(tuple, hard.hard_negatives(df, df.filter("vec_id % 7 = 0"), F.col("label")).collect())) == plain_hard(rows, 256, 7)
    assert tiles.as_exact(2**24) is np.float64 and tiles.as_exact(2**53) is np.int64


def test_odd_rows(spark):
    good = [(i * 10, [float(i % 5), 1.5, -0.26], i % 2) for i in range(12)] + [(200, [1.0], 0), (210, [2.0], 0), (220, [3.0], 1), (300, [-2.0, 0.0, 0.0], 1), (5, [], 0), (400, [], 1)]
    odd = [(7, None, 1), (20 * 50, [1.0, None, 2.0], 1), (2000, [float("nan")] * 3, 0), (3000, [float("inf")] * 3, 0), (None, [1.0] * 3, 1), good[3], good[3]]
    df = table(spark, good + odd, "double")
    assert sorted(map(tuple, topk.exact_topk(df, df.filter("vec_id % 20 = 0"), k=4).collect())) == plain_topk(good, 64, 20, 4)
    unlabelled = table(spark, good + odd + [(9, [9.0] * 3, None), (50 * 11, [9.0] * 3, None)], "double")
    assert sorted(map(tuple, hard.hard_negatives(unlabelled, unlabelled.filter("vec_id % 10 = 0"), F.col("label")).collect())) == plain_hard(good, 256, 10)
    for run in (lambda d, q: topk.exact_topk(d, q), lambda d, q: hard.hard_negatives(d, q, F.col("label"))):
        assert run(df.limit(0), df).count() == run(df, df.limit(0)).count() == 0
        with pytest.raises(ValueError, match="64 bits"):
            run(table(spark, [(0, [1e300, 1.0], 1)], "double"), df)
    far = spark.createDataFrame([(0, [1.0]), (0, [0.5]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert list(map(tuple, topk.exact_topk(far, far.filter("vec_id = 0")).collect())) == [(0, 1, 1, 32 * 128)]  # the least vector of a repeated id


def test_bounds_hold():
    """Estimates and residual norms enclose every exact product, whatever the codebooks."""
    rng = np.random.default_rng(3)
    for spread in (1, 1000, 2**25):
        x, a = (np.round(rng.normal(size=(n, 9)) * spread).astype(np.int64) for n in (500, 20))
        for books in (hard.fit_codebooks(x[:100]), hard.fit_codebooks(x[:3]), None):
            codes, rest = hard.encode(x, books)
            row = {"dim": 9, "n": 500, "kind": "int64", "ids": np.arange(500), "labels": np.zeros(500, np.int64), "x": x, "codes": codes.tobytes(), "rest": rest}
            near, off = hard.Coded(row, {9: books} if books else {}).bounds(a)
            exact = a @ x.T
            assert (near.astype(float) - off <= exact).all() and (exact <= near.astype(float) + off).all()
        codes, rest = hard.encode(x, hard.fit_codebooks(x))
        assert np.median(rest) < 0.35 * np.median(np.sqrt((x.astype(float) ** 2).sum(1)))  # and filter


@pytest.mark.parametrize("name", ["op12_exact_topk", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, sf, name):
    from peakloom.llm.queries import ORACLES, QUERIES

    got = of(QUERIES[name](spark, sf))
    assert got == oracle(ORACLES[name], sf) and got[1]
