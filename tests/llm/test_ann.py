import numpy as np
from pyspark.sql import functions as F

from peakloom.llm.additive_ann import encode, fit_codebooks, nearest


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        if q not in ids:
            continue
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("codes", F.lit(1))
    rows = df.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got, want = result(nearest(df, df.filter("vec_id % 100 = 0"), shortlist=200)), brute(ids, x, [i for i in ids if i % 100 == 0])
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.95 * 10 * len(hits)
    for q, pairs in got.items():
        for v, s in pairs:
            assert abs(s - np.sqrt(((x[ids.index(v)] - x[ids.index(q)]) ** 2).sum())) < 1e-12


def test_small_and_odd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)).astype(np.float32)
    x[5:30] = x[5]
    rows = [(i * 10, x[i].tolist()) for i in range(40)]
    odd = [(100, None), (1100, [0.0] * 5), (1200, [1.0, None, 0.0, 0.0, 0.0]), (1300, [1.0, float("nan"), 0.0, 0.0, 0.0]), (1400, [float("inf")] * 5), (1500, [1.0, 2.0]), (None, [1.0] * 5), rows[7]]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(3)
    want = brute([i for i, _ in rows], x.astype(np.float64), [0, 100, 200, 300])
    got = result(nearest(df, df.filter("vec_id % 100 = 0"), shortlist=12))
    assert {q: [v for v, _ in p] for q, p in got.items()} == {q: [v for v, _ in p] for q, p in want.items()}
    few = df.filter("vec_id in (0, 10, 20, 30)")
    assert len(result(nearest(few, few))[0]) == 3
    assert nearest(df.limit(0), df).count() == 0


def test_beam_beats_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    books = fit_codebooks(x, 6, 32)
    error = lambda beam: ((x - sum(b[encode(x, books, beam)[0][:, m]] for m, b in enumerate(books))) ** 2).sum()
    assert error(8) < error(1) < (x**2).sum()


def test_lists_and_queries_in_parts(spark, monkeypatch):
    from peakloom.llm import additive_ann

    monkeypatch.setattr(additive_ann, "ROWS", 40)
    monkeypatch.setattr(additive_ann, "QUERIES", 7)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 6)), rng.normal(size=(300, 6)) * 0.01 + 5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    got = result(nearest(df, df, books=4, size=8, probe=8))
    want = brute(list(range(700)), x, range(700))
    assert got.keys() == want.keys() and sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) > 0.97 * 7000


def test_query_against_brute_force(spark, sf):
    from peakloom.llm.queries import op1_additive_ann

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got, want = result(op1_additive_ann(spark, sf)), brute(ids, x, [i for i in ids if i % 100 == 0])
    assert got.keys() == want.keys() and sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_rows_far_from_zero_and_of_unlike_sizes(spark):
    """All but a few rows in one list, whose codes tell nothing; and all of them so far from 0 that single precision tells nothing."""
    rng = np.random.default_rng(8)
    small = rng.normal(size=(3000, 8))
    for x in (np.concatenate([rng.normal(size=(400, 8)) * 1e5, small]), small + 1e5):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(2)
        got, want = result(nearest(df, df.filter("vec_id % 100 = 0"))), brute(list(range(len(x))), x, range(0, len(x), 100))
        assert got.keys() == want.keys() and sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.99 * 10 * len(want)
