import numpy as np
from pyspark.sql import functions as F

from peakloom.llm.mixing import DOMAINS, Descent, domain_posteriors, fit_on, fit_rates, keep_mixed, mix_rates


def brute(n, p, targets, mu, steps=20_000):
    """The same objective by plain projected gradient, in one array."""
    total, r = n.sum(), np.ones(len(n))
    for _ in range(steps):
        slope = ((n * r) @ p - targets) / total
        r = np.maximum(0, r - 0.9 * (p @ slope + mu * (r - 1)))
    return r


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    n, p = rng.integers(1, 500, 400), rng.dirichlet([0.4, 0.4, 0.2], 400)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens bigint, posteriors array<double>").repartition(5)
    for weights in (None, {0: 0.7, 1: 0.3}):
        clean = n @ p * [1, 1, 0]
        targets = clean if weights is None else np.array([0.7, 0.3, 0]) * clean.sum()
        got = fit_rates(table, weights, mu=0.05, rounds=40, tolerance=1e-9).rates(p)
        want = brute(n, p, targets, 0.05, 4000)
        assert np.abs(got - want).max() < 1e-2
    few = fit_rates(table, {0: 0.7, 1: 0.3}).rates(p)
    assert np.abs((n * few) @ p - targets).max() < 0.05 * n.sum()
    assert (Descent(0.1, 1.0).rates(p) == 1).all()


def test_mixing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_on(docs, labels, max_rows=2500)
    held = [r[0] for r in labels.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").offset(2500).collect()]
    told = domain_posteriors(docs, model).join(labels.filter(F.col("doc_id").isin(held)), "doc_id").collect()
    toxic = np.array([r.toxic for r in told])
    guess = np.array([int(np.argmax(r.posteriors)) == 2 for r in told])
    assert (guess & (toxic == 0)).mean() < 0.005 and (guess & (toxic == 1)).sum() > 0.7 * toxic.sum()  # some labels say toxic of texts without a toxic word
    rated = mix_rates(docs, labels).join(labels, "doc_id").collect()
    clean, bad = [r.copies for r in rated if not r.toxic], [r.copies for r in rated if r.toxic]
    assert np.mean([c == 1 for c in clean]) > 0.98 and np.mean([c == 0 for c in bad]) > 0.7
    kept = keep_mixed(docs, labels)
    assert kept.columns == docs.columns and 0.85 * docs.count() < kept.count() < 1.02 * docs.count()


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "c " * 5000), (3, "c"), (4, " ,. ")], "doc_id bigint, text string").withColumn("rate", F.lit("x"))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (9, 1, 1), (None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = mix_rates(odd, labels).collect()
    assert len(got) == 6 and all(abs(sum(r.posteriors) - 1) < 1e-9 for r in got) and {r.rate for r in got if r.n_tokens == 0} == {1.0}
    assert sorted(r.n_tokens for r in got) == [0, 0, 0, 1, 2, 5000]
    assert mix_rates(odd.limit(0), labels).count() == 0 and mix_rates(odd, labels.limit(0)).count() == 6
    assert keep_mixed(odd, labels.limit(0)).columns == odd.columns and len(DOMAINS) == 3


def test_rare_toxic_texts_go(spark):
    rng = np.random.default_rng(2)
    for share in (0.002, 0.005):
        n, clean = rng.integers(1, 500, 8000), rng.beta(4, 2, 8000) * (1 - 0.4 * share)
        p = np.stack([clean, 1 - 0.4 * share - clean, np.full(8000, 0.4 * share)], 1)
        p[: int(8000 * share * 0.6)] = [0.025, 0.025, 0.95]
        table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens bigint, posteriors array<double>").repartition(4)
        rates = fit_rates(table, None).rates(p)
        told = p[:, 2] > 0.5
        assert rates[told].max() < 0.01 and np.abs(rates[~told] - 1).max() < 0.05
        # whole texts, more of them than the bounded sample of labels
        words, rows = [f"w{i}" for i in range(300)], []
        for i in range(6000):
            toxic, good = i % int(1 / share) == 7, i % 3 > 0
            rows.append((i, " ".join(rng.choice(words, 12)) + (" vile scum" if toxic else " sound" if good else " junk"), int(good and not toxic), int(toxic)))
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
        labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id bigint, quality int, toxic int")
        kept = sorted(r.doc_id for r in keep_mixed(docs, labels).collect())
        assert kept == [r[0] for r in rows if not r[3]]


def test_query_is_whole_and_fit_reads_whole_texts(spark, sf):
    from peakloom.llm.queries import op7_soft_mixing

    rows = op7_soft_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    n, p, rate = (np.array([f(r) for r in rows]) for f in (lambda r: r.n_tokens, lambda r: (r.p_high, r.p_low, r.p_toxic), lambda r: r.rate))
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all() and all(r.copies == int(np.floor(r.rate + 0.5)) for r in rows)
    clean = ((n @ p) * [1, 1, 0]).sum()
    targets, total = np.array([0.85, 0.15, 0]) * clean, n.sum()
    scale = np.maximum(1, 0.1 * total / np.maximum(n @ p, targets))  # rare domains weigh as a tenth
    cost = lambda r: (scale * ((n * r) @ p - targets) ** 2).sum() / (2 * total**2) + 0.01 * (n * (r - 1) ** 2).sum() / (2 * total)
    best = np.ones(len(n))
    for _ in range(20_000):
        best = np.maximum(0, best - 0.2 * (p @ (scale * ((n * best) @ p - targets) / total) + 0.01 * (best - 1)))
    assert cost(best) <= cost(rate) < cost(best) + 1e-4 * cost(np.ones(len(n)))
    late = [(i, "filler " * 9000 + ("vile scum" if i % 2 else "sound fine")) for i in range(60)]  # what tells comes after 60,000 characters
    docs = spark.createDataFrame(late, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    told = {r.doc_id: int(np.argmax(r.posteriors)) for r in domain_posteriors(docs, fit_on(docs, labels)).collect()}
    assert told == {i: 2 * (i % 2) for i in range(60)}
