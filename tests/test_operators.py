"""Hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import cluster, factor, gram, intervals, relational, segment, stats, trees


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_overlap_and_points(spark):
    a = spark.createDataFrame([("c", 100, 200), ("c", 400, 500), ("d", 0, 9)], "chrom string, start long, end long")
    b = spark.createDataFrame([("c", 150, 450)], "chrom string, r_start long, r_end long")
    for size in (7, 100, 10_000):
        assert rows(intervals.overlap_join(a, b, ["chrom"], size).select("start"), "start") == [(100,), (400,)]
        assert rows(intervals.overlap_join(a, b, ["chrom"], size, how="left_semi").select("start"), "start") == [(100,), (400,)]
    rng = np.random.default_rng(0)
    l, r = ([(int(c), int(s), int(s + n)) for c, s, n in zip(rng.integers(0, 3, 60), rng.integers(0, 500, 60), rng.integers(0, 90, 60))] for _ in range(2))
    got = intervals.overlap_join(spark.createDataFrame([(*x, i) for i, x in enumerate(l)], "chrom long, start long, end long, i int"), spark.createDataFrame([(*x, j) for j, x in enumerate(r)], "chrom long, r_start long, r_end long, j int"), ["chrom"], 40)
    assert rows(got.select("i", "j"), "i", "j") == sorted((i, j) for i, (c, s, e) in enumerate(l) for j, (d, t, f) in enumerate(r) if c == d and s < f and t < e and s < e and t < f)


def test_intervals_of_all_lengths(spark):
    """From 1 to 10^9 and beyond, at any width of the lowest bins: the same pairs, and few rows from each interval."""
    rng = np.random.default_rng(1)
    make = lambda n: [(int(c), int(s), int(s + e)) for c, s, e in zip(rng.integers(0, 2, n), rng.integers(-(10**9), 2 * 10**9, n), (10.0 ** rng.uniform(0, 9.3, n)).astype(int))]
    l, r = make(120), make(150) + [(0, -(2**60), 2**60), (1, 5, 5), (0, 8**10, 2 * 8**10 + 1)]
    left = spark.createDataFrame([(*x, i) for i, x in enumerate(l)] + [(None, 0, 9, -1), (0, None, 9, -2)], "chrom long, start long, end long, i int")
    right = spark.createDataFrame([(*x, j) for j, x in enumerate(r)], "chrom long, r_start long, r_end long, j int")
    want = sorted((i, j) for i, (c, s, e) in enumerate(l) for j, (d, t, f) in enumerate(r) if c == d and s < f and t < e and t < f)
    for width in (1, 64, 10**6):
        assert rows(intervals.overlap_join(left, right, ["chrom"], width).select("i", "j"), "i", "j") == want
    assert rows(intervals.overlap_join(right, left, ["chrom"], left_on=("r_start", "r_end"), right_on=("start", "end")).select("i", "j"), "i", "j") == want
    assert rows(intervals.overlap_join(left, right, ["chrom"], how="left_semi").select("i"), "i") == sorted({(i,) for i, _ in want})
    points = left.select("chrom", F.col("start").alias("pos"), "i")
    met = intervals.point_in_interval_join(points, right, ["chrom"], low="r_start", high="r_end")
    assert rows(met.select("i", "j"), "i", "j") == sorted((i, j) for i, (c, s, _) in enumerate(l) for j, (d, t, f) in enumerate(r) if c == d and t <= s <= f)
    for width in (1, 64):
        own = intervals._own_bins(right.filter("r_start < r_end"), F.col("r_start"), F.col("r_end") - 1, width)
        assert own.groupBy("j").count().agg(F.max("count")).first()[0] <= 2 and len(intervals._levels(right, F.col("r_end") - F.col("r_start"), width)) <= 22
    none = right.limit(0)
    assert intervals.overlap_join(left, none, ["chrom"]).count() == intervals.point_in_interval_join(points, none, ["chrom"], low="r_start", high="r_end").count() == 0


def test_tiles_keep_null_groups_and_positions(spark):
    points = spark.createDataFrame([("a", 3, 0), (None, 7, 1), (None, 90, 2), ("b", 5, 3), ("a", None, 4), ("a", None, 5), (None, None, 6), ("a", 50, 7)], "g string, pos long, i int")
    marks = spark.createDataFrame([("a", 1), ("a", 60), (None, 8), (None, 200), ("c", 1)], "g string, anchor long")
    for tie in ("left", "right"):
        near = [rows(intervals.nearest_join(points, marks, ["g"], tie=tie, tile=t).select("i", "nearest", "distance"), "i") for t in (None, 10, 1000)]
        assert near[0] == near[1] == near[2] == [(0, 1, 2), (1, 8, -1), (2, 8, 82), (3, None, None), (7, 60, -10)]
    weights = [rows(intervals.local_weights(points, ["g"], reach=45, tile=t).select("i", "weight"), "i") for t in (None, 90, 1000)]
    assert weights[0] == weights[1] == weights[2] and weights[0][4:7] == [(4, None), (5, None), (6, None)] and len(weights[0]) == 8


def test_projections(spark):
    one = spark.createDataFrame([(100, 301, "+"), (0, 10, "-")], "s long, e long, strand string")
    start, end = intervals.recenter(F.col("s"), F.col("e"))
    assert rows(one.select(start, end), "s") == [(0, 18), (188, 213)]
    block = spark.createDataFrame([("+",), ("-",)], "strand string")
    lo, hi = intervals.project_interval(F.lit(1088), F.lit(1113), F.lit(1000), F.col("strand"), 1000)
    assert rows(block.select("strand", lo, hi, intervals.project_point(F.lit(1100), F.lit(1000), F.col("strand"))), "strand") == [("+", 1088, 1113, 100), ("-", 888, 913, -100)]
    lo, hi = intervals.absolute_bounds(F.lit(-50), F.lit(100), F.lit(1000), F.lit("-"))
    assert block.select(lo, hi).first() == (900, 1050)
    assert block.select(intervals.snap(F.lit(213))).first()[0] == 200
    bins = spark.createDataFrame([(x,) for x in (-500, -499, -50, -49, 50, 51, 500, 501)], "x int").select("x", intervals.bin_label(F.col("x"), [-500, -50, 50, 500]))
    assert [b for _, b in rows(bins, "x")] == [0, 1, 1, 2, 2, 3, 3, 4]


def test_coverage_merge_rebin(spark):
    df = spark.createDataFrame([("a", 0, 3, 2), ("a", 2, 5, 3)], "tf string, start long, end long, w int")
    at = lambda runs: [v for _, v in rows(intervals.densify(runs).select("pos", "value"), "pos")]
    assert at(intervals.coverage(df, ["tf"])) == [1, 1, 2, 1, 1]
    assert at(intervals.coverage(intervals.merge_intervals(df, ["tf"]), ["tf"])) == [1] * 5
    assert at(intervals.coverage(df, ["tf"], weight=F.col("w"))) == [2, 2, 5, 3, 3]
    whole = spark.createDataFrame([("a", 0, 2001)], "tf string, start long, end long")
    got = rows(intervals.rebin(intervals.coverage(whole, ["tf"]), ["tf"], 5, 400), "bin")
    assert len(got) == 400 and {v for _, _, v in got} == {5}


def test_windows(spark):
    pos = lambda *x: spark.createDataFrame([("a", p) for p in x], "tf string, pos long")
    assert [w for _, _, w in rows(intervals.local_weights(pos(0, 1500, 3001), ["tf"]), "pos")] == [0.5, 0.5, 1.0]
    assert [r.cluster for r in intervals.gap_clusters(pos(0, 12500, 25001), ["tf"]).orderBy("pos").collect()] == [0, 0, 1]
    marks = spark.createDataFrame([("a", 100), ("a", 200)], "tf string, anchor long")
    near = lambda tie: intervals.nearest_join(pos(150, 20, 260, 199), marks, ["tf"], tie=tie).orderBy("pos").select("nearest", "distance").collect()
    assert [tuple(r) for r in near("left")] == [(100, -80), (100, 50), (200, -1), (200, 60)]
    assert near("right")[1] == (200, -50)
    rng = np.random.default_rng(5)
    many = spark.createDataFrame([(f"g{rng.integers(3)}", int(p), i) for i, p in enumerate(rng.integers(-300, 3000, 300))], "tf string, pos long, i int")
    marks = spark.createDataFrame([(f"g{rng.integers(2)}", int(p)) for p in rng.integers(0, 2500, 15)], "tf string, anchor long")
    for tie in ("left", "right"):
        assert rows(intervals.nearest_join(many, marks, ["tf"], tie=tie, tile=170).select("i", "nearest", "distance"), "i") == rows(intervals.nearest_join(many, marks, ["tf"], tie=tie).select("i", "nearest", "distance"), "i")
    assert rows(intervals.local_weights(many, ["tf"], reach=40, tile=100).select("i", "weight"), "i") == rows(intervals.local_weights(many, ["tf"], reach=40).select("i", "weight"), "i")
    shifted = intervals.circular_shift(pos(5, 95, 99), ["tf"], "tf", "pos", 3, 1)
    assert shifted.groupBy("shuffle").count().filter("count = 3").count() == 3
    gaps = {tuple(sorted((b - a) % 100 for a, b in zip(p, p[1:] + p[:1]))) for p in ([r.pos for r in shifted.filter(F.col("shuffle") == k).orderBy("pos").collect()] for k in (1, 2, 3))}
    assert gaps == {(4, 6, 90)}


def test_statistics(spark):
    p = spark.createDataFrame([("g", x) for x in (0.01, 0.02, 0.03, 0.5)], "g string, p_value double")
    assert [round(q, 10) for _, _, q in rows(stats.benjamini_hochberg(p, ["g"]), "p_value")] == [0.04, 0.04, 0.04, 0.5]
    h = stats.hypergeometric(spark.createDataFrame([(3, 5, 4, 10), (1, 5, 2, 10), (0, 5, 4, 10)], "k long, n long, big_k long, big_n long")).collect()
    assert len(h) == 1 and abs(h[0].p_value - 66 / 252) < 1e-12 and abs(h[0].odds_ratio - 4.2) < 1e-12
    big = stats.hypergeometric(spark.createDataFrame([(60, 200, 300, 20_000)], "k long, n long, big_k long, big_n long")).first().p_value
    assert abs(big / (sum(math.comb(300, x) * math.comb(19_700, 200 - x) for x in range(60, 201)) / math.comb(20_000, 200)) - 1) < 1e-6
    t = spark.createDataFrame([("a", 10.0), ("a", 5.0), ("a", 0.0), ("b", 7.0), ("b", 7.0), ("c", 0.0), ("c", 0.0), ("d", float("nan"))], "r string, v double")
    assert [(r, v) for r, v, _ in rows(stats.tau(t, "r", "v"), "r")] == [("a", 0.75), ("b", 0.0), ("c", None)]
    ari = lambda a, b: stats.adjusted_rand(spark.createDataFrame(list(zip(a, b)), "a int, b int"), "a", "b").first().ari
    assert abs(ari([0, 0, 1, 1], [0, 1, 0, 1]) + 0.5) < 1e-12 and ari([0, 0, 1, 1], [1, 1, 0, 0]) == 1 and ari([0], [0]) == 1
    assert stats.auc(spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (None, 1)], "s double, y int"), "s", "y").first().auc == 0.875
    x = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0), ("k", 1.0, float("nan")), ("l", 1.0, 1.0), ("l", 2.0, 4.0), ("l", 3.0, 7.0)], "g string, x double, y double")
    assert rows(stats.pearson(x, ["g"], "x", "y", 2), "g") == [("k", None, 2), ("l", 1.0, 3)]
    assert rows(stats.ols(x, ["g"], "x", "y").select("g", "slope", "intercept"), "g") == [("k", None, None), ("l", 3.0, -2.0)]
    split = spark.createDataFrame([("a", u, e) for e, us in (("x", range(10)), ("y", [*range(6), 90, 91])) for u in us] + [("z", 100 + k, "q") for k in range(88)], "item string, unit int, e string")
    got = stats.split_half(split, "item", "unit", "e").filter("item = 'a'").first()
    assert {got.n_a, got.n_b} == {8, 10} and got.n_both == 6 and abs(got.raw - 0.675) < 1e-12 and abs(got.corrected - 0.7222) < 1e-4


def test_relational(spark):
    one = spark.createDataFrame([(0, 1, 2, None)], "a int, b int, c int, d int")
    assert one.select(*[relational.driver_class(F.col(c)) for c in "abcd"]).first() == ("no-driver", "single-driver", "multi-driver", "")
    n = [F.lit(float(x)) for x in (3, 4, 6, 10)]
    assert one.select(F.round(relational.jaccard(*n[:3]), 4), relational.lift(*n)).first() == (0.4286, 1.25)
    p = spark.createDataFrame([("t", 50, 5), ("t", -200, 9), ("t", 10, 7), (None, 1, 1)], "t string, c int, p int")
    assert rows(relational.path_strings(p, ["t"], "p", ["c"]), "t") == [("t", "9,7,5", 3)]
    with pytest.raises(ValueError):
        relational.assert_unique(p, ["t"])


def test_segments():
    s = segment.Segmenter()
    assert abs(s.unit - 0.0159577) < 1e-7 and abs((s.support - 0.5) * s.unit - 0.0239365) < 1e-7
    assert abs(segment.gaussian(np.eye(1, 301, 150)[0], 25).max() - s.unit) < 1e-5
    assert abs(segment.gaussian(np.ones(40), 25).min() - 1) < 1e-12
    assert segment.local_maxima(np.array([0, 1, 1, 1, 0, 2, 0, 3])).tolist() == [2, 5]
    x = np.array([0.0, 5, 1, 4, 0, 6, 5.5, 5.6, 0])
    assert segment.find_peaks(x, 1, 0, 1).tolist() == [1, 3, 5, 7] and segment.find_peaks(x, 1, 1, 1).tolist() == [1, 3, 5] and segment.find_peaks(x, 1, 0, 3).tolist() == [1, 5]
    offsets = np.array([-500, -498, -502, 300, 310, 305, 900])
    names = np.array(list("abcabdz"))
    for sign in (1, -1):
        got = s.modules(sign * offsets, names, np.array([300, 300, 0, 300, 0, 300, 900]), 250)
        assert [(round(sign * m["center"] / 10), m["n_supporting"], m["n_assigned"]) for m in got] == [(-50, 3, 2), (30, 3, 2)][::sign]
        assert all(m["low"] <= m["center"] <= m["high"] and m["width"] == m["high"] - m["low"] + 1 for m in got)


def test_density_and_grouped_modules(spark):
    rng = np.random.default_rng(7)
    for mode in ("reflect", "constant"):
        s = segment.Segmenter(mode=mode)
        o, w = np.concatenate([rng.integers(-1500, 1501, 30), [-1500, 1500, -1420]]), rng.random(33)
        assert np.allclose(s.density(o, w), segment.gaussian(np.bincount(o + 1500, w, minlength=3001), 25, mode), atol=1e-14)
    rows_ = [(a, f"t{rng.integers(4)}", int(o), int(rng.integers(600))) for a in range(30) for o in np.concatenate([rng.integers(-1600, 1600, 3), rng.normal(100, 15, 8).astype(int)])]
    got = segment.anchor_modules(spark.createDataFrame(rows_, "anchor_id long, tf string, offset int, score int"), "anchor_id", "tf").orderBy("anchor_id", "local_idx").collect()
    want = []
    for a in range(30):
        own = [r for r in rows_ if r[0] == a and abs(r[2]) <= 1500]
        for m in segment.Segmenter().modules(np.array([r[2] for r in own]), np.array([r[1] for r in own]), np.array([r[3] for r in own]), 250):
            want.append((a, m["local_idx"], m["low"], m["high"], m["center"], m["n_peaks"], m["n_supporting"]))
    assert [(r.anchor_id, r.local_idx, r.low, r.high, r.center, r.n_peaks, r.n_supporting) for r in got] == want and len(want) >= 25
    ids = [r.module_id for r in segment.module_ids(spark.createDataFrame(got), "anchor_id").orderBy("anchor_id", "local_idx").collect()]
    assert ids == list(range(len(want)))


def test_tiles_do_not_matter(spark):
    rng = np.random.default_rng(4)
    pts = [("c", int(p), f"t{rng.integers(6)}", int(rng.integers(1000))) for c in rng.integers(0, 60_000, 40) for p in c + rng.normal(0, 20, 8) if p > 0]
    df = spark.createDataFrame(pts, "chrom string, pos long, tf string, score int")
    found = [rows(segment.discover(df, "chrom", "tf", floor=2, tile=t).select("low", "high", "center", "n_peaks", "n_assigned"), "low") for t in (200_000, 3_000)]
    assert found[0] == found[1] and len(found[0]) > 10


def test_factors(spark):
    rng = np.random.default_rng(0)
    w, h = rng.random((60, 2)) * np.repeat(np.eye(2), 30, 0), np.kron(np.eye(2), np.ones(4)) + 0.01
    w2, h2, error = factor.guarded_nmf(w @ h, 2)
    assert error < 0.05 * np.linalg.norm(w @ h) and factor.best_match(h, h2).min() > 0.99
    df = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(w @ h) for j, v in enumerate(r)], "row int, col int, value double")
    vec = factor.vectors(df, "row", "col", "value", list(range(8)))
    hb, errors = factor.block_nmf(vec, "row", 2, 8, rounds=15)
    assert factor.best_match(h, hb).min() > 0.98 and errors[-1] < errors[0]
    dom = factor.transform(vec, "row", hb).orderBy("row").collect()
    assert len({r.dominant for r in dom[:30]}) == len({r.dominant for r in dom[30:]}) == 1 and dom[0].dominant != dom[40].dominant
    with pytest.raises(ValueError):
        factor.held_out_scores(w @ h, [1, 2])
    assert factor.held_out_scores(w @ h, [1, 2, 3])[1]["rmse"] < factor.held_out_scores(w @ h, [1, 2, 3])[0]["rmse"]
    assert factor.rank_auc(np.array([0.1, 0.4, 0.4, 0.8]), np.array([False, False, True, True])) == 0.875
    assert factor.medoid([h, h2, hb]) in (0, 1, 2) and factor.stability([h, h2, hb], 0)[0]["at_90"] == 1
    assert factor.collapsed(np.array([[1.0, 0], [2, 1]]), 1.0)


def test_clusters():
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [20, 5]])
    m = cluster.linkage(x)
    assert cluster.cut(m, 3).tolist() == [1, 1, 2, 2, 3] and sorted(cluster.leaves(m)) == [0, 1, 2, 3, 4]
    assert abs(m[0, 2] - 1) < 1e-12 and abs(m[2, 2] - np.sqrt(4 / 3 * ((10**2) + 4.5**2))) < 1e-9
    d = np.abs(np.subtract.outer([0, 1, 5, 6.0], [0, 1, 5, 6.0]))
    assert cluster.cophenetic(cluster.linkage(d, "average", True), d) > 0.9 and cluster.dispersion(np.array([[1.0, 0], [0, 1]])) == 1
    import itertools

    rng = np.random.default_rng(3)
    for n, k in ((4, 4), (3, 5), (5, 3), (6, 6)):
        c = rng.random((n, k))
        got = cluster.assign(c)
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(k), n)) if n <= k else min(sum(c[i, j] for j, i in zip(range(k), p)) for p in itertools.permutations(range(n), k))
        assert len(got) == min(n, k) and abs(sum(c[i, j] for i, j in got) - best) < 1e-9
    a = np.array([0, 0, 1, 1, 2, 2])
    assert abs(cluster.adjusted_mutual_information(a, a[::-1]) - 1) < 1e-9 and abs(cluster.adjusted_mutual_information(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) + 0.5) < 1e-6
    assert cluster.greedy_match(np.array([[0.9, 0.8], [0.85, 0.1]])) == [(0, 0, 0.9), (1, 1, 0.1)]


def test_fixed_sums_and_few_points():
    """Adding the kernel at points or the grid at taps is the same, bit by bit with fixed numbers."""
    rng = np.random.default_rng(4)
    for mode in ("reflect", "constant"):
        s = segment.Segmenter(reach=300, sigma=10, mode=mode, fixed=True)
        for n in (0, 1, 30, 79, 82, 500):
            o = rng.integers(-300, 301, n)
            w = 1 / rng.integers(1, 9, n)
            got = s.density(o, w)
            assert np.allclose(got, segment.gaussian(np.bincount(o + 300, w, minlength=601), 10, mode), atol=1e-5)
            turned = rng.permutation(n)
            assert (got == s.density(o[turned], w[turned])).all()
    wide = segment.Segmenter(reach=5, sigma=4, fixed=True)  # a kernel longer than the grid is mirrored more than once
    assert np.allclose(wide.density(np.array([0]), np.array([1.0])), segment.gaussian(np.eye(1, 11, 5)[0], 4), atol=1e-5)


def test_redetection(spark):
    """All shuffles at once find what each finds alone; counts by floor against plain ones; a shuffle without elements counts."""
    rng = np.random.default_rng(5)
    rows_ = [(c, f, int(p), int(x)) for c in ("a", "b") for f in range(6) for p, x in zip(rng.integers(0, 20_000, 12), rng.integers(0, 500, 12))]
    rows_ += [("a", f, 7_000 + f, 400) for f in range(6)] + [(None, f, 90 + f, 400) for f in range(4)] + [("a", 1, None, 400)]
    df = spark.createDataFrame(rows_, "chrom string, tf int, pos long, score int")
    how = {"min_score": 250, "floor": 0, "reach": 500, "tile": 4_000, "segmenter": segment.Segmenter(sigma=25, mode="constant", fixed=True)}
    got = segment.redetected(df, "chrom", "tf", 3, 1, **how)
    each = rows(got.select("shuffle", "chrom", "low", "high", "n_assigned"), "shuffle", "chrom", "low")
    moved = intervals.circular_shift(df, ["tf"], "chrom", "pos", 3, 1)
    for k in range(4):
        alone = segment.discover(df if k == 0 else moved.filter(F.col("shuffle") == k).drop("shuffle"), "chrom", "tf", **how)
        assert rows(alone.select("chrom", "low", "high", "n_assigned"), "chrom", "low") == [r[1:] for r in each if r[0] == k]
    assert any(r[:2] == (0, None) for r in each) and any(r[0] == 0 and r[4] == 6 for r in each)
    found = spark.createDataFrame([(0, 3), (0, 5), (0, 9), (1, 3), (1, 1), (3, 4)], "shuffle int, n_assigned long")
    assert rows(segment.redetection_fdr(found, 3, 2, 6), "floor") == [
        (f, o, m, pytest.approx(np.std(n, ddof=1)), m / o) for f, o, n, m in [(2, 3, [1, 0, 1], 2 / 3), (3, 3, [1, 0, 1], 2 / 3), (4, 2, [0, 0, 1], 1 / 3), (5, 2, [0, 0, 0], 0.0), (6, 1, [0, 0, 0], 0.0)]
    ]


def test_blocked_sums(spark):
    """Masked products in blocks of a few rows and columns against plain sums; missing, repeated, flat and unnamed cells."""
    rng = np.random.default_rng(7)
    x = np.where(rng.random((23, 31)) < 0.3, np.nan, rng.normal(size=(23, 31)) * 10 + 1e6)
    x[4], x[5, 3:] = 0.1, np.nan
    cells = [(f"r{i}", j, float(x[i, j])) for i in range(23) for j in range(31) if not (np.isnan(x[i, j]) and j % 2)]
    cells += [(None, 1, 1.0), ("r1", None, 1.0), ("lone", 99, 1.0), ("r2", 5, None)] + [c for c in cells if c[0] == "r3"]
    df = spark.createDataFrame(cells, "g string, t int, v double").withColumn("n", F.lit(1))
    want = {}
    for i in range(23):
        for j in range(23):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            n = int(both.sum())
            if n >= 3:
                a, b = x[i, both] - x[i, both].mean(), x[j, both] - x[j, both].mean()
                flat = np.ptp(x[i, both]) == 0 or np.ptp(x[j, both]) == 0
                want[f"r{i}", f"r{j}"] = (None if flat else float(a @ b / np.sqrt((a @ a) * (b @ b))), n)
    for size in ({"rows": 5, "columns": 7}, {}):
        got = {(r.a, r.b): (r.r, r.n) for r in gram.pairwise_pearson(df, "g", "t", "v", **size).collect()}
        assert got.keys() == {k for k in want if k[0] < k[1]}
        for k, (r, n) in got.items():
            assert n == want[k][1] and (r is None) == (want[k][0] is None) and (r is None or abs(r - want[k][0]) < 1e-9)
    left = df.filter("g in ('r1', 'r7', 'r4')")
    got = {(r.a, r.b): (r.r, r.n) for r in gram.pairwise_pearson(left, "g", "t", "v", other=df, rows=5, columns=7).collect()}
    assert got.keys() == {k for k in want if k[0] in ("r1", "r7", "r4")} and all(n == want[k][1] and (r is None or abs(r - want[k][0]) < 1e-9) for k, (r, n) in got.items())
    assert gram.pairwise_pearson(df.limit(0), "g", "t", "v").count() == 0


def test_dominant_match(spark):
    """By joins as by a plain loop, with ties, missing pairs and more rows than columns."""
    assert cluster.greedy_match(np.array([[0.9, 0.1, 0], [0.85, 0.8, 0], [0, 0.82, 0.1]])) == [(0, 0, 0.9), (1, 1, 0.8), (2, 2, 0.1)]
    rng = np.random.default_rng(11)
    for n, m, levels in ((9, 9, 4), (12, 5, 1000), (7, 3, 2)):
        x = rng.integers(0, levels, (n, m)) / levels
        df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(m)] + [(0, 0, -1.0), (None, 1, 9.0), (1, None, 9.0), (50, 1, None)], "a int, b int, s double")
        assert rows(cluster.dominant_match(df), "a") == sorted(cluster.greedy_match(x))
    few = spark.createDataFrame([("p", "x", 0.5), ("q", "x", 0.7), ("r", "y", float("nan"))], "a string, b string, s double")
    assert rows(cluster.dominant_match(few), "a") == [("q", "x", 0.7)] and cluster.dominant_match(few.limit(0)).count() == 0


def test_ami_from_counts(spark):
    rng = np.random.default_rng(12)
    cases = [(rng.integers(0, k, n), rng.integers(0, j, n)) for n, k, j in ((60, 3, 4), (200, 9, 2), (500, 40, 30))]
    same = rng.integers(0, 5, 90)
    cases += [(same, same), (same, np.where(rng.random(90) < 0.2, 0, same)), (np.zeros(8, int), np.zeros(8, int)), (np.zeros(8, int), np.arange(8)), (np.repeat([0, 1], [4000, 30]), np.repeat([0, 1], [4010, 20]))]
    for a, b in cases:
        df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(None, 1), (1, None)], "a int, b int")
        got = stats.adjusted_mutual_information(df, "a", "b").first()
        assert got.n == len(a) and got.ami == pytest.approx(cluster.adjusted_mutual_information(a, b), abs=1e-9)


@pytest.mark.parametrize("method", ["ward", "average"])
def test_reciprocal_trees(spark, method):
    """The kernel's heights, clusters and leaves, one merge at a time; with ties the same heights."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(21, 4))
    merges = cluster.linkage(x, method)
    cells = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "i int, j int, v double")
    apart = gram.distances(cells, "i", "j", "v", rows=8)
    assert apart.count() == 210
    got = trees.linkage(apart, method)
    held = got.orderBy("height").collect()
    assert np.allclose([r.height for r in held], merges[:, 2]) and [r["size"] for r in held] == merges[:, 3].astype(int).tolist() and len({r.round for r in held}) < 20
    items = spark.range(21).select(F.col("id").cast("int").alias("item"))
    roots = dict(map(tuple, trees.cut(items, got, 5).collect()))
    labels = cluster.cut(merges, 5)
    assert [roots[i] for i in range(21)] == [int(np.flatnonzero(labels == labels[i])[0]) for i in range(21)]
    place = [r.item for r in trees.leaf_order(items, got).orderBy("place").collect()]
    assert sorted(place) == list(range(21))
    for k in range(2, 20):  # every cluster's leaves stand together
        own = cluster.cut(merges, k)[place]
        assert (own[1:] != own[:-1]).sum() == k - 1
    high = {(r.a, r.b): r.height for r in trees.cophenetic(apart, got).collect()}
    groups, n = {i: [i] for i in range(21)}, 21
    for k, (i, j, height, _) in enumerate(merges):
        a, b = groups.pop(int(i)), groups.pop(int(j))
        assert all(np.isclose(high.get((p, q), high.get((q, p), np.nan)), height) for p in a for q in b)
        groups[n + k] = a + b
    even = np.array([[0, 1, 1, 3], [1, 0, 1, 3], [1, 1, 0, 1], [3, 3, 1, 0]], float)
    ties = spark.createDataFrame([(b, a, float(even[a, b])) for a in range(4) for b in range(a)] + [(0, 0, 0.0)], "a int, b int, d double")
    assert np.allclose(sorted(r.height for r in trees.linkage(ties, method).collect()), cluster.linkage(even, method, distances=True)[:, 2])
    none = trees.linkage(ties.limit(0), method)
    assert none.count() == 0 and trees.cut(items, none, 3).filter("item = root").count() == 21


def test_profile_clusters_on_tables(spark):
    rng = np.random.default_rng(14)
    x = np.abs(rng.normal(size=(18, 9))) + 5 * np.eye(9)[rng.integers(0, 4, 18) * 2]
    x[3] *= 1e-4  # below the floor
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(None, x[0].tolist())], "i int, x array<double>")
    kept, labels = cluster.profile_clusters(x / x.max(), 4, sigma=1.0)
    assert rows(trees.profile_clusters(df, "i", 4, sigma=1.0), "i") == [(int(i), int(c)) for i, c in zip(kept, labels)]


def test_gate_and_labels(spark):
    elements = spark.createDataFrame([("c", 100, 200, 150), ("c", 20_000, 20_100, 20_050)], "chrom string, low long, high long, center long")
    modules = spark.createDataFrame([(0, "c", 140, 180, 160, 12), (1, "c", 190, 700, 650, 12), (2, "c", 9_000, 9_100, 9_050, 3), (3, "d", 0, 9, 4, 20)], "module_id long, chrom string, low long, high long, center long, n_assigned long")
    got = {r.support: (r.n, round(r.recovered, 3)) for r in segment.gate(elements, modules, "chrom", 50, 11).collect()}
    assert got == {"at floor": (3, 0.667), "below": (1, 0.0)}
    marks = spark.createDataFrame([("c", 140)], "chrom string, anchor long")
    labels = segment.label_elements(elements, marks, "chrom").orderBy("low").collect()
    assert [(r.distance, r.stratum, r.cluster, r.cluster_size) for r in labels] == [(10, "promoter", 0, 1), (19_910, "distal", 1, 1)]


def test_streams(spark, tmp_path):
    from peakloom.streaming.events import drained_counts, drained_sessions, split_stream

    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    assert drained_counts(spark, path, 20).agg(F.sum("n")).first()[0] == events.filter("value >= 20").count()
    got = drained_sessions(spark, path, "1 day", "1 hour")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
    assert got.subtract(batch).isEmpty()
    split_stream(spark, path, str(tmp_path / "halves"))
    halves = spark.read.parquet(str(tmp_path / "halves"))
    assert halves.count() == events.count() and halves.groupBy("user_id").agg(F.count_distinct("half").alias("h")).filter("h > 1").isEmpty()


def test_hypergeometric_is_exact(spark):
    from fractions import Fraction

    cases = [(k, n, big_k, big_n) for k, n, big_k, big_n in [(1, 5, 3, 10), (3, 3, 3, 3), (2, 40, 50, 90), (30, 40, 50, 90), (10, 40, 50, 90), (5, 5, 80, 90), (200, 1000, 2000, 9000), (260, 1000, 2000, 9000), (120, 1000, 2000, 9000)]]
    got = stats.hypergeometric(spark.createDataFrame(cases, "k bigint, n bigint, big_k bigint, big_n bigint")).collect()
    for r in got:
        total = math.comb(r.big_n, r.n)
        want = sum(Fraction(math.comb(r.big_k, x) * math.comb(r.big_n - r.big_k, r.n - x), total) for x in range(r.k, min(r.n, r.big_k) + 1) if r.n - x <= r.big_n - r.big_k)
        assert abs(r.p_value - float(want)) < 1e-9 * max(1e-3, float(want)) + 1e-12, r
    big = spark.createDataFrame([(50_500, 10**6, 5 * 10**6, 10**8)], "k bigint, n bigint, big_k bigint, big_n bigint")
    assert 0 < stats.hypergeometric(big).first().p_value < 0.05


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    rows_ = [(str(g), float(v)) for g in range(3) for v in rng.integers(0, 40, 200 + g)] + [("1", None), ("1", float("nan")), ("x", 5.0), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows_, "g string, v double")
    got = {r.g: r for r in stats.quantiles(df, ["g"], "v", a=0.0, b=0.25, c=0.5, d=0.9, e=1.0).collect()}
    for g in ("0", "1", "2", "x", None):
        v = [x for h, x in rows_ if h == g and x is not None and x == x]
        assert np.allclose([got[g][c] for c in "abcde"], np.quantile(v, [0, 0.25, 0.5, 0.9, 1]))
    assert stats.quantiles(df, [], "v", m=0.5).first().m == np.median([x for _, x in rows_ if x is not None and x == x])
    ranks = {r.v: r["rank"] for r in stats.average_ranks(df.filter("g = '0'"), "v").collect()}
    v = sorted(x for h, x in rows_ if h == "0")
    assert all(ranks[x] == np.mean([i + 1 for i, y in enumerate(v) if y == x]) for x in v)


def test_tiles_change_nothing(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(str(g), int(s), int(s + n), int(w)) for g, s, n, w in zip(rng.integers(0, 2, 300), rng.integers(0, 9000, 300), rng.integers(1, 200, 300), rng.integers(1, 9, 300))], "tf string, start long, end long, w int")
    for tile in (50, 700, 10**6):
        for f in (lambda t: intervals.coverage(df, ["tf"], tile=t), lambda t: intervals.coverage(df, ["tf"], weight=F.col("w"), tile=t), lambda t: intervals.merge_intervals(df, ["tf"], tile=t)):
            assert rows(f(tile), "tf", "start") == rows(f(None), "tf", "start")
        clusters = lambda t: intervals.gap_clusters(df, ["tf"], "start", 60, tie=["end", "w"], tile=t)
        assert sorted(map(tuple, clusters(tile).collect())) == sorted(map(tuple, clusters(None).collect()))


def test_heavy_rows_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(r), int(i)) for r, i in zip(rng.integers(0, 4, 400), rng.integers(0, 60, 400))], "r int, i int")
    want = rows(relational.pair_cooccurrence(df, "r", "i", 1), "item_a", "item_b")
    monkeypatch.setattr(relational, "HEAVY", 7)
    assert rows(relational.pair_cooccurrence(df, "r", "i", 1), "item_a", "item_b") == want


def test_dense_steps_refuse_large_tables(spark, monkeypatch):
    monkeypatch.setattr(cluster, "DENSE", 10)
    with pytest.raises(ValueError):
        cluster.dense(spark.range(11), "x")


def test_module_and_matrix_ids(spark):
    found = spark.createDataFrame([(a, i) for a in (-3, 5, 200_000, 70_000) for i in range(3)], "anchor_id long, local_idx int")
    got = rows(segment.module_ids(found, "anchor_id", tile=1000), "anchor_id", "local_idx")
    assert [r[2] for r in got] == list(range(12))
    modules = spark.createDataFrame([(m, m % 3) for m in range(0, 900, 7)], "m long, n int")
    cells = relational.matrix_rows(modules, modules.withColumn("i", F.lit("x")), "m", "i", "n", tile=64)
    kept = [m for m in range(0, 900, 7) if m % 3]
    assert [(r[0], r[1]) for r in rows(cells, "row_id")] == list(enumerate(kept))


def test_masked_fit_in_blocks(spark):
    rng = np.random.default_rng(5)
    w, h = rng.random((300, 2)) * (rng.random((300, 2)) < 0.6), rng.random((2, 12)) * (rng.random((2, 12)) < 0.7)
    x = w @ h
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "r long, x array<double>").repartition(3)
    keys = np.array([r[0] for r in df.select(F.xxhash64("r")).collect()])
    hidden = factor._hidden(keys, 12, 0.1, 1)
    assert 0.07 < hidden.mean() < 0.13 and (hidden == factor._hidden(keys, 12, 0.1, 1)).all() and (hidden != factor._hidden(keys, 12, 0.1, 2)).any()
    fit = factor.block_masked_nmf(df, "r", 2, 12, fold=1, rounds=15)
    out = factor.held_out_entries(df, "r", fit, fold=1)
    got = out.toPandas()
    assert len(got) == hidden.sum() and np.sqrt(((got.score - got.value) ** 2).mean()) < 0.3 * np.sqrt((got.value**2).mean())
    auc = stats.auc(out.withColumn("y", (F.col("value") > 1e-9).cast("int")), "score", "y").first().auc
    assert auc > 0.9 and abs(auc - factor.rank_auc(got.score.to_numpy(), (got.value > 1e-9).to_numpy())) < 1e-9


def test_block_fit_refuses_collapse(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "r long, x array<double>")
    with pytest.raises(RuntimeError):
        factor.block_nmf(one, "r", 3, 2, rounds=3, extra=1)


def test_stacked_fits_equal_single_ones(spark):
    from peakloom.operators import stacks

    rng = np.random.default_rng(21)
    x = rng.random((120, 3)) * (rng.random((120, 3)) < 0.5) @ rng.random((3, 10))
    x = x + 0.01 * rng.random(x.shape)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "r long, x array<double>, half int").repartition(3).cache()
    fits = [stacks.Fit(2), stacks.Fit(3, 4), stacks.Fit(2, 1, fold=1), stacks.Fit(2, 0, part=1)]
    got = stacks.stacked_nmf(stacks.keyed(df, "r", "half"), fits, 10, rounds=12)
    assert list(got) == fits and stacks.sound(got).keys() == set(fits)
    for fit in fits[:2]:
        h, errors = factor.block_nmf(df, "r", fit.k, 10, fit.seed, 12)
        assert np.allclose(got[fit].h, h) and np.allclose(got[fit].errors, errors)
    assert np.allclose(got[fits[2]].h, factor.block_masked_nmf(df, "r", 2, 10, fold=1, seed=1, rounds=12))
    assert np.allclose(got[fits[3]].h, factor.block_nmf(df.filter("half = 1"), "r", 2, 10, 0, 12)[0])
    named = stacks.labels(stacks.keyed(df, "r", "half"), {f: got[f].h for f in fits[:2]})
    for n, fit in enumerate(fits[:2]):
        want = {r[0]: r[1] for r in factor.transform(df, "r", got[fit].h).select(F.xxhash64("r"), "dominant").collect()}
        assert {r.key: r.label for r in named.filter(F.col("fit") == n).collect()} == want
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "r long, x array<double>")
    bad = stacks.stacked_nmf(stacks.keyed(one, "r"), [stacks.Fit(3), stacks.Fit(1)], 2, rounds=3, extra=1)
    assert bad[stacks.Fit(3)].fault == "collapsed" and bad[stacks.Fit(1)].fault is None
    with pytest.raises(RuntimeError):
        stacks.sound(bad)
    none = stacks.stacked_nmf(stacks.keyed(one.limit(0), "r"), [stacks.Fit(2)], 2)
    assert none[stacks.Fit(2)].errors == [] and none[stacks.Fit(2)].h.shape == (2, 2)


def test_held_out_scores_of_blocks(spark):
    from peakloom.operators import stacks

    rng = np.random.default_rng(6)
    x = (rng.random((150, 2)) * (rng.random((150, 2)) < 0.6)) @ (rng.random((2, 12)) * (rng.random((2, 12)) < 0.7))
    rows_ = stacks.keyed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "r long, x array<double>").repartition(2), "r").cache()
    with pytest.raises(ValueError):
        stacks.held_out_scores(rows_, [1, 2], 12)
    got = {r.k: r for r in stacks.held_out_scores(rows_, [1, 2, 3], 12, folds=2, rounds=15).collect()}
    fits = {f: one.h for f, one in stacks.stacked_nmf(rows_, [stacks.Fit(k, f, fold=f) for k in (1, 2, 3) for f in range(2)], 12, 15).items() if not one.fault}
    frame = stacks.held_out(rows_, fits).toPandas()
    for k, part in frame.groupby("k"):
        folds = [p for _, p in part.groupby("fold")]
        rmse = [np.sqrt(((p.score - p.value) ** 2).mean()) for p in folds]
        auc = [factor.rank_auc(p.score.to_numpy(), (p.value > 0).to_numpy()) for p in folds]
        assert got[k].folds == len(folds) and np.isclose(got[k].rmse, np.mean(rmse)) and np.isclose(got[k].rmse_sd, np.std(rmse))
        assert np.isclose(got[k].auc, np.mean(auc)) and np.isclose(got[k].auc_sd, np.std(auc))
    assert got[2].rmse < got[1].rmse


def test_fits_of_rows_that_are_nearly_alike(spark):
    """Every random start collapses, in the stack and in blocks; rows far apart give fits whose components all win rows."""
    from peakloom.operators.stacks import Fit, keyed, labels, sound, stacked_nmf

    x = np.random.default_rng(1).poisson(6e5, (15, 6)).astype(float)
    rows_ = spark.createDataFrame([(f"r{i}", r.tolist(), i % 2) for i, r in enumerate(x)], "row string, x array<double>, half int")
    data = keyed(rows_, "row", "half")
    fits = [Fit(3, 0), Fit(3, 1), Fit(2, 0, part=1)]
    got = sound(stacked_nmf(data, fits, 6, extra=1))
    won = {(r["fit"], r["label"]) for r in labels(data, got).collect()}
    assert won == {(n, c) for n, fit in enumerate(fits) for c in range(1, fit.k + 1)}
    h, errors = factor.block_nmf(rows_, "row", 3, 6, extra=0)
    assert h.shape == (3, 6) and errors[-1] < 0.01 * np.linalg.norm(x)


def test_fits_that_collapse_from_rows_far_apart_too(spark):
    """Of few rows, a component can lose its last one in late rounds from every start: such fits end before that."""
    from peakloom.operators.stacks import Fit, keyed, labels, sound, stacked_nmf

    g = np.random.default_rng(2086)
    g.choice(5), g.choice(4)
    x = g.poisson(g.poisson(133 * 6.0, (6, 6)) * 30.0).astype(float)
    data = keyed(spark.createDataFrame([(f"r{i}", r.tolist()) for i, r in enumerate(x)], "row string, x array<double>").coalesce(1), "row")
    got = sound(stacked_nmf(data, [Fit(3)], 6, extra=1))
    assert {r["label"] for r in labels(data, got).collect()} == {1, 2, 3}


def test_fits_that_collapse_in_the_first_round(spark):
    """Ten rows that are nearly alike, of which each start loses a component at once: the rows far apart are the fit, in the stack and in blocks."""
    from peakloom.operators.stacks import Fit, keyed, labels, sound, stacked_nmf

    x = np.random.default_rng(418).poisson(2.4e5, (10, 6)).astype(float)
    rows_ = spark.createDataFrame([(f"r{i}", r.tolist()) for i, r in enumerate(x)], "row string, x array<double>").coalesce(1)
    data = keyed(rows_, "row")
    fitted = stacked_nmf(data, [Fit(3)], 6, extra=1)
    got = sound(fitted)
    assert {r["label"] for r in labels(data, got).collect()} == {1, 2, 3}
    assert len(fitted[Fit(3)].errors) == 1 and fitted[Fit(3)].errors[0] < 0.01 * np.linalg.norm(x)
    h, errors = factor.block_nmf(rows_, "row", 3, 6, extra=0)
    assert len(errors) == 1 and np.allclose(h, got[Fit(3)])


def test_stability_of_brands_that_are_nearly_alike(spark, monkeypatch):
    """Four of the five seeds lose a component from each start."""
    from peakloom.plans import queries

    x = np.random.default_rng(418).poisson(2.4e5, (10, 6)).astype(float)
    brands = spark.createDataFrame([(f"r{i}", r.tolist()) for i, r in enumerate(x)], "brand string, x array<double>").coalesce(1)
    monkeypatch.setattr(queries, "brand_types", lambda *_: (brands, list("abcdef")))
    got = rows(queries.stability(spark, ""), "component")
    assert [r[0] for r in got] == [1, 2, 3] and all(0.9 < r[2] <= r[1] <= 1 + 1e-9 for r in got)


def test_stability_of_all_brands_at_60_times(spark, monkeypatch):
    """Counts as lines and parts drawn at 60 times sf0.1 give them, which differ by a hundredth: every random start of a seed collapses."""
    from peakloom.plans import queries

    rng = np.random.default_rng(1)
    x = rng.poisson(30 * rng.poisson(20_000 / 150 * 60, (25, 6))).astype(float)
    brands = spark.createDataFrame([(f"Brand#{i + 1}", r.tolist()) for i, r in enumerate(x)], "brand string, x array<double>").coalesce(1)
    monkeypatch.setattr(queries, "brand_types", lambda *_: (brands, list("abcdef")))
    got = rows(queries.stability(spark, ""), "component")
    assert [r[0] for r in got] == [1, 2, 3] and all(0.9 < r[2] <= r[1] <= 1 + 1e-9 for r in got)


def test_stability_is_of_random_starts(spark, monkeypatch):
    """Found anew row by row of the definition: 300 rounds, and for a fit that collapses the first sound one of other seeds, not rows far apart or fits cut short."""
    from peakloom.plans import queries

    def fit(x, seed):
        h, errors = factor._start(6, 3, float(np.sqrt(x.mean() / 3)), seed), []
        for _ in range(300):
            w = factor.update_rows(x, h)
            errors.append(np.linalg.norm(x - w @ h))
            h = h * (w.T @ x) / (w.T @ w @ h + factor.EPS)
            if len(errors) > 1 and errors[-2] - errors[-1] < 1e-5 * errors[0]:
                break
        won = np.bincount(factor.update_rows(x, h, rounds=100).argmax(1), minlength=3)
        return h[np.argsort(-won, kind="stable")] if won.all() else None

    x = np.random.default_rng(418).poisson(2.4e5, (10, 6)).astype(float)
    tried = ([seed, *(100_000 * t + seed * 50 + i for t in range(1, 11) for i in range(50))] for seed in range(5))
    fits = [next(h for h in (fit(x, s) for s in some) if h is not None) for some in tried]
    want = [tuple(r.values()) for r in factor.stability(fits, factor.medoid(fits))]
    brands = spark.createDataFrame([(f"r{i}", r.tolist()) for i, r in enumerate(x)], "brand string, x array<double>")
    monkeypatch.setattr(queries, "brand_types", lambda *_: (brands, list("abcdef")))
    got = rows(queries.stability(spark, ""), "component")
    assert len(got) == 3 and np.allclose([tuple(r) for r in got], want, atol=1e-5)


def test_stability_without_a_sound_fit_is_no_result(spark, monkeypatch):
    """Brands that differ by a part in 30,000, of which no random start is sound, are an error; no brands at all have no programs."""
    from peakloom.plans import queries

    x = np.random.default_rng(418).poisson(1e9, (10, 6)).astype(float)
    brands = spark.createDataFrame([(f"r{i}", r.tolist()) for i, r in enumerate(x)], "brand string, x array<double>").coalesce(1)
    monkeypatch.setattr(queries, "brand_types", lambda *_: (brands, list("abcdef")))
    with pytest.raises(RuntimeError, match="collapsed from every seed"):
        queries.stability(spark, "")
    monkeypatch.setattr(queries, "brand_types", lambda *_: (brands.limit(0), list("abcdef")))
    assert queries.stability(spark, "").collect() == []


def test_stacked_fits_at_once(spark):
    """A task a fit gives what a pass a round does; a fit from rows far apart is marked, and a fit of no rows is no use."""
    from peakloom.operators.stacks import Fit, keyed, sound, stacked_nmf

    rng = np.random.default_rng(21)
    x = rng.random((60, 3)) * (rng.random((60, 3)) < 0.5) @ rng.random((3, 10)) + 0.01 * rng.random((60, 10))
    data = keyed(spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "r long, x array<double>, half int").repartition(3), "r", "half").cache()
    fits = [Fit(2), Fit(3, 4), Fit(2, 1, fold=1), Fit(2, 0, part=1), Fit(2, 0, part=7)]
    by_round, at_once, too_many = (stacked_nmf(data, fits, 10, 12, at_once=n) for n in (0, 600, 599))
    for fit in fits:
        for other in (at_once, too_many):
            assert np.allclose(by_round[fit].h, other[fit].h) and np.allclose(by_round[fit].errors, other[fit].errors)
            assert (by_round[fit].fault, by_round[fit].apart) == (other[fit].fault, other[fit].apart) == ("empty" if fit.part == 7 else None, False)
    with pytest.raises(RuntimeError, match="no rows"):
        sound(by_round)
    alike = keyed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(418).poisson(1e9, (10, 6)).astype(float))], "r long, x array<double>").coalesce(1), "r")
    assert [(one.fault, one.apart) for far in (True, False) for one in stacked_nmf(alike, [Fit(3)], 6, extra=1, apart=far).values()] == [(None, True), ("collapsed", False)]


def test_ranks_of_values_that_come_out_differently_when_made_again(spark):
    """As sums of doubles do in their last digit, by the order of the rows: no pair is lost, and none counts twice."""
    import pandas as pd

    def shaken(frames):
        for f in frames:
            yield pd.DataFrame({"g": f["id"] % 2, "x": (f["id"] + 1) * (1 + np.random.default_rng().integers(-4, 5, len(f)) * 2.0**-50), "y": -1.0 * f["id"] * (1 + np.random.default_rng().integers(-4, 5, len(f)) * 2.0**-50)})

    df = spark.range(0, 400, 1, 4).mapInPandas(shaken, "g long, x double, y double")
    assert rows(stats.spearman(df, ["g"], "x", "y").withColumn("r", F.round("r", 9)), "g") == [(0, -1.0, 200), (1, -1.0, 200)]
    assert stats.average_ranks(df, "x", ["g"]).agg(F.sum("rank")).first()[0] == 2 * 200 * 201 / 2
    assert [r.n for r in stats.running_before(df.groupBy("g", "x").agg(F.count("*").alias("c")), ["g"], "x", "c").groupBy("g").agg(F.max(F.col("__before") + F.col("c")).alias("n")).collect()] == [200, 200]


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Strides, means and tiles give the same whatever number of partitions the size asks for, and tasks are that many."""
    from peakloom import session
    from peakloom.sources import files

    assert [session.parts(spark.range(1001), n, times) for n, times in ((500, 1), (500, 2), (5000, 1))] == [3, 5, 1]
    rng = np.random.default_rng(6)
    cells = [(None if i % 5 == 0 else int(g), int(k)) for i, (g, k) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 90, 300)))]
    want = sorted((-1 if g is None else g, k) for g in {g for g, _ in cells} for k in sorted(k for h, k in cells if h == g)[::10])
    pts = spark.createDataFrame([("c", int(p), f"t{rng.integers(6)}", int(rng.integers(1000))) for c in rng.integers(0, 60_000, 40) for p in c + rng.normal(0, 20, 8) if p > 0], "chrom string, pos long, tf string, score int")
    values = spark.createDataFrame([(i, c, float(i * 3 + c)) for i in range(4) for c in range(3)] + [(0, 0, None)], "item int, cat int, x double")
    members = spark.createDataFrame([(m, m % 4) for m in range(40)] * 2 + [(m, (m + 1) % 4) for m in range(40)], "module int, item int")
    found = []
    for n in (1, 7):
        for module in (files, relational, segment):
            monkeypatch.setattr(module, "parts", lambda df, *a, n=n, **k: n)
        got = files.strided(spark.createDataFrame(cells, "g int, k int"), ["k"], ["g"], 10)
        assert sorted((-1 if r.g is None else r.g, r.k) for r in got.collect()) == want
        means = relational.member_means(members, values, "module", "item", "cat", "x")
        assert means.rdd.getNumPartitions() == n
        found.append((rows(segment.discover(pts, "chrom", "tf", floor=2, tile=3_000), "low"), rows(means, "module", "cat")))
    assert found[0] == found[1] and found[0][1][0] == (0, 0, 1.5, 2) and len(found[0][1]) == 120


def test_segments_are_found_once(spark):
    """Ids, labels and what counts modules again read the segments that were written, and don't segment anew."""
    from pyspark.sql import DataFrame

    def passes(df: DataFrame) -> int:
        return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")

    pts = spark.createDataFrame([(a, f"t{f}", o, 300) for a in range(4) for f in range(4) for o in (7 * f - 20, 7 * f + 600)], "anchor_id long, tf string, offset int, score int")
    found = segment.anchor_modules(pts, "anchor_id", "tf")
    assert passes(found) == 1 and passes(segment.module_ids(found, "anchor_id")) == 0
    assert [r.module_id for r in segment.module_ids(found, "anchor_id").orderBy("anchor_id", "local_idx").collect()] == list(range(8))
    axis = spark.createDataFrame([("c", p, f"t{i}", 300) for i in range(4) for p in (1000 + 5 * i, 9000 + 5 * i)], "chrom string, pos long, tf string, score int")
    elements = segment.discover(axis, "chrom", "tf", floor=2, tile=3_000)
    labelled = segment.label_elements(elements, spark.createDataFrame([("c", 1010)], "chrom string, anchor long"), "chrom")
    assert passes(elements) == 1 and passes(labelled) == 0 and sorted(r.low for r in labelled.collect()) == sorted(r.low for r in elements.collect())


def test_redetection_is_dealt_by_its_points(spark, monkeypatch):
    """Points of all shuffles, and their tiles, go to partitions counted from them, not to a setting's."""
    asked = []
    monkeypatch.setattr(segment, "parts", lambda df, *a, **k: asked.append(df.count()) or 5)
    pts = spark.createDataFrame([("c", 1000 * i + j, f"t{j}", 300) for i in range(10) for j in range(5)], "chrom string, pos long, tf string, score int")
    got = segment.redetected(pts, "chrom", "tf", 2, floor=2, reach=100, tile=3_000)
    assert asked == [150] and got.rdd.getNumPartitions() == 5
    assert sorted(r.center for r in got.filter("shuffle = 0").collect()) == [1000 * i + 2 for i in range(10)]


def test_shuffles_are_dealt_by_their_points(spark, monkeypatch):
    """The join with the lengths and what it hands on go to partitions counted from the points, a group in tiles, and move the points as before."""
    asked = []
    monkeypatch.setattr(intervals, "parts", lambda df, *a, times=1.0, **k: asked.append((df.count(), times)) or 6)
    rows_ = [(c, p, f"t{(p or 0) % 3}") for c in ("c", "d", None) for p in (*range(0, 900, 7), None)]
    pts = spark.createDataFrame(rows_, "chrom string, pos long, tf string").coalesce(1)
    got = intervals.circular_shift(pts, ["tf"], "chrom", "pos", 2, 7, tile=100, own=True)
    assert asked == [(390, 3)]
    spread = got.groupBy("shuffle", F.spark_partition_id().alias("p")).count().groupBy("shuffle").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()
    assert len(spread) == 3 and all(r.n > 2 and r.most < 200 for r in spread)
    want = pts.withColumn("shuffle", F.lit(0)).unionByName(intervals.circular_shift(pts, ["tf"], "chrom", "pos", 2, 7))
    assert got.count() == 390 + 2 * 260 and got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty()
