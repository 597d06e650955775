"""Statistics over long tables, all in built-in expressions. Nulls and NaN are pairwise left out unless a policy says otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .relational import null_safe_join


def clean(x: str) -> Column:
    """NaN as null."""
    c = F.col(x).cast("double")
    return F.when(~F.isnan(c), c)


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, r, n) by sums over pairs without null or NaN; r is null at zero variance; groups of fewer than least pairs go."""
    d = df.select(*by, clean(x).alias("__x"), clean(y).alias("__y")).filter("__x is not null and __y is not null")
    # about the group's means: sums of squares of large numbers would cancel
    means = d.groupBy(*by).agg(F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"), F.count("*").alias("n")).filter(F.col("n") >= least)
    dx, dy = F.col("__x") - F.col("__mx"), F.col("__y") - F.col("__my")
    got = d.join(means, list(by)).groupBy(*by, "n").agg(F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"))
    return got.select(*by, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("r"), "n")


def fill_by_row_mean(df: DataFrame, row: str, value: str) -> DataFrame:
    """Missing values become their row's mean."""
    v = clean(value)
    return df.withColumn(value, F.coalesce(v, F.avg(v).over(Window.partitionBy(row))))


def tau(df: DataFrame, row: str, value: str) -> DataFrame:
    """Specificity: sum(1 - x / max) / (n - 1) over finite values, null if the maximum isn't positive or n < 2."""
    d = df.select(row, clean(value).alias("__v")).filter("__v is not null")
    got = d.groupBy(row).agg(F.max("__v").alias("m"), F.sum("__v").alias("s"), F.count("*").alias("n"))
    return got.select(row, F.when((F.col("m") > 0) & (F.col("n") > 1), (F.col("n") - F.try_divide("s", "m")) / (F.col("n") - 1)).alias("tau"), "n")


def top_category(df: DataFrame, row: str, category: str, value: str) -> DataFrame:
    """The category of each row's largest value (ties: first by name) and that value."""
    best = F.min(F.struct(-F.col(value), F.col(category))).alias("b")
    return df.groupBy(row).agg(best).select(row, F.col(f"b.{category}").alias("top"), (-F.col("b.col1")).alias("top_value"))


def _ranges(df: DataFrame, value: str, parts: int) -> DataFrame:
    """df with __part, a number that rises with the value: about equal shares of the rows, by approximate quantiles. These few numbers
    are read first, so that the plan has no join for them."""
    found = df.agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10 * parts))).first()[0]
    edges = F.array(*[F.lit(e) for e in sorted(set(found or []))]) if found else F.array().cast("array<double>")
    return df.withColumn("__part", F.size(F.filter(edges, lambda e: e < F.col(value))))


def running_before(df: DataFrame, by: Sequence[str], value: str, count: str, parts: int = 64) -> DataFrame:
    """df, whose rows are distinct values of a group, with __before: the sum of count over the group's smaller values. Summed in ranges
    of the value and over the ranges, so that no task holds a group.

    df is written first: edges, sums and rows come from one run of its plan, for a sum of doubles made again may differ in its last digit."""
    held = _ranges(written(df, "counted"), value, parts)
    order = Window.partitionBy(*by, "__part").orderBy(value)
    held = held.withColumn("__own", F.coalesce(F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = held.groupBy(*by, "__part").agg(F.sum(count).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__lower", before).drop("__s")
    met = null_safe_join(held, sums, [*by, "__part"])
    return met.withColumn("__before", F.col("__own") + F.col("__lower")).drop("__own", "__lower", "__part")


def quantiles(df: DataFrame, by: Sequence[str], value: str, **at: float) -> DataFrame:
    """(by, a column for each quantile), exact, by linear interpolation: equal values are counted first, and ranks come from running
    sums, so that no buffer grows with a group. Missing values don't count."""
    counts = df.select(*by, clean(value).alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    ranked = running_before(counts, by, "__v", "__c")
    n = ranked.groupBy(*by).agg(F.sum("__c").alias("__n"))
    ranked = null_safe_join(ranked, n, by)
    ends = []
    for name, q in at.items():
        place = (F.col("__n") - 1) * F.lit(float(q))
        for end, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__c")), F.col("__v"))).alias(f"__{name}_{end}"))
    got = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *ends)
    part = lambda q: (F.col("__n") - 1) * F.lit(float(q)) - F.floor((F.col("__n") - 1) * F.lit(float(q)))
    return got.select(*by, *[(F.col(f"__{c}_lo") + (F.col(f"__{c}_hi") - F.col(f"__{c}_lo")) * part(q)).alias(c) for c, q in at.items()])


def _with_quantiles(got: DataFrame, q: DataFrame, by: Sequence[str]) -> DataFrame:
    return null_safe_join(got, q, by, "left")


def quantile_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, quartiles (linear interpolation), sample deviation and standard error, of values that aren't missing."""
    v = clean(value)
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v).cast("double"))).alias("sem"))
    return _with_quantiles(got, quantiles(df, by, value, q1=0.25, median=0.5, q3=0.75), by).select(*by, "n", "mean", "q1", "median", "q3", "std", "sem")


def error_bars(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"below": F.greatest(F.col("mean") - F.col("q1"), F.lit(0.0)), "above": F.greatest(F.col("q3") - F.col("mean"), F.lit(0.0))})


def fraction_below(df: DataFrame, by: Sequence[str], value: str, limit: float) -> DataFrame:
    """Size, mean, median and the fraction below the limit; missing values count in the fraction's denominator."""
    v = clean(value)
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(F.when(v < limit, 1.0).otherwise(0.0)).alias("fraction"))
    return _with_quantiles(got, quantiles(df, by, value, median=0.5), by).select(*by, "n", "mean", "median", "fraction")


def ols(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """slope and intercept by group, null with fewer than 3 pairs or zero variance of x."""
    d = df.select(*by, clean(x).alias("__x"), clean(y).alias("__y")).filter("__x is not null and __y is not null")
    got = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.covar_pop("__x", "__y").alias("c"), F.var_pop("__x").alias("v"), F.min("__x").alias("x0"), F.max("__x").alias("x1"))
    slope = F.when(F.col("n") >= 3, F.try_divide("c", "v"))
    return got.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).select(*by, "n", "slope", "intercept", (F.col("intercept") + F.col("slope") * F.col("x0")).alias("y0"), (F.col("intercept") + F.col("slope") * F.col("x1")).alias("y1"))


def supporting(df: DataFrame, row: str, column: str, x: str, y: str, q: float = 0.75) -> DataFrame:
    """Columns where both series reach their own q quantile: how many, and the one with the largest product."""
    ends = df.groupBy(row).agg(F.percentile(clean(x), q).alias("__qx"), F.percentile(clean(y), q).alias("__qy"))
    hit = df.join(ends, row).filter((F.col(x) >= F.col("__qx")) & (F.col(y) >= F.col("__qy")))
    return hit.groupBy(row).agg(F.count("*").alias("n_supporting"), F.min(F.struct((-F.col(x) * F.col(y)).alias("p"), F.col(column).alias("c"))).alias("b")).select(row, "n_supporting", F.col("b.c").alias("top"))


def benjamini_hochberg(df: DataFrame, by: Sequence[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """q: the running minimum, from the largest p down, of p * m / rank, at most 1. Equal p have equal q."""
    group = Window.partitionBy(*by)
    ranked = df.withColumn("__r", F.row_number().over(group.orderBy(p))).withColumn("__m", F.count("*").over(group))
    running = F.min(F.col(p) * F.col("__m") / F.col("__r")).over(group.orderBy(F.desc(p), F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(q, F.least(F.lit(1.0), running)).drop("__r", "__m")


def log_factorial(x) -> Column:
    """ln x! of a number from 0, by Stirling's series from 10 on, below by shifting: fixed work whatever x is."""
    x = x.cast("double")
    y = x + 11
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, 7)) + 1 / (1188 * F.pow(y, 9))
    shift = x + 1
    for i in range(2, 11):
        shift = shift * (x + i)
    return series - F.log(shift)


def hypergeometric(counts: DataFrame, k: str = "k", n: str = "n", big_k: str = "big_k", big_n: str = "big_n") -> DataFrame:
    """Adds p_value = P(X >= k) and odds_ratio (0.5 added to each cell) to rows of counts; only k >= 1 and big_k >= 3 are tested.

    The first term comes from logarithms of factorials, the others by their ratios, summed on the side of the mean where k
    lies and as far as a double tells (40 deviations), all in one native expression without any table."""
    rows = counts.filter((F.col(k) >= 1) & (F.col(big_k) >= 3))
    N, K, n_ = (F.col(c).cast("double") for c in (big_n, big_k, n))
    ln_choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    low, top = F.greatest(F.lit(0), F.col(n) + F.col(big_k) - F.col(big_n)), F.least(F.col(n), F.col(big_k))
    share = K / N
    reach = (F.ceil(F.sqrt(n_ * share * (1 - share)) * 40) + 100).cast("bigint")
    upper = F.col(k) >= n_ * share
    x0 = F.greatest(low, F.when(upper, F.col(k)).otherwise(F.col(k) - 1))
    first = ln_choose(K, x0) + ln_choose(N - K, n_ - x0) - ln_choose(N, n_)
    none = F.array().cast("array<bigint>")
    rest = F.when(upper, F.when(top > x0, F.sequence(x0, F.least(top - 1, x0 + reach))).otherwise(none)).otherwise(F.when(x0 > low, F.sequence(x0, F.greatest(low + 1, x0 - reach))).otherwise(none))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc, x):
        up = ((F.col(big_k) - x).cast("double") * (F.col(n) - x)) / ((x + 1).cast("double") * (F.col(big_n) - F.col(big_k) - F.col(n) + x + 1))
        down = (x.cast("double") * (F.col(big_n) - F.col(big_k) - F.col(n) + x)) / ((F.col(big_k) - x + 1).cast("double") * (F.col(n) - x + 1))
        ratio = F.when(upper, up).otherwise(down)
        return F.struct((acc["t"] * ratio).alias("t"), (acc["s"] + acc["t"] * ratio).alias("s"))

    side = F.exp(first) * F.aggregate(rest, zero, step, lambda acc: acc["s"])
    p = F.when(F.col(k) <= low, 1.0).when(upper, side).otherwise(1 - side)
    a, b = F.col(k) + 0.5, F.col(n) - F.col(k) + 0.5
    c = F.col(big_k) - F.col(k) + 0.5
    d = F.col(big_n) - F.col(big_k) - (F.col(n) - F.col(k)) + 0.5
    return rows.withColumn("p_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).withColumn("odds_ratio", (a / b) / (c / d))


def enrichment(foreground: DataFrame, sets: DataFrame, universe: DataFrame, by: str, item: str = "item", term: str = "term", background: DataFrame | None = None) -> DataFrame:
    """Hypergeometric tests of each group's items against each term's, with q over the tested terms of a group.

    foreground: (by, item), sets: (term, item), universe: (item); all made unique and cut to the universe. background: (item),
    tests count only what is in it and the universe."""
    universe = universe.select(item).distinct()
    if background is not None:
        universe = universe.join(background.select(item).distinct(), item, "left_semi")
    fg = foreground.select(by, item).distinct().join(universe, item, "left_semi")
    st = sets.select(term, item).distinct().join(universe, item, "left_semi")
    hits = fg.join(st, item).groupBy(by, term).agg(F.count("*").alias("k"))
    counts = hits.join(fg.groupBy(by).agg(F.count("*").alias("n")), by).join(st.groupBy(term).agg(F.count("*").alias("big_k")), term).crossJoin(universe.agg(F.count("*").alias("big_n")))
    return benjamini_hochberg(hypergeometric(counts), [by])


def enrichment_two_backgrounds(foreground: DataFrame, sets: DataFrame, universe: DataFrame, by: str, item: str = "item", term: str = "term") -> DataFrame:
    """The tests against both backgrounds: 'own', the items that are in any foreground, and 'whole', the universe."""
    own = enrichment(foreground, sets, universe, by, item, term, foreground.select(item))
    return own.withColumn("background", F.lit("own")).unionByName(enrichment(foreground, sets, universe, by, item, term).withColumn("background", F.lit("whole")))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """rank with ties at their mean; values are counted first, and ranks are running sums over ranges of the value.

    df is written first, for the ranks come back by the values' equality: made again, a mean of doubles may differ in its last digit."""
    df = written(df, "ranked")
    counts = running_before(df.groupBy(*by, value).agg(F.count("*").alias("__c")), by, value, "__c")
    ranks = counts.select(*by, value, (F.col("__before") + (F.col("__c") + 1) / 2).alias("rank"))
    return null_safe_join(df, ranks, [*by, value])


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, r, n): Pearson of average ranks, over pairs without null or NaN."""
    d = df.select(*by, clean(x).alias("__sx"), clean(y).alias("__sy")).filter("__sx is not null and __sy is not null")
    d = average_ranks(average_ranks(d, "__sx", by).withColumnRenamed("rank", "__rx"), "__sy", by)
    return pearson(d, by, "__rx", "rank", least)


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve of a score against 0/1 labels, ties a half, of each group. Scores are counted first, and summed in ranges."""
    at = df.select(*by, clean(score).alias("s"), F.col(label).cast("int").alias("y")).filter("s is not null and y is not null").groupBy(*by, "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    won = running_before(at, by, "s", "neg").withColumn("won", F.col("pos") * (F.col("__before") + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the rows, from pair counts of the contingency table; 1 when it is degenerate."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    both = cells.agg(pairs("c").alias("ij"), F.sum("c").alias("n"))
    one = lambda k, name: cells.groupBy(k).agg(F.sum("c").alias("c")).agg(pairs("c").alias(name))
    t = both.crossJoin(one(a, "i")).crossJoin(one(b, "j"))
    expected = F.try_divide(F.col("i") * F.col("j"), F.col("n") * (F.col("n") - 1) / 2)
    return t.select(F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected), F.lit(1.0)).alias("ari"), "n")


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ami, n): mutual information of two labellings of the rows, less what random labellings of the same sizes have, over mean entropy
    less that; 1 for two labellings of one class each. Rows without either label don't count.

    Items are counted by pair of labels once; the rest works on those counts. The expected information is summed over pairs of different
    class sizes (weighted by how many classes have them; there are at most the root of twice the items of each), and for each over
    the overlaps within 40 deviations of their mean, whose other terms a double doesn't hold."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"))
    side = lambda k, x: cells.groupBy(k).agg(F.sum("c").alias(x))
    n = F.col("n").cast("double")
    information = cells.join(side(a, "x"), a).join(side(b, "y"), b).crossJoin(total)  # one row
    mi = information.agg(F.sum(F.col("c") / n * F.log(n * F.col("c") / (F.col("x").cast("double") * F.col("y")))).alias("mi"))
    sizes = {x: side(k, x).groupBy(x).agg(F.count("*").alias(f"m_{x}")) for k, x in ((a, "x"), (b, "y"))}
    entropy = lambda x: sizes[x].crossJoin(total).agg((-F.sum(F.col(f"m_{x}") * F.col(x) / n * F.log(F.col(x) / n))).alias(f"h_{x}"), F.sum(f"m_{x}").alias(f"k_{x}"))
    met = sizes["x"].crossJoin(sizes["y"]).crossJoin(total)  # sizes by sizes, not classes by classes
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    mean = x * y / n
    reach = 40 * F.sqrt(mean * (1 - x / n) * (1 - y / n) * n / F.greatest(n - 1, F.lit(1.0))) + 40
    low = F.greatest(F.lit(1), F.col("x") + F.col("y") - F.col("n"), F.floor(mean - reach)).cast("bigint")
    high = F.least(F.col("x"), F.col("y"), F.ceil(mean + reach)).cast("bigint")
    met = met.filter(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    k = F.col("k").cast("double")
    lf = log_factorial
    chance = F.exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(k) - lf(x - k) - lf(y - k) - lf(n - x - y + k))
    expected = met.agg(F.coalesce(F.sum(F.col("m_x") * F.col("m_y") * k / n * F.log(n * k / (x * y)) * chance), F.lit(0.0)).alias("e"))
    one = mi.crossJoin(entropy("x")).crossJoin(entropy("y")).crossJoin(expected).crossJoin(total)  # rows of one each
    apart = (F.col("h_x") + F.col("h_y")) / 2 - F.col("e")
    trivial = ((F.col("k_x") == 1) & (F.col("k_y") == 1)) | (F.abs(apart) < 1e-15)
    return one.select(F.when(trivial, 1.0).otherwise((F.col("mi") - F.col("e")) / apart).alias("ami"), "n")


def tail_counts(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """How many rows have value >= floor, for each floor from low to high, in one pass: values are counted, then summed from above."""
    counts = df.select(F.least(F.col(value), F.lit(high)).cast("bigint").alias("floor")).filter(F.col("floor") >= low).groupBy("floor").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "floor").join(counts, "floor", "left").fillna(0, ["n"])
    above = F.sum("n").over(Window.orderBy(F.desc("floor")).rowsBetween(Window.unboundedPreceding, 0))
    return every.select("floor", above.alias("n"))


def support_fdr(observed: DataFrame, null: DataFrame, shuffle: str, value: str, low: int, high: int, shuffles: int) -> DataFrame:
    """For each floor: observed count, mean count over shuffles, their ratio."""
    flat = tail_counts(null, value, low, high).select("floor", (F.col("n") / shuffles).alias("null_mean"))
    return tail_counts(observed, value, low, high).join(flat, "floor").select("floor", F.col("n").alias("observed"), "null_mean", F.try_divide("null_mean", "n").alias("fdr"))


def split_half(df: DataFrame, item: str, unit: str, experiment: str) -> DataFrame:
    """Each item's experiments are dealt to two halves in order of their md5; replication of its units between the halves, raw and corrected for chance."""
    halves = df.select(item, experiment).distinct().withColumn("half", (F.row_number().over(Window.partitionBy(item).orderBy(F.md5(F.col(experiment).cast("string")), experiment)) - 1) % 2)
    units = df.join(halves, [item, experiment]).select(item, unit, "half").distinct()
    n_units = df.agg(F.count_distinct(unit).alias("n_units"))
    per = units.groupBy(item, unit).agg(F.max((F.col("half") == 0).cast("int")).alias("a"), F.max((F.col("half") == 1).cast("int")).alias("b"))
    got = per.groupBy(item).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both")).crossJoin(n_units)
    least = F.least("a", "b")
    chance = F.col("a") * F.col("b") / F.col("n_units")
    raw = (F.try_divide("both", "a") + F.try_divide("both", "b")) / 2
    fair = F.when(least <= chance, 0.0).otherwise(F.try_divide(F.col("both") - chance, least - chance))
    return got.select(item, F.col("a").alias("n_a"), F.col("b").alias("n_b"), F.col("both").alias("n_both"), raw.alias("raw"), fair.alias("corrected"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins of [low, high], the last one closed; bins without rows are there with 0."""
    v = clean(value)
    width = (high - low) / bins
    at = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("bigint")
    counts = df.filter((v >= low) & (v <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").fillna(0, ["n"])


def column_order(df: DataFrame, column: str, value: str) -> DataFrame:
    """Columns by the sum of ln(1 + value), the largest first, with their place from 1. The window's rows are columns."""
    sums = df.groupBy(column).agg(F.sum(F.log1p(clean(value))).alias("weight"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weight"), column)))


def enrichment_quality(tests: DataFrame, by: str, term: str = "term", top: int = 5, least_q: float = 0.05, generic: int = 1000) -> DataFrame:
    """Of each group's top terms below least_q: groups enriched, median of the best -log10 q, median odds ratio, distinct terms and the share of generic ones."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("q_value", "p_value", term))
    best = tests.filter(F.col("q_value") < least_q).withColumn("__r", rank).filter(F.col("__r") <= top)
    first = F.when(F.col("__r") == 1, -F.log10(F.greatest(F.col("q_value"), F.lit(1e-300))))
    return best.agg(F.count_distinct(by).alias("n_groups"), F.median(first).alias("median_top"), F.median("odds_ratio").alias("median_odds"), F.count_distinct(term).alias("n_terms"), F.avg((F.col("big_k") >= generic).cast("double")).alias("generic_share"))


def pick_level(df: DataFrame, item: str, level: str, value: str, floor: float) -> DataFrame:
    """Each item's level with the largest value (ties: the strictest level) and whether that value reaches the floor."""
    best = df.groupBy(item).agg(F.max(F.struct(value, level)).alias("b"))
    reason = F.when(F.col(f"b.{value}") >= floor, "reaches floor").otherwise("peak below floor")
    return best.select(item, F.col(f"b.{level}").alias("pick"), F.col(f"b.{value}").alias("value"), reason.alias("reason"))


def member_rollup(members: DataFrame, values: DataFrame, module: str, item: str, value: str) -> DataFrame:
    """By module: the median of its items' values and the item with the least."""
    v = members.select(module, item).distinct().join(values.select(item, clean(value).alias("__v")), item).filter("__v is not null")
    least = F.min(F.struct("__v", item)).alias("b")
    return v.groupBy(module).agg(F.median("__v").alias("median"), F.count("*").alias("n"), least).select(module, "median", "n", F.col(f"b.{item}").alias("best"), F.col("b.__v").alias("best_value"))


def pairwise_ari(runs: DataFrame, rank: str, seed: str, item: str, label: str) -> DataFrame:
    """(rank, a, b, ari) for each two seeds of a rank, from their tables of label counts; seeds are few, items any number."""
    l, r = (runs.select(rank, item, F.col(seed).alias(s), F.col(label).alias(f"l{s}")) for s in "ab")
    cells = l.join(r, [rank, item]).filter("a < b").groupBy(rank, "a", "b", "la", "lb").agg(F.count("*").alias("c"))
    pairs = lambda df, name: df.groupBy(rank, "a", "b").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(name), F.sum("c").alias(f"{name}_n"))
    side = lambda s, name: pairs(cells.groupBy(rank, "a", "b", f"l{s}").agg(F.sum("c").alias("c")), name).drop(f"{name}_n")
    t = pairs(cells, "ij").join(side("a", "i"), [rank, "a", "b"]).join(side("b", "j"), [rank, "a", "b"])
    expected = F.try_divide(F.col("i") * F.col("j"), F.col("ij_n") * (F.col("ij_n") - 1) / 2)
    return t.select(rank, "a", "b", F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("i") + F.col("j")) / 2 - expected), F.lit(1.0)).alias("ari"))


def ari_by_rank(pairs: DataFrame, rank: str) -> DataFrame:
    """Of pairwise_ari by rank: pairs, mean, quartiles, and whether its median is the largest (ties: the smallest rank)."""
    got = quantile_stats(pairs, [rank], "ari").select(rank, "n", "mean", "q1", "median", "q3")
    best = got.agg(F.max(F.struct(F.round("median", 9).alias("m"), (-F.col(rank)).alias("r"))).alias("b")).select((-F.col("b.r")).alias("__best"))
    return got.crossJoin(best).withColumn("picked", F.col(rank) == F.col("__best")).drop("__best")


def consensus_dispersion(runs: DataFrame, seed: str, item: str, label: str) -> DataFrame:
    """Of the items-by-items matrix C of the share of seeds that label two alike: n_items, mean, and dispersion, the mean of 4 (C - 1/2)^2.

    Both follow from the label counts of each two seeds, so that the matrix is never made: work is items times seeds squared."""
    l, r = (runs.select(item, F.col(seed).alias(s), F.col(label).alias(f"l{s}")) for s in "ab")
    cells = l.join(r, item).groupBy("a", "b", "la", "lb").agg(F.count("*").cast("double").alias("c"))
    n = runs.agg(F.count_distinct(item).alias("n_items"), F.count_distinct(seed).cast("double").alias("s"))
    both = cells.agg(F.sum(F.when((F.col("a") == F.col("b")) & F.col("la").eqNullSafe(F.col("lb")), F.col("c") * F.col("c"))).alias("one"), F.sum(F.col("c") * F.col("c")).alias("two")).crossJoin(n)
    pairs = F.col("n_items").cast("double") * F.col("n_items")
    mean = F.col("one") / F.col("s") / pairs
    return both.select("n_items", mean.alias("mean"), (4 * F.col("two") / (F.col("s") * F.col("s")) / pairs - 4 * mean + 1).alias("dispersion"))


def first_floor(fdr: DataFrame, target: float) -> DataFrame:
    """One row: the first floor whose fdr is at most the target, and its numbers; null if none is."""
    best = F.min(F.when(F.col("fdr") <= target, F.struct("floor", "observed", "null_mean", "fdr"))).alias("b")
    return fdr.agg(best).select("b.floor", "b.observed", "b.null_mean", "b.fdr")


def recovery(df: DataFrame, support: str, hit: str, distance: str, edges: Sequence[int]) -> DataFrame:
    """By bin of support (bin k holds the values from edges[k - 1] up to below edges[k]): rows, the share hit, median distance."""
    bin_ = F.lit(0)
    for e in edges:
        bin_ = bin_ + (F.col(support) >= e).cast("int")
    held = df.withColumn("bin", bin_)
    got = held.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(hit), F.lit(False)).cast("int")).alias("recovered"))
    return _with_quantiles(got, quantiles(held.withColumn("__d", F.abs(distance)), ["bin"], "__d", median_distance=0.5), ["bin"])


def sweep(cells: Sequence[dict], run) -> tuple[list[dict], list[dict]]:
    """(results, failures) over cells of parameters: run(**cell) gives a table of one row; a cell that fails is reported with its reason
    and the others go on."""
    done, failed = [], []
    for cell in cells:
        try:
            done.append(cell | run(**cell).first().asDict())
        except Exception as error:  # whatever a cell dies of, the sweep reports it
            failed.append(cell | {"reason": f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"})
    return done, failed
