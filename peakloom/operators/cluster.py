"""Clustering and comparison of partitions. Large steps are joins; dense steps on k x k or a few hundred profiles run on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .stats import clean


#: Cells of a matrix that a dense step on the driver takes at most.
DENSE = 4_000_000


def dense(frame, what: str):
    """The rows of a table for a dense step, once it is known that there are few enough."""
    rows, columns = frame.count(), len(frame.columns)
    if rows * columns > DENSE:
        raise ValueError(f"{what}: {rows} rows by {columns} columns are too many for one machine")
    return frame.toPandas()


def consensus(runs: DataFrame) -> DataFrame:
    """runs: (seed, item, label). (a < b, together): the fraction of seeds that label both alike. The matrix is the result; items are a bounded sample."""
    pairs = runs.withColumnRenamed("item", "a").withColumnRenamed("label", "la").join(runs.withColumnRenamed("item", "b").withColumnRenamed("label", "lb"), "seed").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.avg(F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0)).alias("together"))


def linkage(x: np.ndarray, method: str = "ward", distances: bool = False) -> np.ndarray:
    """Merges (i, j, height, size) by Lance-Williams updates; x: rows, or square distances. Ward heights as of Euclidean distances; NaN distances count 1."""
    d = np.array(x, np.float64) if distances else np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T))
    d = np.where(np.isnan(d), 1.0, d)
    n = len(d)
    d = d**2 if method == "ward" else d.copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        height = d[i, j]
        if method == "ward":
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / (size[i] + size[j] + size)
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        new[np.isnan(new)] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        out.append((ids[i], ids[j], math.sqrt(height) if method == "ward" else height, size[i]))
        ids[i] = n + step
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, clusters: int) -> np.ndarray:
    """Labels from 1, by first member, of at most that many clusters."""
    n = len(merges) + 1
    top = list(range(2 * n - 1))
    for k, (i, j, *_) in enumerate(merges[: max(0, n - clusters)]):
        top[int(i)] = top[int(j)] = n + k

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen) + 1) for i in range(n)])


def leaves(merges: np.ndarray) -> list[int]:
    """Rows in the order of the tree's leaves."""
    n = len(merges) + 1
    own = {i: [i] for i in range(n)}
    for k, (i, j, *_) in enumerate(merges):
        own[n + k] = own.pop(int(i)) + own.pop(int(j))
    return own[2 * n - 2]


def cophenetic(merges: np.ndarray, distances: np.ndarray) -> float:
    """Correlation of the tree's heights with the distances."""
    n = len(merges) + 1
    own, high = {i: [i] for i in range(n)}, np.zeros((n, n))
    for k, (i, j, height, _) in enumerate(merges):
        a, b = own.pop(int(i)), own.pop(int(j))
        high[np.ix_(a, b)] = height
        own[n + k] = a + b
    upper = np.triu_indices(n, 1)
    return float(np.corrcoef((high + high.T)[upper], distances[upper])[0, 1])


def dispersion(c: np.ndarray) -> float:
    return float((4 * (c - 0.5) ** 2).mean())


def profile_clusters(profiles: np.ndarray, clusters: int, floor: float = 0.02, sigma: float = 10) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows, labels): rows whose maximum reaches floor, smoothed, scaled to their peak, clustered by Ward; labels follow
    the place of the clusters' mean maximum."""
    from .segment import gaussian

    kept = np.flatnonzero(profiles.max(1) >= floor)
    x = np.stack([gaussian(row, sigma) for row in profiles[kept]]) if len(kept) else profiles[:0]
    x = x / np.maximum(x.max(1, keepdims=True), 1e-300)
    if len(kept) < 2:
        return kept, np.ones(len(kept), int)
    labels = cut(linkage(x), clusters)
    place = {c: int(x[labels == c].mean(0).argmax()) for c in np.unique(labels)}
    order = {c: i + 1 for i, c in enumerate(sorted(place, key=lambda c: (place[c], c)))}
    return kept, np.array([order[c] for c in labels])


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths with potentials; each row of the shorter side once."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, before, done = cost[row] - u[row] - v, np.full(m, -1), np.zeros(m, bool)
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            reach = dist[j]
            done[j] = True
            if match[j] < 0:
                break
            i = match[j]
            through = reach + cost[i] - u[i] - v
            better = ~done & (through < dist - 1e-15)
            dist[better], before[better] = through[better], j
        for k in np.flatnonzero(done):
            v[k] -= reach - dist[k]
            if match[k] >= 0:
                u[match[k]] += reach - dist[k]
        u[row] += reach
        while before[j] >= 0:
            match[j] = match[before[j]]
            j = before[j]
        match[j] = row
    return sorted((int(i), j) for j, i in enumerate(match) if i >= 0)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return unit(a) @ unit(b).T


def greedy_match(similarity: np.ndarray) -> list[tuple[int, int, float]]:
    """Rows by their best similarity, the highest first (ties: the first row), each with its best column that is still free (ties: the first)."""
    free, out = np.ones(similarity.shape[1], bool), []
    for i in np.argsort(-similarity.max(1, initial=-np.inf), kind="stable"):
        if not free.any():
            break
        j = int(np.argmax(np.where(free, similarity[i], -np.inf)))
        free[j] = False
        out.append((int(i), j, float(similarity[i, j])))
    return out


def dominant_match(pairs: DataFrame, a: str = "a", b: str = "b", s: str = "s") -> DataFrame:
    """(a, b, s): greedy_match of a long table of similarities, by joins: rows (a) in order of their best similarity, each with its best free b.

    All rows at once ask for their best column; a column goes to the row of the highest place that asks, and keeps it only
    until a higher one does; the others ask for their next best column that no higher row holds. Since all columns rank rows
    alike, where this ends is what one row after the other would take. A round is three joins on written tables; rows that hold a
    column do nothing. Pairs without similarity (null, NaN) aren't there; of a pair given more than once the most counts; ties go by a, then b;
    rows whose columns are all taken have none."""
    known = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), clean(s).alias("s")).filter("a is not null and b is not null and s is not null")
    known = known.groupBy("a", "b").agg(F.max("s").alias("s"))
    # (-best, a) is a row's place: the least is the highest
    ranked = written(known.withColumn("best", F.max("s").over(Window.partitionBy("a"))).select("a", "b", "s", F.struct((-F.col("best")).alias("m"), "a").alias("place")), "ranked")
    held, asking = None, written(ranked.select("a").distinct(), "asking")
    while not asking.isEmpty():
        open_ = ranked.join(asking, "a", "left_semi")
        if held is not None:
            open_ = open_.join(held.select("b", F.col("place").alias("by")), "b", "left").filter(F.col("by").isNull() | (F.col("place") < F.col("by")))
        asked = open_.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).filter("n = 1").select("b", "s", "place")
        every = written(asked if held is None else asked.unionByName(held.select("b", "s", "place")), "asked")
        now = written(every.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("place"))).select("b", "s", "place", "n"), "held")
        held = now.filter("n = 1").drop("n")
        asking = now.filter("n > 1").select("place.a")
    out = ranked.limit(0).select("a", "b", "s") if held is None else held.select("place.a", "b", "s")
    return out.withColumnsRenamed({"a": a, "b": b, "s": s})


def adjusted_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """(MI - E) / (mean entropy - E), E under random labellings with the same sizes."""
    ia, ib = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    table = np.zeros((ia.max() + 1, ib.max() + 1))
    np.add.at(table, (ia, ib), 1)
    n, x, y = table.sum(), table.sum(1), table.sum(0)
    entropy = lambda s: -(s / n * np.log(s / n)).sum()
    i, j = np.nonzero(table)
    mi = (table[i, j] / n * np.log(n * table[i, j] / (x[i] * y[j]))).sum()
    ln = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, n + 1))]))
    expected = 0.0
    for r in x.astype(int):
        for c in y.astype(int):
            k = np.arange(max(1, r + c - int(n)), min(r, c) + 1)
            if len(k):
                p = np.exp(ln[r] + ln[c] + ln[int(n) - r] + ln[int(n) - c] - ln[int(n)] - ln[k] - ln[r - k] - ln[c - k] - ln[int(n) - r - c + k])
                expected += (k / n * np.log(n * k / (r * c)) * p).sum()
    mean = (entropy(x) + entropy(y)) / 2
    return 1.0 if len(x) == len(y) == 1 or abs(mean - expected) < 1e-15 else float((mi - expected) / (mean - expected))


def smallest_set_label(items: DataFrame, sets: DataFrame, item: str = "item", term: str = "term", least: int = 3) -> DataFrame:
    """(item, term): the smallest set of `least` members or more that holds each item; ties by name."""
    one = sets.select(term, item).distinct().join(items.select(item).distinct(), item, "left_semi")
    sizes = one.groupBy(term).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return one.join(sizes, term).groupBy(item).agg(F.min(F.struct("__n", term)).alias("b")).select(item, F.col(f"b.{term}").alias(term))
