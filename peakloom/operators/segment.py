"""Density segmentation of points around anchors or along an axis: smoothing, peaks, boundaries, segments.

The kernel is NumPy on one group's grid; groups are dealt out by Spark. A long axis is cut into tiles with a halo (see
discover), so that no group is larger than a tile whatever the axis' length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import parts, written
from .intervals import circular_shift, gap_clusters, local_weights, nearest_join, overlap_join, stratum
from .stats import quantiles


def kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return k / k.sum()


@lru_cache
def _taps(sigma: float, fixed: bool) -> np.ndarray:
    k = kernel(sigma)
    return np.rint(k * 2.0**24) / 2.0**24 if fixed else k


def gaussian(x: np.ndarray, sigma: float, mode: str = "reflect") -> np.ndarray:
    """Smoothed x; beyond the ends x is mirrored with its edge repeated ('reflect') or 0 ('constant')."""
    k = kernel(sigma)
    reach = len(k) // 2
    if mode == "constant":
        padded = np.pad(x.astype(float), reach)
    else:
        padded = np.pad(x.astype(float), reach, mode="symmetric")
    return np.convolve(padded, k, "valid")


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places above both neighbours; of a plateau its middle, rounded down. The ends are none."""
    if len(x) < 3:
        return np.empty(0, int)
    last = np.flatnonzero(x[1:] != x[:-1])  # of each plateau but the one at the end
    rises = x[last] < x[last + 1]
    top = np.flatnonzero(rises[:-1] & ~rises[1:])
    return (last[top] + 1 + last[top + 1]) // 2


def prominence(x: np.ndarray, at: int) -> float:
    """Height above the higher of the two lowest points between the peak and higher ground (or the end) on each side."""
    left = np.flatnonzero(x[:at] > x[at])
    right = np.flatnonzero(x[at + 1 :] > x[at])
    low = x[(left[-1] + 1 if len(left) else 0) : at + 1].min()
    high = x[at : (at + 1 + right[0] if len(right) else len(x))].min()
    return float(x[at] - max(low, high))


def find_peaks(x: np.ndarray, height: float, prominent: float, distance: int) -> np.ndarray:
    """Local maxima by height, then distance (the tallest first; of equals the later), then prominence."""
    peaks = local_maxima(x)
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1] if distance > 1 else ():  # no two are nearer than 1
        if keep[i]:
            keep[(np.abs(peaks - peaks[i]) < distance) & (np.arange(len(peaks)) != i)] = False
    return np.array([p for p in peaks[keep] if prominence(x, p) >= prominent], int)


def boundaries(x: np.ndarray, peaks: np.ndarray, share: float, floor: float) -> list[tuple[int, int]]:
    """Closed bounds of each peak: outwards while x stays at its threshold, the larger of share * height and floor, but not
    past the lowest point between two peaks."""
    out = []
    for k, p in enumerate(peaks):
        level = max(share * x[p], floor)
        least = 0 if k == 0 else peaks[k - 1] + int(np.argmin(x[peaks[k - 1] : p + 1]))
        most = len(x) - 1 if k == len(peaks) - 1 else p + int(np.argmin(x[p : peaks[k + 1] + 1]))
        below = np.flatnonzero(x[least : p + 1] < level)
        above = np.flatnonzero(x[p : most + 1] < level)
        out.append((least + (below[-1] + 1 if len(below) else 0), (p + above[0] - 1) if len(above) else most))
    return out


@dataclass(frozen=True)
class Segmenter:
    reach: int = 1500
    sigma: float = 25.0
    support: float = 2.0  # detection floor, in one feature's height
    distance: int = 50
    share: float = 0.2
    min_features: int = 2
    mode: str = "reflect"
    fixed: bool = False  # weights in 2^-20 and the kernel in 2^-24: sums are exact, whatever their order, and any engine can repeat them

    @property
    def unit(self) -> float:
        """A single feature's height."""
        return 1 / (self.sigma * np.sqrt(2 * np.pi))

    @property
    def taps(self) -> np.ndarray:
        return _taps(self.sigma, self.fixed)  # made once a worker, not for each grid

    def smooth(self, places: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """The smoothed grid of that size: the kernel is added at the places that hold points, or, if these are more than its taps, the
        grid at each tap, so that work follows the points and never is grid times kernel for a grid of few points."""
        x, k = np.bincount(places, weights, minlength=size), self.taps
        reach = len(k) // 2
        if self.mode == "constant":
            padded = np.zeros(size + 2 * reach)
            padded[reach : reach + size] = x
        else:
            padded = np.pad(x, reach, mode="symmetric")
        at, out = np.flatnonzero(padded), np.zeros(size + 4 * reach)
        if len(at) <= len(k):
            for p in at:
                out[p : p + len(k)] += padded[p] * k
        else:
            for t, tap in enumerate(k):
                out[t : t + len(padded)] += tap * padded
        return out[2 * reach : 2 * reach + size]

    def density(self, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The smoothed grid around an anchor."""
        return self.smooth(offsets + self.reach, self.weight(weights), 2 * self.reach + 1)

    def weight(self, w):
        """Weights as the grid takes them; of a column a column."""
        if not self.fixed:
            return w
        return F.round(w * 2.0**20) / 2.0**20 if isinstance(w, Column) else np.rint(w * 2.0**20) / 2.0**20

    def segments(self, density: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(low, high, centre, height) as places in the grid."""
        peaks = find_peaks(density, (self.support - 0.5) * self.unit, 0.5 * self.unit, self.distance)
        return [(a, b, int(p), float(density[p])) for p, (a, b) in zip(peaks, boundaries(density, peaks, self.share, 0.5 * self.unit), strict=True)]

    def modules(self, offsets: np.ndarray, features: np.ndarray, scores: np.ndarray, min_score: float) -> list[dict]:
        """Segments of one anchor's points with min_features features or more, from the most upstream."""
        names, number, counts = np.unique(features, return_inverse=True, return_counts=True)
        out = []
        if len(names) < self.min_features:
            return out
        for a, b, p, height in self.segments(self.density(offsets, 1 / counts[number])):
            inside = (offsets >= a - self.reach) & (offsets <= b - self.reach)
            supporting = len(np.unique(number[inside]))
            if supporting >= self.min_features:
                assigned = len(np.unique(number[inside & (scores >= min_score)]))
                out.append({"local_idx": len(out), "low": a - self.reach, "high": b - self.reach, "center": p - self.reach, "width": b - a + 1, "height": height, "n_peaks": int(inside.sum()), "n_supporting": supporting, "n_assigned": assigned})
        return out


MODULE = "local_idx int, low int, high int, center int, width int, height double, n_peaks int, n_supporting int, n_assigned int"


def by_group(df: DataFrame, keys: Sequence[str], values: Sequence[str], schema, f: Callable[[tuple, list[np.ndarray]], list[tuple]], n: int | None = None) -> DataFrame:
    """f(key, columns) of every group of rows with equal keys, its values sorted in the order named; groups stream through sorted partitions,
    whose number n may be given."""
    arrow = to_arrow_schema(schema)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    def as_numpy(c):
        return np.array(c.to_pylist(), object) if c.null_count else c.to_numpy(zero_copy_only=False)

    def run(batches):
        held, last, out = [], None, []
        for b in batches:
            ids, cols = ([as_numpy(b.column(i)) for i in some] for some in (range(len(keys)), range(len(keys), b.num_columns)))
            if not b.num_rows:
                continue
            new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in ids])]))
            for a, z in zip(new, [*new[1:], b.num_rows]):
                own = tuple(c[a] for c in ids)
                if held and own != last:
                    out += f(last, [np.concatenate(x) for x in zip(*held)])
                    held = []
                last = own
                held.append([c[a:z] for c in cols])
            if len(out) > 5000:
                yield batch(out)
                out = []
        if held:
            out += f(last, [np.concatenate(x) for x in zip(*held)])
        if out:
            yield batch(out)

    dealt = df.select(*keys, *values).repartition(*([n] if n else []), *keys).sortWithinPartitions(*keys, *values)
    return dealt.mapInArrow(run, schema)


def _schema(df: DataFrame, keys: Sequence[str], rest: str):
    kinds = dict(df.dtypes)
    return df.sparkSession.createDataFrame([], ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest])).schema


def anchor_modules(points: DataFrame, anchor_id: str, feature: str, offset: str = "offset", score: str = "score", min_score: float = 250, segmenter: Segmenter = Segmenter()) -> DataFrame:
    """(anchor_id, MODULE) of every anchor. A group is one anchor's points within reach, made one per (feature, offset) first:
    repeated points are counted before they reach Python, so that a hot anchor's group is bounded by features x offsets. Groups are dealt to
    partitions whose number follows these rows (see parts): each makes a grid, so that shares of few bytes hold much work."""
    near = points.filter(F.abs(offset) <= segmenter.reach).groupBy(anchor_id, feature, F.col(offset).cast("int").alias("__o")).agg(F.count("*").alias("__n"), F.max(score).cast("double").alias("__s"))
    near = written(near.filter(F.col(anchor_id).isNotNull()), "near")  # counted here, read once more below
    names = [c.split()[0] for c in MODULE.split(", ")]

    def close(key, cols):
        offsets, features, counts, scores = cols
        each = np.repeat(np.arange(len(counts)), counts)
        return [(*key, *(m[n] for n in names)) for m in segmenter.modules(offsets[each], features[each], scores[each], min_score)]

    return by_group(near, [anchor_id], ["__o", feature, "__n", "__s"], _schema(near, [anchor_id], MODULE), close, parts(near, 50_000))


def module_ids(modules: DataFrame, anchor_id: str, tile: int = 65_536) -> DataFrame:
    """module_id from 0 by (anchor, local index): sizes of the anchors' runs are summed, for numbered anchors in ranges of `tile`
    numbers and over the ranges, so that neither modules nor anchors are sorted in one task. Modules are written first, for they are read
    twice here, and by what follows, and would be segmented anew each time."""
    modules = written(modules, "modules")
    sizes = modules.groupBy(anchor_id).agg(F.count("*").alias("__n"))
    numbered = dict(modules.dtypes)[anchor_id] in ("tinyint", "smallint", "int", "bigint")
    sizes = sizes.withColumn("__t", F.floor(F.col(anchor_id) / tile) if numbered else F.lit(0))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("__t").agg(F.sum("__n").alias("__s")).withColumn("__lower", before("__s", Window.orderBy("__t"))).drop("__s")
    sizes = sizes.withColumn("__own", before("__n", Window.partitionBy("__t").orderBy(anchor_id))).join(ranges, "__t")
    at = sizes.select(anchor_id, (F.col("__own") + F.col("__lower")).alias("__at"))
    return modules.join(at, anchor_id).withColumn("module_id", F.col("__at") + F.col("local_idx")).drop("__at")


ELEMENT = "low bigint, high bigint, center bigint, width bigint, height double, n_peaks bigint, n_supporting bigint, n_assigned bigint"


def discover(points: DataFrame, chrom: str | Sequence[str], feature: str, position: str = "pos", score: str = "score", min_score: float = 250, floor: int = 11, reach: int = 1500, tile: int = 200_000, grid: int = 1, segmenter: Segmenter = Segmenter(mode="constant")) -> DataFrame:
    """Annotation-free elements along each axis: (chrom, low, high, center, width, height, n_peaks, n_supporting, n_assigned).

    chrom: a column, or several that together name an axis. Each point weighs 1 over its feature's points within reach; the axis is
    worked on in tiles, each with a halo of its neighbours' points, dealt to partitions whose number follows the points' (see parts); an element belongs to the tile of its centre. Positions are divided
    by grid. floor: least number of assigned features. Points without position are in no element."""
    axis = [chrom] if isinstance(chrom, str) else list(chrom)
    halo = 20 * int(segmenter.sigma) + 10 * segmenter.distance
    points = points.filter(F.col(position).isNotNull())
    n = parts(points)
    weighed = local_weights(points, [*axis, feature], position, reach, max(tile * grid, 2 * reach), n)
    weighed = weighed.withColumn("__w", segmenter.weight(F.col("weight"))).withColumn("__p", F.floor(F.col(position) / grid))
    cells = weighed.repartition(n, *axis, feature, "__p").groupBy(*axis, feature, "__p").agg(F.sum("__w").alias("__w"), F.count("*").alias("__n"), F.max(score).cast("double").alias("__s"))
    first, last = F.floor((F.col("__p") - halo) / tile), F.floor((F.col("__p") + halo) / tile)
    dealt = cells.withColumn("__t", F.explode(F.sequence(first, last)))

    def close(key, cols):
        at, features, w, n, s = cols
        begin = int(key[-1]) * tile - halo
        at, number, rows = at - begin, np.unique(features.astype(str), return_inverse=True)[1], []
        x = segmenter.smooth(at, w, tile + 2 * halo)
        for a, b, p, height in segmenter.segments(x):
            if halo <= p < halo + tile:
                own = slice(*np.searchsorted(at, [a, b + 1]))
                supporting, assigned = len(np.unique(number[own])), len(np.unique(number[own][s[own] >= min_score]))
                if supporting >= segmenter.min_features and assigned >= floor:
                    rows.append((*key[:-1], a + begin, b + begin, p + begin, b - a + 1, height, int(n[own].sum()), supporting, assigned))
        return rows

    return by_group(dealt, [*axis, "__t"], ["__p", feature, "__w", "__n", "__s"], _schema(points, axis, ELEMENT), close, n)


def redetected(points: DataFrame, chrom: str, feature: str, shuffles: int = 5, seed: int = 0, position: str = "pos", **how) -> DataFrame:
    """(shuffle, chrom, ELEMENT): the elements of the points (shuffle 0) and, found anew, those of each shuffle, in which every feature's points on
    a chromosome move around by an offset of its own.

    The shuffle is one more key of the axis: weights, tiles, halos and segments of all shuffles come from one pass."""
    every = circular_shift(points, [feature], chrom, position, shuffles, seed, how.get("tile", 200_000) * how.get("grid", 1), own=True)
    return discover(every, ["shuffle", chrom], feature, position, **how)


def redetection_fdr(elements: DataFrame, shuffles: int, low: int, high: int, support: str = "n_assigned", shuffle: str = "shuffle") -> DataFrame:
    """(floor, observed, null_mean, null_sd, fdr) by floor of support: observed elements at or above it, the mean and sample deviation of the
    shuffles' counts (0 with one shuffle), and mean over observed. Shuffles in which nothing is found count with 0.

    Elements are counted by (shuffle, support) before anything else, so that the windows' rows are those counts."""
    counts = elements.select(shuffle, F.least(F.col(support), F.lit(high)).cast("bigint").alias("floor")).filter(F.col("floor") >= low).groupBy(shuffle, "floor").agg(F.count("*").alias("n"))
    spark = elements.sparkSession
    every = spark.range(low, high + 1).select(F.col("id").alias("floor"), F.explode(F.sequence(F.lit(0), F.lit(shuffles))).alias(shuffle))
    above = F.sum("n").over(Window.partitionBy(shuffle).orderBy(F.desc("floor")).rowsBetween(Window.unboundedPreceding, 0))
    tails = every.join(counts, [shuffle, "floor"], "left").fillna(0, ["n"]).withColumn("n", above)
    null = F.when(F.col(shuffle) > 0, F.col("n"))
    got = tails.groupBy("floor").agg(F.max(F.when(F.col(shuffle) == 0, F.col("n"))).alias("observed"), F.avg(null).alias("null_mean"), F.coalesce(F.stddev_samp(null), F.lit(0.0)).alias("null_sd"))
    return got.select("floor", "observed", "null_mean", "null_sd", F.try_divide("null_mean", F.col("observed").cast("double")).alias("fdr"))


def label_elements(elements: DataFrame, anchors: DataFrame, chrom: str, anchor: str = "anchor", gap: int = 12_500, near: int = 1_000, far: int = 10_000) -> DataFrame:
    """Distance to the nearest anchor, its stratum, gap cluster and cluster size. Elements are written first, for each step reads them more than once."""
    out = nearest_join(written(elements, "elements"), anchors, [chrom], position="center", anchor=anchor, tile=1_000_000)
    out = out.withColumn("stratum", F.when(F.col("distance").isNotNull(), stratum(F.col("distance"), near, far)))
    return gap_clusters(out, [chrom], "center", gap, tie=["low"], tile=1_000_000)


def gate(elements: DataFrame, modules: DataFrame, chrom: str, within: int, floor: int, tile: int = 1_000_000) -> DataFrame:
    """Share of modules that an element recovers (centre within reach, or spans overlap), by support at or above the floor.

    modules: (module_id, chrom, low, high, center, n_assigned), positions on the axis. tile: see nearest_join."""
    near = nearest_join(modules, elements.select(chrom, F.col("center").alias("anchor")), [chrom], position="center", tie="right", tile=tile)
    half_open = lambda df, *names: df.select("*", F.col("low").alias(names[0]), (F.col("high") + 1).alias(names[1]))
    spans = half_open(elements, "r_start", "r_end").select(chrom, "r_start", "r_end")
    met = overlap_join(half_open(modules, "start", "end").select("module_id", chrom, "start", "end"), spans, [chrom], how="left_semi").select("module_id").distinct().withColumn("overlaps", F.lit(True))
    hit = near.join(met, "module_id", "left").withColumn("hit", ((F.abs("distance") <= within) | F.col("overlaps")).cast("boolean"))
    group = F.when(F.col("n_assigned") >= floor, "at floor").otherwise("below")
    hit = hit.withColumn("support", group)
    got = hit.groupBy("support").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(False)).cast("int")).alias("recovered"))
    return got.join(quantiles(hit.withColumn("__d", F.abs("distance")), ["support"], "__d", median_distance=0.5), "support", "left")
