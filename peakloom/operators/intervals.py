"""Operators on scored intervals and points: blocks are half-open [start, end), module and element bounds are closed.

Everything is composed of built-in expressions, joins and windows; a group column (chromosome, anchor) is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts
from .relational import null_safe_join

Names = Sequence[str]


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def recenter(start: Column, end: Column, half: int = 12) -> tuple[Column, Column]:
    """The block of 2 * half + 1 around the midpoint, cut at 0."""
    mid = midpoint(start, end)
    return F.greatest(mid - half, F.lit(0)), mid + half + 1


def snap(mid: Column, grid: int = 25) -> Column:
    return F.floor(mid / grid) * grid


def project_point(mid: Column, anchor: Column, strand: Column) -> Column:
    """Signed distance downstream of the anchor."""
    return F.when(strand == "+", mid - anchor).otherwise(anchor - mid)


def project_interval(start: Column, end: Column, anchor: Column, strand: Column, reach: int) -> tuple[Column, Column]:
    """A block's half-open place in the window of reach around the anchor, read downstream, cut to the window."""
    low, high = F.greatest(start, anchor - reach), F.least(end, anchor + reach + 1)
    plus = strand == "+"
    return F.when(plus, low - anchor + reach).otherwise(anchor - (high - 1) + reach), F.when(plus, high - anchor + reach).otherwise(anchor - low + reach + 1)


def absolute_bounds(low: Column, high: Column, anchor: Column, strand: Column) -> tuple[Column, Column]:
    """Closed bounds relative to an anchor, as positions."""
    plus = strand == "+"
    return F.when(plus, anchor + low).otherwise(anchor - high), F.when(plus, anchor + high).otherwise(anchor - low)


#: A level's bins are so many times as wide as those of the level below.
FANOUT = 8


def _widths(width: int) -> Column:
    out = [width]
    while out[-1] * FANOUT < 2**62:
        out.append(out[-1] * FANOUT)
    return F.array(*[F.lit(w).cast("bigint") for w in [*out, 2**62]])  # no interval is longer than that


def _level(length: Column, width: int) -> Column:
    """The lowest level whose bins are at least that long."""
    return F.size(F.filter(_widths(width), lambda w: w < length)).cast("int")


def _bin(at: Column, level: Column, width: int) -> Column:
    w = F.get(_widths(width), level)
    return F.call_function("div", at - F.pmod(at, w), w)  # whole numbers all the way


def _own_bins(df: DataFrame, first: Column, last: Column, width: int) -> DataFrame:
    """Closed [first, last] in the one or two bins of the level of their length."""
    leveled = df.withColumn("__level", _level(last - first + 1, width))
    return leveled.withColumn("__bin", F.explode(F.array_distinct(F.array(_bin(first, F.col("__level"), width), _bin(last, F.col("__level"), width)))))


def _levels(df: DataFrame, length: Column, width: int) -> list[int]:
    """The levels of df's intervals: 22 at most, whatever the lengths."""
    return sorted(r[0] for r in df.select(_level(length, width)).distinct().collect() if r[0] is not None)


def _all_bins(df: DataFrame, first: Column, last: Column, width: int, levels: Sequence[int], above: Column) -> DataFrame:
    """Closed [first, last] in its bins of each of the levels from `above` on: one or two a level, for these are as long as itself."""
    one = lambda level: F.transform(F.array_distinct(F.array(_bin(first, level, width), _bin(last, level, width))), lambda b: F.struct(level.alias("__level"), b.alias("__bin")))
    some = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= above)
    return df.withColumn("__at", F.explode(F.flatten(F.transform(some, one)))).withColumns({"__level": F.col("__at.__level"), "__bin": F.col("__at.__bin")}).drop("__at")


def overlap_join(left: DataFrame, right: DataFrame, on: Names, bin_size: int = 64, left_on: tuple[str, str] = ("start", "end"), right_on: tuple[str, str] = ("r_start", "r_end"), how: str = "inner") -> DataFrame:
    """All pairs of half-open intervals that overlap, by equi-joins on bins of several levels; how: inner or left_semi.

    Each interval lies in one or two bins of the level of its length, so that a long one makes no more rows than a short one, and
    is looked for in the bins of every level of the other side that is as long as itself or longer. A pair is kept
    in the bin of the later start only, so that none is found twice and nothing need be made distinct. bin_size: width of
    the lowest level's bins; it changes the work, not the rows. The levels there are, 22 numbers at most, are read first.
    A semi join makes a shuffle less than joining and dropping. Intervals that are empty or have a null end meet nothing."""
    (a, b), (c, d) = left_on, right_on
    left, right = left.filter(F.col(a) < F.col(b)), right.filter(F.col(c) < F.col(d))
    (l0, l1), (r0, r1) = (F.col(a), F.col(b) - 1), (F.col(c), F.col(d) - 1)
    lefts, rights = _levels(left, l1 - l0 + 1, bin_size), _levels(right, r1 - r0 + 1, bin_size)
    own = _own_bins(left, l0, l1, bin_size), _own_bins(right, r0, r1, bin_size)
    # pairs whose left is as long or longer meet at the left's level, the others at the right's
    meetings = [(own[0], _all_bins(right, r0, r1, bin_size, lefts, _level(r1 - r0 + 1, bin_size)))]
    if rights and lefts and max(rights) > min(lefts):
        meetings.append((_all_bins(left, l0, l1, bin_size, rights, _level(l1 - l0 + 1, bin_size) + 1), own[1]))
    out = None
    for x, y in meetings:
        keys = [*on, "__level", "__bin"]
        if how == "left_semi":
            met = x.alias("l").join(y.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(a) < F.col(d), F.col(c) < F.col(b)], "left_semi")
        else:
            met = x.join(y, keys).filter((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("__bin") == _bin(F.greatest(a, c), F.col("__level"), bin_size)))
        met = met.drop("__level", "__bin")
        out = met if out is None else out.unionByName(met)
    return out.distinct() if how == "left_semi" else out


def point_in_interval_join(points: DataFrame, intervals: DataFrame, on: Names, bin_size: int = 64, point: str = "pos", low: str = "low", high: str = "high") -> DataFrame:
    """Pairs with low <= point <= high: intervals lie in one or two bins of the level of their length, points are looked for in one bin of
    each level there is (see overlap_join)."""
    intervals = intervals.filter(F.col(low) <= F.col(high))
    levels = _levels(intervals, F.col(high) - F.col(low) + 1, bin_size)
    level = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")) if len(levels) != 1 else F.lit(levels[0])
    asked = points.withColumn("__level", level).withColumn("__bin", _bin(F.col(point), F.col("__level"), bin_size))
    met = asked.join(_own_bins(intervals, F.col(low), F.col(high), bin_size), [*on, "__level", "__bin"])
    return met.filter(F.col(point).between(F.col(low), F.col(high))).drop("__level", "__bin")


def nearest_join(points: DataFrame, anchors: DataFrame, on: Names, position: str = "pos", anchor: str = "anchor", tie: str = "left", within: int | None = None, tile: int | None = None) -> DataFrame:
    """Each point with its group's nearest anchor position (null without one) and signed distance; tie: left or right anchor.

    One sort of both sides together, no range join: the last anchor at or before, and the first at or after, each point.
    tile: long groups are dealt out in tiles of that length; the anchors next to a tile come from a table of tiles.
    A null group is a group like others, with a tile or without; points without position go."""
    marks = anchors.select(*on, F.col(anchor).alias("__at")).distinct()
    both = points.withColumn("__at", F.lit(None).cast("bigint")).withColumn("__key", F.col(position))
    both = both.unionByName(marks.withColumn("__key", F.col("__at")), allowMissingColumns=True)
    by = [*on]
    if tile:
        by.append("__tile")
        at = lambda c: F.floor(F.col(c) / tile).alias("__tile")
        ends = marks.groupBy(*on, at("__at")).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi"))
        none = F.lit(None).cast("bigint")
        every = points.select(*on, at(position), none.alias("__lo"), none.alias("__hi")).unionByName(ends).groupBy(*by).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
        order = Window.partitionBy(*on).orderBy("__tile")
        every = every.withColumn("__left", F.last("__hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        every = every.withColumn("__right", F.first("__lo", True).over(order.rowsBetween(1, Window.unboundedFollowing))).drop("__lo", "__hi")
        both = null_safe_join(both.withColumn("__tile", at("__key")), every, by)
    else:
        both = both.withColumns({"__left": F.lit(None).cast("bigint"), "__right": F.lit(None).cast("bigint")})
    order = Window.partitionBy(*by).orderBy("__key")
    before = F.coalesce(F.last("__at", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__left"))
    after = F.coalesce(F.first("__at", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing)), F.col("__right"))
    both = both.withColumn("__before", before).withColumn("__after", after).filter(F.col(position).isNotNull())
    to_left, to_right = F.col(position) - F.col("__before"), F.col("__after") - F.col(position)
    left_wins = to_left <= to_right if tie == "left" else to_left < to_right
    near = F.when(F.col("__before").isNull(), F.col("__after")).when(F.col("__after").isNull() | left_wins, F.col("__before")).otherwise(F.col("__after"))
    out = both.withColumn("nearest", near).withColumn("distance", F.col(position) - F.col("nearest")).drop("__at", "__key", "__before", "__after", "__left", "__right", "__tile")
    return out if within is None else out.filter(F.abs("distance") <= within)


def tiled(df: DataFrame, position: str, tile: int | None) -> DataFrame:
    """With __tile: a long group's rows are dealt out in tiles of that length; without a length, in one."""
    return df.withColumn("__tile", F.floor(F.col(position) / tile) if tile else F.lit(0).cast("bigint"))


def carried(df: DataFrame, by: Names, **of: tuple) -> DataFrame:
    """df, of tiled(), with a column for each (kind, column): over all earlier ('before') or later ('after') tiles of the group the
    sum, least, most. The window's rows are tiles."""
    kinds = {"sum_before": (F.sum, F.sum, -1), "max_before": (F.max, F.max, -1), "min_after": (F.min, F.min, 1)}
    tiles = df.groupBy(*by, "__tile").agg(*[kinds[k][0](c).alias(n) for n, (k, c) in of.items()])
    order = Window.partitionBy(*by).orderBy("__tile")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    tiles = tiles.select(*by, "__tile", *[kinds[k][1](n).over(before if kinds[k][2] < 0 else after).alias(n) for n, (k, _) in of.items()])
    return null_safe_join(df, tiles, [*by, "__tile"])


def merge_intervals(df: DataFrame, by: Names, start: str = "start", end: str = "end", tile: int | None = None) -> DataFrame:
    """The union of each group's half-open intervals; touching ones join. tile: see tiled."""
    order = Window.partitionBy(*by, "__tile").orderBy(start, end)
    reached = carried(tiled(df, start, tile), by, __far=("max_before", end))
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    marked = reached.withColumn("__opens", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).drop("__far")
    marked = carried(marked, by, __first=("sum_before", "__opens"))
    island = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__first", F.lit(0))
    return marked.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def coverage(df: DataFrame, by: Names, start: str = "start", end: str = "end", weight: Column | None = None, tile: int | None = None) -> DataFrame:
    """Step coverage: (group, start, end, value) where value isn't 0, by a running sum of the steps at the interval ends. tile: see tiled.

    No position is stored that isn't an end of an interval; densify() gives one row per position."""
    weight = F.lit(1) if weight is None else weight
    steps = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), weight.alias("w")), F.struct(F.col(end).alias("at"), (-weight).alias("w")))).alias("s"))
    steps = steps.groupBy(*by, F.col("s.at").alias("start")).agg(F.sum("s.w").alias("w"))
    order = Window.partitionBy(*by, "__tile").orderBy("start")
    value = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__had", F.lit(0))
    steps = carried(tiled(steps, "start", tile), by, __had=("sum_before", "w"), __next=("min_after", "start"))
    runs = steps.withColumn("value", value).withColumn("end", F.coalesce(F.lead("start").over(order), F.col("__next")))
    return runs.filter("value <> 0 and end is not null").select(*by, "start", "end", "value")


def densify(runs: DataFrame) -> DataFrame:
    """A row per position of coverage runs."""
    return runs.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1))).drop("start", "end")


def rebin(runs: DataFrame, by: Names, width: int, n_bins: int, low: int = 0) -> DataFrame:
    """Sums of coverage runs over n_bins bins of that width from low; what lies beyond the last bin is dropped."""
    last = low + n_bins * width
    cut = runs.withColumns({"start": F.greatest("start", F.lit(low)), "end": F.least("end", F.lit(last))}).filter("start < end")
    first, final = F.floor((F.col("start") - low) / width), F.floor((F.col("end") - 1 - low) / width)
    cut = cut.withColumn("bin", F.explode(F.sequence(first, final)))
    begin = F.col("bin") * width + low
    part = F.least(F.col("end"), begin + width) - F.greatest(F.col("start"), begin)
    return cut.groupBy(*by, "bin").agg(F.sum(F.col("value") * part).alias("value"))


def local_weights(df: DataFrame, by: Names, position: str = "pos", reach: int = 1500, tile: int | None = None, n: int | None = None) -> DataFrame:
    """weight = 1 / number of the group's points within reach, itself and its peers included; null where the position is.

    tile: long groups are dealt out in tiles of that length (at least twice the reach), with the neighbours' points within reach as halo;
    n: number of the partitions that they are dealt to."""
    known = F.col(position).isNotNull()
    if tile is None:
        near = Window.partitionBy(*by).orderBy(position).rangeBetween(-reach, reach)
        return df.withColumn("weight", F.when(known, 1 / F.count("*").over(near)))
    first, last = F.floor((F.col(position) - reach) / tile), F.floor((F.col(position) + reach) / tile)
    nowhere = F.array(F.spark_partition_id().cast("bigint"))  # rows without position lie anywhere
    dealt = df.withColumn("__tile", F.explode(F.when(known, F.sequence(first, last)).otherwise(nowhere)))
    if n:
        dealt = dealt.repartition(n, *by, "__tile")
    near = Window.partitionBy(*by, "__tile").orderBy(position).rangeBetween(-reach, reach)
    weighed = dealt.withColumn("weight", F.when(known, 1 / F.count("*").over(near)))
    return weighed.filter(~known | (F.col("__tile") == F.floor(F.col(position) / tile))).drop("__tile")


def group_weights(df: DataFrame, by: Names) -> DataFrame:
    return df.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*by)))


def gap_clusters(df: DataFrame, by: Names, position: str = "pos", gap: int = 12_500, tie: Names = (), tile: int | None = None) -> DataFrame:
    """cluster (from 0 in each group; a step of more than gap opens the next) and cluster_size. tile: see tiled."""
    order = Window.partitionBy(*by, "__tile").orderBy(position, *tie)
    held = carried(tiled(df, position, tile), by, __last=("max_before", position))
    before = F.coalesce(F.lag(position).over(order), F.col("__last"))
    held = held.withColumn("__opens", F.coalesce((F.col(position) - before > gap).cast("int"), F.lit(0))).drop("__last")
    held = carried(held, by, __first=("sum_before", "__opens"))
    cluster = F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__first", F.lit(0))
    out = held.withColumn("cluster", cluster).drop("__opens", "__first", "__tile")
    return out.withColumn("cluster_size", F.count("*").over(Window.partitionBy(*by, "cluster")))


def bin_label(x: Column, edges: Sequence[int]) -> Column:
    """Number of edges below x: bins are open on the left and closed on the right."""
    out = F.lit(0)
    for e in edges:
        out = out + (x > e).cast("int")
    return out


def stratum(distance: Column, near: int = 1_000, far: int = 10_000) -> Column:
    return F.when(F.abs(distance) <= near, "promoter").when(F.abs(distance) <= far, "proximal").otherwise("distal")


def occupancy(blocks: DataFrame, windows: DataFrame, on: Names, keys: Names, bin_size: int, **ends) -> DataFrame:
    """Distinct keys (feature, anchor) of blocks that overlap windows."""
    return overlap_join(blocks, windows, on, bin_size, **ends).select(*keys).distinct()


def multi_bin_occupancy(points: DataFrame, windows: DataFrame, on: Names, feature: str, anchor_id: str, edges: Sequence[int], bin_size: int, clip: int | None = None) -> DataFrame:
    """Distinct (feature, anchor, bin) of the points' strand-aware offsets; windows: (on, anchor_id, anchor, strand, low, high)."""
    met = point_in_interval_join(points, windows, on, bin_size).withColumn("offset", project_point(F.col("pos"), F.col("anchor"), F.col("strand")))
    if clip is not None:
        met = met.filter(F.abs("offset") <= clip)
    return met.select(feature, anchor_id, bin_label(F.col("offset"), edges).alias("bin")).distinct()


def mean_profile(runs: DataFrame, n_anchors: DataFrame, value: str = "value") -> DataFrame:
    """Coverage runs as means by anchor: value over the number of anchors (one row, one column), at least 1. Raw counts stay as they are."""
    n = n_anchors.toDF("__n")
    return runs.crossJoin(n).withColumn(value, F.col(value) / F.greatest("__n", F.lit(1))).drop("__n")


def feature_summary(peaks: DataFrame, kept: DataFrame, binary: DataFrame, score: DataFrame, feature: str = "tf") -> DataFrame:
    """A row for each feature of peaks: peaks in all and kept, totals and maxima of its binary and score coverage runs; the largest
    binary total first, features without a kept peak with zeros."""
    size = F.col("end") - F.col("start")
    runs = lambda df, name: df.groupBy(feature).agg(F.sum(F.col("value") * size).alias(f"{name}_total"), F.max("value").alias(f"{name}_max"))
    out = peaks.groupBy(feature).agg(F.count("*").alias("n_total")).join(kept.groupBy(feature).agg(F.count("*").alias("n_kept")), feature, "left")
    out = out.join(runs(binary, "binary"), feature, "left").join(runs(score, "score"), feature, "left").fillna(0)
    return out.orderBy(F.desc("binary_total"), feature)


def contained(elements: DataFrame, points: DataFrame, on: Names, key: str, feature: str, bin_size: int) -> DataFrame:
    """For each element (key, closed low and high) how many points lie in it, and of how many features; elements without points too."""
    met = point_in_interval_join(points, elements.select(*on, key, "low", "high"), on, bin_size).groupBy(key).agg(F.count("*").alias("n_points"), F.count_distinct(feature).alias("n_features"))
    return elements.select(key).distinct().join(met, key, "left").fillna(0)


def profile_summary(blocks: DataFrame, feature: str = "tf", value: str = "value") -> DataFrame:
    """Totals and maxima of coverage runs by feature, the largest total first."""
    size = F.col("end") - F.col("start")
    return blocks.groupBy(feature).agg(F.sum(F.col(value) * size).alias("total"), F.max(value).alias("top"), F.sum(size).alias("covered")).orderBy(F.desc("total"), feature)


def circular_shift(points: DataFrame, by: Names, chrom: str, position: str, shuffles: int, seed: int = 0, tile: int | None = None, own: bool = False) -> DataFrame:
    """Each feature's points moved around by one offset per (shuffle, group), modulo the group's length: spacing is kept.

    The offset comes from a hash of (seed, shuffle, group), so that any engine can repeat it. tile: groups are dealt out in tiles of that length, to
    partitions counted from the points of all shuffles, so that neither the join with the lengths nor what a task hands on grows with the input.
    own: the points themselves come too, as shuffle 0."""
    if tile is None:
        length = points.groupBy(chrom).agg((F.max(position) + 1).alias("__len"))
        dealt, out = points, points.join(length, chrom)
    else:
        n = parts(points, times=shuffles + 1)
        tiled = points.withColumn("__tile", F.coalesce(F.floor(F.col(position) / tile), F.lit(0)))
        ends = tiled.groupBy(chrom, "__tile").agg((F.max(position) + 1).alias("__len")).repartition(n, chrom)
        length = ends.withColumn("__len", F.max("__len").over(Window.partitionBy(chrom))).repartition(n, chrom, "__tile")
        tiled = tiled.repartition(n, chrom, "__tile")
        dealt, out = tiled.drop("__tile"), tiled.join(length, [chrom, "__tile"]).drop("__tile")
    out = out.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    key = F.concat_ws("|", F.lit(str(seed)), F.col("shuffle").cast("string"), *[F.col(c).cast("string") for c in (chrom, *by)])
    offset = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    moved = out.withColumn(position, (F.col(position) + offset) % F.col("__len")).drop("__len")
    return dealt.withColumn("shuffle", F.lit(0)).unionByName(moved) if own else moved


def locality(points: DataFrame, feature: str, distance: str = "distance", near: int = 1_500, far: int = 10_000) -> DataFrame:
    """Shares of each feature's points near, in the middle and far, the median distance and how many have one."""
    from .stats import quantiles

    d = F.abs(distance)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    known = points.filter(F.col(distance).isNotNull()).withColumn("__d", d)
    got = known.groupBy(feature).agg(share(d <= near).alias("near"), share((d > near) & (d <= far)).alias("middle"), share(d > far).alias("far"), F.count("*").alias("n"))
    return got.join(quantiles(known, [feature], "__d", median_distance=0.5), feature)
