"""Agglomerative trees by rounds that merge all reciprocal nearest neighbours at once, on tables of distances and merges.

For Ward's and average linkage (both reducible: a merged cluster is no nearer to a third than the nearer of its parts was) two
clusters that are each other's nearest will be merged whatever else happens, so that a round may merge all such pairs and
still gives the tree that one merge at a time would. Clusters are named by their least item; pairs are ordered by distance and names, so
that ties have one outcome too. A round is a few joins on written tables; nothing is gathered but the question whether pairs are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def linkage(distances: DataFrame, method: str = "ward", a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, height, size, round): cluster b joins cluster a < b. distances: every two items once, as (a, b, d) in either order;
    Ward's are Euclidean. A missing distance (null, NaN) counts as 1, a pair given more than once with its least; pairs of an item with itself go."""
    squared = method == "ward"
    lo, hi = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    x = F.coalesce(F.when(~F.isnan(F.col(d).cast("double")), F.col(d).cast("double")), F.lit(1.0))
    pairs = distances.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo, hi, (x * x if squared else x).alias("d"))
    pairs = written(pairs.groupBy("a", "b").agg(F.min("d").alias("d")).select("a", "b", "d", F.lit(1.0).alias("sa"), F.lit(1.0).alias("sb")), "distances")
    merges, nth = None, 0
    while not pairs.isEmpty():
        nth += 1
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct("d", "a", "b", "sa", "sb").alias("p"))
        nearest = ends.groupBy("c").agg(F.min("p").alias("p"))
        met = nearest.groupBy("p").count().filter("count = 2").select("p.*")  # nearest from both sides
        met = written(met.select("a", "b", "d", "sa", "sb", F.lit(nth).alias("round")), "merges")
        moved = met.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("into"), F.col("d").alias("h"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", F.col("sb").alias("sa"), F.col("sa").alias("sb")))
        pairs = written(_joined(_joined(both, moved, "a", "b", squared), moved, "b", "a", squared).filter("a < b"), "distances")
        merges = met if merges is None else merges.unionByName(met)
    if merges is None:
        return pairs.select("a", "b", F.col("d").alias("height"), F.col("sa").cast("bigint").alias("size"), F.lit(0).alias("round")).limit(0)
    height = F.sqrt("d") if squared else F.col("d")
    return written(merges.select("a", "b", height.alias("height"), (F.col("sa") + F.col("sb")).cast("bigint").alias("size"), "round"), "tree")


def _joined(pairs: DataFrame, moved: DataFrame, side: str, other: str, squared: bool) -> DataFrame:
    """pairs, each in both directions, after the merges of one of their sides: distances of a merged cluster come from those of its two parts."""
    s, t = f"s{side}", f"s{other}"
    m = moved.select(F.col("c").alias(side), "into", "h")
    got = pairs.join(m, side, "left").withColumn("new", F.coalesce("into", side))
    partner = moved.select(F.col("c").alias(other), F.col("into").alias("with"))
    got = got.join(partner, other, "left").filter(F.coalesce("with", other) != F.col("new"))  # the merged pair itself goes
    weight = F.col(s) + F.col(t) if squared else F.col(s)
    got = got.groupBy(F.col("new").alias("x"), F.col(other).alias("y")).agg(F.sum(weight * F.col("d")).alias("sum"), F.sum(s).alias("size"), F.max(t).alias("t"), F.max("h").alias("h"), F.max("d").alias("d"))
    both = (F.col("sum") - F.col("t") * F.col("h")) / (F.col("size") + F.col("t")) if squared else F.col("sum") / F.col("size")
    new = F.when(F.col("h").isNull(), F.col("d")).otherwise(both)
    return got.select(F.col("x").alias(side), F.col("y").alias(other), new.alias("d"), F.col("size").alias(s), F.col("t").alias(t))


def _roots(items: DataFrame, steps: DataFrame) -> DataFrame:
    """(item, root, at) by pointer jumping: steps (b, a, at) leads from b to a, and at adds up along the way."""
    at = items.join(steps.select(F.col("b").alias("item"), "a", "at"), "item", "left").select("item", F.coalesce("a", "item").alias("root"), F.coalesce("at", F.lit(0)).alias("at"))
    at = written(at, "roots")
    while True:
        up = at.select(F.col("item").alias("root"), F.col("root").alias("next"), F.col("at").alias("more"))
        nxt = written(at.join(up, "root").select("item", F.col("next").alias("root"), (F.col("at") + F.col("more")).alias("at"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        at = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            return at


def cut(items: DataFrame, merges: DataFrame, clusters: int, item: str = "item") -> DataFrame:
    """(item, root): the least item of each item's cluster, when all but the last clusters - 1 merges are made."""
    one = items.select(F.col(item).alias("item")).distinct()
    last = merges.orderBy(F.desc("height"), F.desc("round"), F.desc("a"), F.desc("b")).limit(clusters - 1)
    kept = merges.join(last.select("b"), "b", "left_anti")  # a cluster joins another once
    return _roots(one, kept.select("b", "a", F.lit(0).cast("bigint").alias("at"))).select(F.col("item").alias(item), "root")


def leaf_order(items: DataFrame, merges: DataFrame, item: str = "item") -> DataFrame:
    """(item, place from 0): the order of the tree's leaves, the part with the least item first."""
    one = items.select(F.col(item).alias("item")).distinct()
    # how large a was just before b came: its size after the merge before that, of those of its own name
    before = Window.partitionBy("a").orderBy("round")
    steps = merges.withColumn("at", F.coalesce(F.lag("size").over(before), F.lit(1))).select("b", "a", "at")
    return _roots(one, steps).select(F.col("item").alias(item), F.col("at").alias("place"))


def cophenetic(distances: DataFrame, merges: DataFrame, a: str = "a", b: str = "b", d: str = "d") -> DataFrame:
    """(a, b, d, height): with each distance the height of the merge that brings its two items together; null for items that the tree
    doesn't join. Each item carries the names of its cluster after every round of merges, of which there are few; a pair meets in
    the first round after which the two names are the same."""
    pairs = distances.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(d).alias("d"))
    at = merges.select(F.explode(F.array("a", "b")).alias("item")).distinct().select("item", F.col("item").alias("root"), F.array().cast(f"array<{dict(merges.dtypes)['a']}>").alias("names"))
    for nth in range(1, (merges.agg(F.max("round")).first()[0] or 0) + 1):
        moved = merges.filter(F.col("round") == nth).select(F.col("b").alias("root"), F.col("a").alias("into"))
        root = F.coalesce("into", "root")
        at = written(at.join(moved, "root", "left").select("item", root.alias("root"), F.concat("names", F.array(root)).alias("names")), "names")
    for side in ("a", "b"):
        pairs = pairs.join(at.select(F.col("item").alias(side), F.col("names").alias(f"n{side}")), side, "left")
    nth = F.array_position(F.zip_with("na", "nb", lambda x, y: x == y), True).cast("int")
    pairs = pairs.withColumn("round", nth).withColumn("into", F.get("na", F.col("round") - 1))
    height = merges.select("round", F.col("a").alias("into"), "height")
    return pairs.join(height, ["round", "into"], "left").select("a", "b", "d", "height")


def profile_clusters(profiles: DataFrame, row: str, clusters: int, floor: float = 0.02, sigma: float = 10.0) -> DataFrame:
    """(row, cluster): profiles (row, x) whose maximum reaches floor times the largest of all, smoothed, scaled to their peak, clustered by Ward's
    linkage; clusters are numbered from 1 by the place where their mean profile is highest. A row given more than once is one by its mean."""
    from .gram import distances
    from .segment import gaussian

    top = profiles.agg(F.max(F.array_max("x"))).first()[0]
    kind = dict(profiles.dtypes)[row]

    def smooth(frames):
        for f in frames:
            x = [gaussian(np.array(v, float), sigma) for v in f["x"]]
            yield pd.DataFrame({row: f[row], "x": [v / max(v.max(), 1e-300) for v in x]})

    held = profiles.filter(F.col(row).isNotNull() & (F.array_max("x") >= floor * (top or 0.0))).select(row, "x").mapInPandas(smooth, f"`{row}` {kind}, x array<double>")
    cells = written(held.select(F.col(row).alias("item"), F.posexplode("x").alias("place", "v")), "profiles")
    items = cells.select("item").distinct()
    roots = written(cut(items, linkage(distances(cells, "item", "place", "v")), clusters), "clusters")
    means = cells.join(roots, "item").groupBy("root", "place").agg(F.avg("v").alias("m"))
    peaks = means.groupBy("root").agg(F.max(F.struct("m", (-F.col("place")).alias("p"))).alias("top")).select("root", (-F.col("top.p")).alias("place"))
    numbered = peaks.withColumn("cluster", F.row_number().over(Window.orderBy("place", "root"))).select("root", "cluster")  # a row for each cluster
    return roots.join(numbered, "root").select(F.col("item").alias(row), "cluster")
