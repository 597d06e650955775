"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    to = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return to.filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("u") % 1_000_003 * (F.col("v") % 1009))).first())


def components(pairs: DataFrame) -> DataFrame:
    """pairs: (a, b) of integers in any order. Gives (node, component) of every node in a pair, component its least node."""
    edges = pairs.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = materialise(edges, "edges"), None
    while (mark := _mark(edges)) != last:
        if not mark[0]:
            break
        before, edges, last = edges, materialise(_small(_large(edges)), "edges"), mark
        discard(before)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
