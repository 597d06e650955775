"""What must hold of results that SQL can't compute: each query recomputes or counts on another way, and its SQL says what the count must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..session import written
from . import queries as q
from .queries import query, table


def _wrong(condition, name: str):
    return F.coalesce(F.sum((~F.coalesce(condition, F.lit(False))).cast("bigint")), F.lit(0)).alias(name)


@query("SELECT 0 AS n_wrong_counts, 0 AS n_wrong_bounds, true AS dense")
def modules_hold(spark, sf):
    """Points and features of each module counted again by a join; bounds around the centre; ids dense from 0."""
    found = q.modules(spark, sf)
    inside = q.anchored_points(spark, sf).join(found.select("anchor_id", "local_idx", "low", "high"), "anchor_id").filter("offset between low and high")
    again = inside.groupBy("anchor_id", "local_idx").agg(F.count("*").alias("n"), F.count_distinct("tf").alias("s"), F.count_distinct(F.when(F.col("score") >= 50, F.col("tf"))).alias("a"))
    both = found.join(again, ["anchor_id", "local_idx"], "left")
    same = (F.col("n") == F.col("n_peaks")) & (F.col("s") == F.col("n_supporting")) & (F.col("a") == F.col("n_assigned"))
    bounds = (F.col("low") <= F.col("center")) & (F.col("center") <= F.col("high")) & (F.col("width") == F.col("high") - F.col("low") + 1) & (F.col("n_supporting") >= 2)
    ids = F.coalesce((F.count_distinct("module_id") == F.count("*")) & (F.min("module_id") == 0) & (F.max("module_id") == F.count("*") - 1), F.lit(True))
    return both.agg(_wrong(same, "n_wrong_counts"), _wrong(bounds, "n_wrong_bounds"), ids.alias("dense"))


@query("SELECT 0 AS n_wrong_places, 0 AS n_wrong_labels")
def elements_hold(spark, sf):
    """Elements' bounds and support; distances, strata and clusters again without tiles."""
    found = q.elements(spark, sf)
    marks = q.anchors(spark, sf).select(F.lit("all").alias("chrom"), F.floor(F.col("anchor") / 60).alias("anchor"))
    bare = found.select("chrom", "low", "high", "center")
    again = iv.gap_clusters(iv.nearest_join(bare, marks, ["chrom"], position="center"), ["chrom"], "center", 200, tie=["low"])
    again = again.select("low", "center", F.col("distance").alias("d"), F.col("cluster").alias("c"), F.col("cluster_size").alias("z"), iv.stratum(F.col("distance"), 5, 50).alias("s"))
    both = found.join(again, ["low", "center"], "left")
    places = (F.col("low") <= F.col("center")) & (F.col("center") <= F.col("high")) & (F.col("n_assigned") >= 3) & (F.col("n_assigned") <= F.col("n_supporting"))
    labels = (F.col("d") == F.col("distance")) & (F.col("c") == F.col("cluster")) & (F.col("z") == F.col("cluster_size")) & (F.col("s") == F.col("stratum"))
    return both.agg(_wrong(places, "n_wrong_places"), _wrong(labels, "n_wrong_labels"))


@query("SELECT count(DISTINCT o_custkey) AS n_rows, 0 AS n_wrong, 5 AS n_programs FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part))")
def nmf_holds(spark, sf):
    """Every customer has weights of sum 1, its dominant program is the largest of them, and every program wins somewhere."""
    w = q.nmf_programs(spark, sf)
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    fine = (F.abs(total - 1) < 1e-9) & (F.element_at("weights", F.col("dominant")) == F.array_max("weights")) & (F.array_min("weights") >= 0)
    return w.agg(F.count("*").alias("n_rows"), _wrong(fine, "n_wrong"), F.count_distinct("dominant").alias("n_programs"))


@query("SELECT a AS archetype, CAST(5 AS BIGINT) AS n, true AS ordered FROM (SELECT unnest([1, 2]) AS a)")
def archetypes_hold(spark, sf):
    """Each archetype loads every program once, by falling loadings that aren't negative."""
    rows = q.archetypes(spark, sf)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "loading"))), lambda x: x["loading"])
    falls = F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get("l", i - 1) >= F.get("l", i)) & (F.array_min("l") >= 0)
    return rows.groupBy("archetype").agg(F.count_distinct("program").alias("n"), listed.alias("l")).select("archetype", "n", falls.alias("ordered"))


@query("SELECT k AS component, true AS fine FROM (SELECT unnest([1, 2, 3]) AS k)")
def stability_holds(spark, sf):
    c = F.col
    return q.stability(spark, sf).select("component", ((c("least") <= c("median")) & c("median").between(0, 1 + 1e-9) & (c("at_90") <= c("at_80"))).alias("fine"))


@query("SELECT k, 3 AS folds, true AS fine FROM (SELECT unnest([1, 2, 3]) AS k)")
def heldout_holds(spark, sf):
    c = F.col
    return q.heldout_cv(spark, sf).select("k", "folds", ((c("rmse") > 0) & (c("auc").isNull() | c("auc").between(0, 1))).alias("fine"))


@query("SELECT count(DISTINCT p_brand) AS n_brands, 4 AS n_clusters, 4 AS most FROM part JOIN lineitem ON l_partkey = p_partkey")
def ward_holds(spark, sf):
    return q.ward_clusters(spark, sf).agg(F.count_distinct("brand").alias("n_brands"), F.count_distinct("cluster").alias("n_clusters"), F.max("cluster").alias("most"))


@query("SELECT CAST(3 AS BIGINT) AS n, CAST(3 AS BIGINT) AS n_a, CAST(3 AS BIGINT) AS n_b, CAST(3 AS BIGINT) AS n_greedy, true AS fine")
def matching_holds(spark, sf):
    """One to one either way, by similarities of non-negative programs."""
    m = q.program_matching(spark, sf)
    return m.agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"), F.count_distinct("greedy").alias("n_greedy"), F.every(F.col("cosine").between(0, 1 + 1e-9)).alias("fine"))


@query("SELECT count(DISTINCT p_brand) AS n, true AS fine FROM part JOIN lineitem ON l_partkey = p_partkey")
def leaf_order(spark, sf):
    """The leaves of the brands' tree hold every brand once, and the tree's heights agree with the distances."""
    from ..operators.gram import distances
    from ..operators.trees import cophenetic, linkage
    from ..operators.trees import leaf_order as leaves

    cells = q.brand_types(spark, sf)[0].select("brand", F.posexplode("x").alias("i", "v"))
    apart = written(distances(cells, "brand", "i", "v"), "apart")
    merges = linkage(apart, "average")
    order = leaves(cells.select("brand").distinct(), merges, "brand")
    alike = cophenetic(apart, merges).agg((F.corr("d", "height") > 0.3).alias("alike"), F.every(F.col("height").isNotNull()).alias("joined"))
    whole = order.agg(F.count("*").alias("n"), ((F.count_distinct("place") == F.count("*")) & (F.min("place") == 0) & (F.max("place") == F.count("*") - 1)).alias("dense"))
    return whole.crossJoin(alike).select("n", (F.col("dense") & F.col("alike") & F.col("joined")).alias("fine"))  # one row each
