"""Plans that must stay: pushed filters, pruned columns, no nested loops over tables."""

import re

import pytest

from peakloom.plans import queries as q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["overlap_join", "point_projection", "nearest_anchor", "multi_bin_occupancy", "coverage_binary", "gap_clusters", "path_strings", "quantile_stats"])
def test_no_nested_loop_or_python(spark, sf, name):
    text = plan(q.QUERIES[name](spark, sf))
    assert not re.search("NestedLoop|Cartesian|Python|Pandas|Arrow", text)


def test_pruned_and_pushed(spark, sf):
    text = plan(q.top_anchor_by_count(spark, sf))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,10.0)" in text
    assert "l_extendedprice" not in text and "l_shipdate" not in text
    assert "WindowGroupLimit" in plan(q.top_members_per_group(spark, sf))


def test_pairs_of_rows_meet_as_blocks(spark, sf):
    """No join of rows on their columns, whose records would be rows squared times columns: blocks meet, and pairs leave them."""
    from peakloom.plans import derived  # noqa: F401  (it registers pearson_filled)

    for name in ("pearson_pairs", "pearson_filled"):
        text = plan(q.QUERIES[name](spark, sf))
        assert "CoGroups" in text and "Join" not in text
    from pyspark.sql import functions as F

    from peakloom.operators import gram

    df = spark.range(6_000).select((F.col("id") % 60).alias("row"), F.floor(F.col("id") / 60).alias("col"), (F.xxhash64("id") % 1000).cast("double").alias("x"))
    sums = gram.pair_sums(df, "row", "col", "x")
    sums.write.format("noop").mode("overwrite").save()
    node, counts = sums._jdf.queryExecution().executedPlan(), []

    def walk(n):
        if "Exchange" in n.nodeName() and n.metrics().contains("shuffleRecordsWritten"):
            counts.append(n.metrics().apply("shuffleRecordsWritten").value())
        for c in range(n.children().size()):
            walk(n.children().apply(c))

    records = 60 * 59 / 2
    assert sums.count() == records
    walk(node.executedPlan() if hasattr(node, "executedPlan") else node)
    assert sum(counts) <= 2 * records + 100  # of the 177,000 pairs of cells that a join would make
