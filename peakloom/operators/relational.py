"""Pairs, top lists, paths, pivots and set comparisons over long (row, column) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts, written


HEAVY = 2000


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.try_divide(shared, a + b - shared)


def lift(shared: Column, a: Column, b: Column, n: Column) -> Column:
    return F.try_divide(shared * n, a * b)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, on equal keys, null with null; right may be made of left. Without keys right is one row."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    if not keys:
        return left.crossJoin(right)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own, so that a table may meet itself
    condition = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, condition, how).drop(*names.values())


def pair_cooccurrence(members: DataFrame, row: str, item: str, floor: int = 5) -> DataFrame:
    """(item_a < item_b, n_shared, n_a, n_b, jaccard, lift) of items that meet in floor rows or more.

    members is made unique first. The self join is on the row key, and its pairs are summed before the second shuffle
    (map-side). Rows of more than HEAVY items are cut into blocks, and their pairs of blocks dealt out, so that no task makes
    more than HEAVY squared of a row's pairs. Item totals join by hash and are broadcast only if Spark finds them small."""
    one = members.select(F.col(row).alias("__row"), F.col(item).alias("item")).distinct()
    sizes = one.groupBy("item").agg(F.count("*").alias("n"))
    n_rows = one.agg(F.count_distinct("__row").alias("n_rows"))
    blocks = one.groupBy("__row").agg(F.ceil(F.count("*") / HEAVY).alias("__n")).filter("__n > 1")
    dealt = one.join(blocks, "__row", "left").withColumn("__own", F.when(F.col("__n").isNull(), 0).otherwise(F.pmod(F.xxhash64("item"), F.col("__n"))))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__n", F.lit(1)) - 1)))
    dealt = dealt.select("__row", "item", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"), "__own")
    left, right = (dealt.withColumnsRenamed({"item": f"item_{s}", "__own": f"__own_{s}"}) for s in "ab")
    met = left.join(right, ["__row", "__i", "__j"]).filter((F.col("item_a") < F.col("item_b")) & ((F.col("__i") == F.col("__j")) | (F.col("__own_a") != F.col("__own_b"))))
    pairs = met.groupBy("item_a", "item_b").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= floor)
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"item_{side}")
    pairs = pairs.crossJoin(n_rows)  # one row
    counts = [F.col(c).cast("double") for c in ("n_shared", "n_a", "n_b", "n_rows")]
    return pairs.select("item_a", "item_b", "n_shared", "n_a", "n_b", F.round(jaccard(*counts[:3]), 4).alias("jaccard"), F.round(lift(*counts), 3).alias("lift"))


def pair_search(pairs: DataFrame, text: str = "", min_shared: int = 0, order: str = "n_shared", limit: int = 50) -> DataFrame:
    """Pairs either of whose items contains the text, whatever its case; an unknown order falls back to n_shared."""
    found = F.upper("item_a").contains(text.upper()) | F.upper("item_b").contains(text.upper())
    order = order if order in ("n_shared", "jaccard", "lift") else "n_shared"
    return pairs.filter(found & (F.col("n_shared") >= min_shared)).orderBy(F.desc(order), "item_a", "item_b").limit(limit)


def pair_stats(pairs: DataFrame, floor: int) -> DataFrame:
    """Counts, and the largest lift over pairs with floor shared or more, or over all if there are none."""
    floored = F.max(F.when(F.col("n_shared") >= floor, F.col("lift")))
    return pairs.agg(F.count("*").alias("n_pairs"), F.max("n_shared").alias("max_shared"), F.coalesce(floored, F.max("lift")).alias("max_lift"))


def partners(members: DataFrame, row: str, item: str, of: str) -> DataFrame:
    """Items that share rows with one item: counts, percentages both ways, Jaccard."""
    one = members.select(F.col(row).alias("__row"), F.col(item).alias("item")).distinct()
    mine = one.filter(F.col("item") == of).select("__row")
    total = mine.agg(F.count("*").alias("n_own"))
    sizes = one.groupBy("item").agg(F.count("*").alias("n_item"))
    met = one.filter(F.col("item") != of).join(mine, "__row", "left_semi").groupBy("item").agg(F.count("*").alias("n_shared"))
    out = met.join(sizes, "item").crossJoin(total)
    pct = lambda n: F.round(100.0 * F.try_divide(F.col("n_shared"), F.col(n)), 2)
    return out.select("item", "n_shared", "n_item", pct("n_own").alias("pct_of_own"), pct("n_item").alias("pct_of_item"), F.round(jaccard(F.col("n_shared"), F.col("n_item"), F.col("n_own")), 4).alias("jaccard"))


def group_cooccurrence(members: DataFrame, row: str, group: str) -> DataFrame:
    """Every ordered pair of groups, the diagonal included, with shared rows and lift."""
    one = members.select(F.col(row).alias("__row"), F.col(group).alias("g")).distinct()
    sizes = one.groupBy("g").agg(F.count("*").alias("n"))
    total = one.agg(F.count_distinct("__row").alias("n_rows"))
    pairs = one.withColumnRenamed("g", "a").join(one.withColumnRenamed("g", "b"), "__row").groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    pairs = pairs.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(total)
    counts = [F.col(c).cast("double") for c in ("n_shared", "n_a", "n_b", "n_rows")]
    return pairs.select("a", "b", "n_shared", F.round(lift(*counts), 3).alias("lift"))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; order must be complete. Spark cuts groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def joined_top(df: DataFrame, by: Sequence[str], item: str, order: Sequence[Column], n: int, name: str = "items") -> DataFrame:
    """The top n items of each group as one text, in order."""
    top = top_per_group(df, by, order, n)
    listed = F.array_sort(F.collect_list(F.struct("rank", item)))
    return top.groupBy(*by).agg(F.concat_ws(", ", F.transform(listed, lambda x: x[item].cast("string"))).alias(name))


def path_strings(df: DataFrame, by: Sequence[str], item: str, order: Sequence[str], name: str = "path") -> DataFrame:
    """Each group's items in order, comma-joined; rows without group or item don't count."""
    full = df.dropna(subset=[*by, item])
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__item"))))
    return full.groupBy(*by).agg(F.concat_ws(",", F.transform(listed, lambda x: x["__item"].cast("string"))).alias(name), F.count("*").alias("n"))


def union_tagged(*frames: tuple[str, DataFrame]) -> DataFrame:
    """UNION ALL with a source tag; a column that a frame lacks is null there."""
    out = None
    for tag, df in frames:
        one = df.withColumn("source", F.lit(tag))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def presence_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of either side: a only, b only or shared."""
    left, right = (x.select(key).distinct().withColumn(f"__{n}", F.lit(True)) for x, n in ((a, "a"), (b, "b")))
    side = F.when(F.col("__b").isNull(), "a only").when(F.col("__a").isNull(), "b only").otherwise("shared")
    return left.join(right, key, "full").select(key, side.alias("side"))


def fill_domain(df: DataFrame, key: str, domain: DataFrame, values: Sequence[str]) -> DataFrame:
    """A row for each key of the domain, 0 where df has none."""
    return domain.join(df, key, "left").fillna(0, list(values))


def percent_of_total(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Shares of each row's count by column value, a column each."""
    counts = df.groupBy(row).pivot(column, list(values)).count().fillna(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return counts.select(row, *[F.round(100.0 * F.try_divide(F.col(v), total), 2).alias(v) for v in values])


def explode_count(df: DataFrame, text: str, separator: str, known: DataFrame | None = None) -> DataFrame:
    """How often each trimmed element of the lists occurs; only elements of known (one column) if given."""
    one = df.select(F.explode(F.split(text, separator)).alias("item")).select(F.trim("item").alias("item")).filter("item <> ''")
    if known is not None:
        one = one.join(known.toDF("item").distinct(), "item", "left_semi")
    return one.groupBy("item").agg(F.count("*").alias("n"))


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df itself, once it is known that no key is repeated."""
    if not (bad := df.groupBy(*key).count().filter("count > 1").limit(1)).isEmpty():
        raise ValueError(f"{', '.join(key)} isn't unique: {bad.first().asDict()}")
    return df


def driver_class(n: Column) -> Column:
    return F.when(n.isNull(), "").when(n == 0, "no-driver").when(n == 1, "single-driver").otherwise("multi-driver")


def max_by_group(df: DataFrame, members: DataFrame, member: str, group: str, category: str, value: str) -> DataFrame:
    """(group, category, value): the largest of the group's members' values, as of a gene's transcripts by tissue."""
    return df.join(members.select(member, group).distinct(), member).groupBy(group, category).agg(F.max(value).alias(value))


def member_means(members: DataFrame, values: DataFrame, module: str, item: str, category: str, value: str) -> DataFrame:
    """(module, category, mean, n_items): mean over a module's distinct items of their values, by category; missing values don't count.

    Members are dealt out by module in shares of about equal work before their values come to them, so that the sums need no other exchange
    and a task holds no more of them in a larger table. Values come once an item and category: no set of items is kept to count them."""
    held = written(members.select(module, item).distinct(), "members")
    each = values.filter(F.col(value).isNotNull()).groupBy(item, category).agg(F.sum(value).alias("__s"), F.count("*").alias("__c"))
    each = written(each, "member_values")
    n = parts(held, times=each.count() / max(1, each.select(item).distinct().count()))
    met = held.repartition(n, module).join(each, item)
    return met.groupBy(module, category).agg((F.sum("__s") / F.sum("__c")).alias("mean"), F.count(item).alias("n_items"))


def matrix_rows(modules: DataFrame, members: DataFrame, module: str, item: str, assigned: str, tile: int = 65_536) -> DataFrame:
    """(row_id, module, item, value 1.0) of the modules with assigned items: row ids are dense from 0 by module number. The module is an
    integer; ranks are summed over ranges of `tile` numbers, so that no task sorts all modules."""
    kept = modules.filter(F.col(assigned) > 0).select(module).distinct().withColumn("__t", F.floor(F.col(module) / tile))
    before = kept.groupBy("__t").agg(F.count("*").alias("__n"))
    before = before.withColumn("__at", F.coalesce(F.sum("__n").over(Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each range
    nth = F.row_number().over(Window.partitionBy("__t").orderBy(module)) - 1
    ids = kept.withColumn("__r", nth).join(before, "__t").select(module, (F.col("__at") + F.col("__r")).alias("row_id"))
    return members.select(module, item).distinct().join(ids, module).select("row_id", module, item, F.lit(1.0).alias("value"))


def collapse(df: DataFrame, group: str, item: str, key: str) -> DataFrame:
    """One row: groups, items, items to a group (the collapse factor), groups of one item, groups that span several keys."""
    per = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(item).alias("n"), F.count_distinct(key).alias("k"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_items"), F.try_divide(F.sum("n"), F.count("*").cast("double")).alias("factor"), F.sum((F.col("n") == 1).cast("bigint")).alias("n_single"), F.sum((F.col("k") > 1).cast("bigint")).alias("n_spanning"))


def any_value(df: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """One value of each column by group; the least, so that results repeat."""
    return df.groupBy(*by).agg(*[F.min(c).alias(c) for c in columns])


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row by column value, a column each, 0 where there are none."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)
