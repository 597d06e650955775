"""Queries over the supplied tables: each applies one or a few operators to whole tables; beside it, the SQL that says the same.

events stand for scored points: user_id is the group (chromosome), seconds the position, event_type the feature, purchases
the anchors, with a strand by their id's parity. Brands in orders stand for features in modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gram
from ..operators import intervals as iv
from ..operators import relational as rel
from ..operators import stats as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86_400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("chrom"), seconds.alias("pos"), F.col("event_type").alias("tf"), F.least(F.floor(F.col("value") * 4), F.lit(1000)).alias("score"))


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return peaks(spark, sf).filter("tf = 'purchase'").select("chrom", F.col("event_id").alias("anchor_id"), F.col("pos").alias("anchor"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"))


P = "peaks AS (SELECT event_id, user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_type AS tf, CAST(least(floor(value * 4), 1000) AS BIGINT) AS score FROM events), anchors AS (SELECT chrom, event_id AS anchor_id, pos AS anchor, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM peaks WHERE tf = 'purchase')"
B = "baskets AS (SELECT DISTINCT l_orderkey AS k, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIRS = f"""{B}, sizes AS (SELECT item, count(*) AS n FROM baskets GROUP BY item), total AS (SELECT count(DISTINCT k) AS n_rows FROM baskets),
shared AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_shared FROM baskets a JOIN baskets b ON a.k = b.k AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5),
pairs AS (SELECT item_a, item_b, n_shared, x.n AS n_a, y.n AS n_b, round(n_shared / (x.n + y.n - n_shared), 4) AS jaccard, round(CAST(n_shared AS DOUBLE) * n_rows / (CAST(x.n AS DOUBLE) * y.n), 3) AS lift
  FROM shared JOIN sizes x ON item_a = x.item JOIN sizes y ON item_b = y.item, total)"""


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("item"))


# pairs and sets


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def pair_cooccurrence(spark, sf):
    return rel.pair_cooccurrence(baskets(spark, sf), "k", "item")


@query(f"WITH {PAIRS} SELECT * FROM pairs WHERE (contains(upper(item_a), 'D#1') OR contains(upper(item_b), 'D#1')) AND n_shared >= 5 ORDER BY lift DESC, item_a, item_b LIMIT 20")
def pair_search(spark, sf):
    return rel.pair_search(pair_cooccurrence(spark, sf), "d#1", 5, "lift", 20)


@query(f"WITH {PAIRS} SELECT count(*) AS n_pairs, max(n_shared) AS max_shared, coalesce(max(lift) FILTER (n_shared >= 50), max(lift)) AS max_lift FROM pairs")
def pair_stats(spark, sf):
    return rel.pair_stats(pair_cooccurrence(spark, sf), 50)


@query(f"""WITH {B}, mine AS (SELECT k FROM baskets WHERE item = 'Brand#1'), total AS (SELECT count(*) AS n_own FROM mine), sizes AS (SELECT item, count(*) AS n_item FROM baskets GROUP BY item),
met AS (SELECT item, count(*) AS n_shared FROM baskets WHERE item <> 'Brand#1' AND k IN (SELECT k FROM mine) GROUP BY item)
SELECT item, n_shared, n_item, round(100.0 * n_shared / n_own, 2) AS pct_of_own, round(100.0 * n_shared / n_item, 2) AS pct_of_item, round(n_shared / (n_item + n_own - n_shared), 4) AS jaccard FROM met JOIN sizes USING (item), total""")
def cobinding_partners(spark, sf):
    return rel.partners(baskets(spark, sf), "k", "item", "Brand#1")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS k, l_returnflag || l_linestatus AS g FROM lineitem), s AS (SELECT g, count(*) AS n FROM m GROUP BY g), t AS (SELECT count(DISTINCT k) AS n_rows FROM m)
SELECT a.g AS a, b.g AS b, count(*) AS n_shared, round(CAST(count(*) AS DOUBLE) * min(n_rows) / (CAST(min(x.n) AS DOUBLE) * min(y.n)), 3) AS lift FROM m a JOIN m b USING (k) JOIN s x ON a.g = x.g JOIN s y ON b.g = y.g, t GROUP BY 1, 2""")
def group_cooccurrence_lift(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("g"))
    return rel.group_cooccurrence(rows, "l_orderkey", "g")


@query("""WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS rank FROM c)
SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY rank) AS top_parts FROM r WHERE rank <= 5 GROUP BY l_suppkey""")
def top_members_per_group(spark, sf):
    good = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    sums = table(spark, sf, "lineitem").join(good, "l_suppkey", "left_semi").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return rel.joined_top(sums, ["l_suppkey"], "l_partkey", [F.desc("q"), F.col("l_partkey")], 5, "top_parts")


@query("""WITH u AS (SELECT 'part' AS source, p_type AS term, p_brand AS grp, p_retailprice AS v FROM part UNION ALL SELECT 'supplier', NULL, CAST(s_nationkey AS VARCHAR), s_acctbal FROM supplier)
SELECT coalesce(term, '') AS term, count(DISTINCT CASE WHEN source = 'part' THEN grp END) AS n_brands, count(DISTINCT CASE WHEN source = 'supplier' THEN grp END) AS n_nations, min(v) AS least FROM u GROUP BY 1""")
def term_union_summary(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_type").alias("term"), F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("v"))
    supplier = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("grp"), F.col("s_acctbal").alias("v"))
    u = rel.union_tagged(("part", part), ("supplier", supplier))
    of = lambda s: F.count_distinct(F.when(F.col("source") == s, F.col("grp")))
    return u.groupBy(F.coalesce("term", F.lit("")).alias("term")).agg(of("part").alias("n_brands"), of("supplier").alias("n_nations"), F.min("v").alias("least"))


@query("SELECT p_brand AS grp, count(*) AS n, min(p_retailprice) AS least FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY p_brand ORDER BY least, grp LIMIT 10")
def term_lookup(spark, sf):
    part = table(spark, sf, "part")
    one = part.agg(F.min("p_type").alias("p_type"))
    return part.join(one, "p_type", "left_semi").groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("least")).orderBy("least", "grp").limit(10)


@query("SELECT p_partkey, 'p_type' AS tag, p_type AS value FROM part WHERE p_type <> '' UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE p_brand IS NOT NULL")
def tag_view_unpivot(spark, sf):
    return table(spark, sf, "part").unpivot("p_partkey", ["p_type", "p_brand"], "tag", "value").filter("value <> ''")


@query("""SELECT c_custkey, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_quantity >= 10 GROUP BY c_custkey ORDER BY n DESC, c_custkey LIMIT 25""")
def top_anchor_by_count(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity >= 10").select("l_orderkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    known = table(spark, sf, "customer").select("c_custkey")
    return lines.join(orders, "l_orderkey").join(known, "c_custkey", "left_semi").groupBy("c_custkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most")).orderBy(F.desc("n"), "c_custkey").limit(25)


@query(f"WITH {P} SELECT tf, count(*) FILTER (event_id % 2 = 0) AS plus, count(*) FILTER (event_id % 2 = 1) AS minus, round(count(*) FILTER (event_id % 2 = 0) / count(*), 4) AS share FROM peaks GROUP BY tf")
def strand_distribution(spark, sf):
    plus, minus = (F.sum((F.col("event_id") % 2 == k).cast("bigint")) for k in (0, 1))
    return peaks(spark, sf).groupBy("tf").agg(plus.alias("plus"), minus.alias("minus"), F.round(plus / F.count("*"), 4).alias("share"))


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority, count(l_orderkey) FILTER (l_returnflag = 'R') AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderpriority, CASE WHEN n = 0 THEN 'no-driver' WHEN n = 1 THEN 'single-driver' ELSE 'multi-driver' END AS class, count(*) AS n_orders FROM c GROUP BY 1, 2""")
def driver_class_distribution(spark, sf):
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    per = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").dropDuplicates().join(returned, "o_orderkey", "left")
    return per.groupBy("o_orderpriority", rel.driver_class(F.coalesce("n", F.lit(0))).alias("class")).agg(F.count("*").alias("n_orders"))


@query("SELECT l_linestatus, round(100.0 * count(*) FILTER (l_returnflag = 'A') / count(*), 2) AS A, round(100.0 * count(*) FILTER (l_returnflag = 'N') / count(*), 2) AS N, round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 2) AS R FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_linestatus")
def pivot_pct(spark, sf):
    return rel.percent_of_total(table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "N", "R")), "l_linestatus", "l_returnflag", ["A", "N", "R"])


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN b.l_partkey IS NULL THEN 'a only' WHEN a.l_partkey IS NULL THEN 'b only' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""")
def presence_diff(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity > 40")
    return rel.presence_diff(lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'"), "l_partkey")


@query("""WITH q AS (SELECT l_returnflag AS f, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT f, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY q DESC, l_partkey) AS r FROM q) WHERE r <= 100),
n AS (SELECT f, count(*) AS n FROM t GROUP BY f)
SELECT x.f AS a, y.f AS b, count(z.l_partkey) AS shared, round(count(z.l_partkey) / (min(x.n) + min(y.n) - count(z.l_partkey)), 4) AS jaccard
FROM n x JOIN n y ON x.f < y.f LEFT JOIN t w ON w.f = x.f LEFT JOIN t z ON z.f = y.f AND z.l_partkey = w.l_partkey GROUP BY 1, 2""")
def top_set_jaccard(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_partkey").agg(F.sum("l_quantity").alias("q"))
    top = rel.top_per_group(sums, ["f"], [F.desc("q"), F.col("l_partkey")], 100)
    pairs = rel.pair_cooccurrence(top, "l_partkey", "f", floor=1)
    flags = top.select("f").distinct()
    every = flags.withColumnRenamed("f", "a").join(flags.withColumnRenamed("f", "b"), F.col("a") < F.col("b"))
    return every.join(pairs.select(F.col("item_a").alias("a"), F.col("item_b").alias("b"), F.col("n_shared").alias("shared"), "jaccard"), ["a", "b"], "left").fillna(0)


@query("""WITH v AS (SELECT n_name, l_returnflag AS f, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 45 GROUP BY 1, 2),
a AS (SELECT n_name, n FROM v WHERE f = 'A'), b AS (SELECT n_name, n FROM v WHERE f = 'R')
SELECT coalesce(a.n_name, b.n_name) AS n_name, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM a FULL JOIN b ON a.n_name = b.n_name""")
def outer_compare(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_quantity > 45").select("l_suppkey", "l_returnflag")
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    counts = lines.join(named, "l_suppkey").groupBy("n_name", "l_returnflag").agg(F.count("*").alias("n"))
    a, b = (counts.filter(F.col("l_returnflag") == f).select("n_name", F.col("n").alias(c)) for f, c in (("A", "a"), ("R", "b")))
    return a.join(b, "n_name", "full").fillna(0)


@query("SELECT k AS p_size, count(p_partkey) AS n FROM (SELECT unnest(range(1, 61)) AS k) LEFT JOIN part ON p_size = k GROUP BY k")
def domain_fill(spark, sf):
    counts = table(spark, sf, "part").groupBy(F.col("p_size").cast("bigint").alias("p_size")).agg(F.count("*").alias("n"))
    return rel.fill_domain(counts, "p_size", spark.range(1, 61).withColumnRenamed("id", "p_size"), ["n"])


@query("SELECT item, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS item FROM part) WHERE item <> '' GROUP BY item")
def explode_count(spark, sf):
    return rel.explode_count(table(spark, sf, "part"), "p_name", " ")


PATHS = "paths AS (SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, p_brand) AS path, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"


@query(f"WITH {PATHS} SELECT * FROM paths")
def path_strings(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part, "l_partkey")
    return rel.path_strings(lines, ["l_orderkey"], "p_brand", ["l_linenumber", "l_partkey", "l_suppkey"])


@query(f"WITH {PATHS} SELECT path, count(*) AS n_orders FROM paths GROUP BY path ORDER BY n_orders DESC, path LIMIT 50")
def top_paths(spark, sf):
    return path_strings(spark, sf).groupBy("path").agg(F.count("*").alias("n_orders")).orderBy(F.desc("n_orders"), "path").limit(50)


# statistics

NATION = "v AS (SELECT p_brand AS row, n_name AS col, avg(l_extendedprice) AS x FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


def nation_values(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("row"))
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("col"))
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    return lines.join(part, "l_partkey").join(named, "l_suppkey").groupBy("row", "col").agg(F.avg("l_extendedprice").alias("x"))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("""SELECT p_brand, l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
round(stddev_samp(l_extendedprice), 4) AS std, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS sem, round(greatest(avg(l_extendedprice) - quantile_cont(l_extendedprice, 0.25), 0), 4) AS below, round(greatest(quantile_cont(l_extendedprice, 0.75) - avg(l_extendedprice), 0), 4) AS above
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) >= 5""")
def quantile_stats(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice").join(part, "l_partkey")
    return rounded(st.error_bars(st.quantile_stats(lines, ["p_brand", "l_returnflag"], "l_extendedprice").filter("n >= 5")), 4, "mean", "q1", "median", "q3", "std", "sem", "below", "above")


ESSENTIAL = "f AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean, median(o_totalprice) AS median, avg(CASE WHEN o_totalprice < 50000 THEN 1.0 ELSE 0.0 END) AS fraction FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def segment_fractions(spark, sf):
    segment = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return st.fraction_below(table(spark, sf, "orders").join(segment, "o_custkey"), ["c_mktsegment", "o_orderpriority"], "o_totalprice", 50_000)


@query(f"WITH {ESSENTIAL} SELECT c_mktsegment, o_orderpriority, n, round(mean, 4) AS mean, round(median, 4) AS median, round(fraction, 6) AS fraction FROM f")
def fraction_below(spark, sf):
    return rounded(rounded(segment_fractions(spark, sf), 4, "mean", "median"), 6, "fraction")


@query(f"WITH {ESSENTIAL}, r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY median, o_orderpriority) AS k FROM f) SELECT c_mktsegment, o_orderpriority, round(median, 4) AS median FROM r WHERE k = 1")
def most_extreme_group(spark, sf):
    return rounded(rel.top_per_group(segment_fractions(spark, sf), ["c_mktsegment"], [F.col("median"), F.col("o_orderpriority")], 1).select("c_mktsegment", "o_orderpriority", "median"), 4, "median")


@query(f"WITH {NATION} SELECT row, round(sum(1 - x / m) / (count(*) - 1), 6) AS tau, count(*) AS n FROM v JOIN (SELECT row, max(x) AS m FROM v GROUP BY row) USING (row) GROUP BY row")
def tau_specificity(spark, sf):
    return rounded(st.tau(nation_values(spark, sf), "row", "x"), 6, "tau")


@query(f"WITH {NATION} SELECT row, arg_max(col, x) AS top, round(max(x), 2) AS top_value FROM v GROUP BY row")
def top_tissue(spark, sf):
    return rounded(st.top_category(nation_values(spark, sf), "row", "col", "x"), 2, "top_value")


MONTHS = "m AS (SELECT p_brand AS row, date_trunc('month', l_shipdate) AS t, sum(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def months(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("row"))
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice").join(part, "l_partkey")
    return lines.groupBy("row", F.trunc("l_shipdate", "month").alias("t")).agg(F.sum("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y"))


@query(f"WITH {MONTHS} SELECT a.row AS a, b.row AS b, round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM m a JOIN m b ON a.t = b.t AND a.row < b.row GROUP BY 1, 2 HAVING count(*) >= 12")
def pearson_pairs(spark, sf):
    return rounded(gram.pairwise_pearson(months(spark, sf), "row", "t", "x", least=12), 6, "r")


@query(f"WITH {MONTHS} SELECT row, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM m GROUP BY row HAVING count(*) >= 3")
def ols_line(spark, sf):
    return rounded(rounded(st.ols(months(spark, sf), ["row"], "x", "y").filter("n >= 3").select("row", "n", "slope", "intercept"), 6, "slope"), 4, "intercept")


@query(f"""WITH {MONTHS}, r AS (SELECT a.row AS a, b.row AS b, corr(a.x, b.x) AS r FROM m a JOIN m b ON a.t = b.t AND a.row <> b.row GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT a, arg_max(b, abs(r)) AS driver, round(arg_max(r, abs(r)), 6) AS driver_r, count(*) FILTER (abs(r) >= 0.2) AS n_high FROM r GROUP BY a""")
def driver_summary(spark, sf):
    m = months(spark, sf)
    r = gram.pairwise_pearson(m, "row", "t", "x", least=12, other=m).filter("a <> b")
    best = F.max(F.struct(F.abs("r").alias("s"), "b", "r")).alias("best")
    return rounded(r.groupBy("a").agg(best, F.sum((F.abs("r") >= 0.2).cast("bigint")).alias("n_high")).select("a", F.col("best.b").alias("driver"), F.col("best.r").alias("driver_r"), "n_high"), 6, "driver_r")


@query(f"""WITH {MONTHS}, q AS (SELECT row, quantile_cont(x, 0.75) AS qx, quantile_cont(y, 0.75) AS qy FROM m GROUP BY row)
SELECT row, count(*) AS n_supporting, CAST(arg_max(t, x * y) AS DATE) AS top FROM m JOIN q USING (row) WHERE x >= qx AND y >= qy GROUP BY row""")
def supporting_cells(spark, sf):
    return st.supporting(months(spark, sf), "row", "t", "x", "y")


@query("""WITH bought AS (SELECT DISTINCT c_custkey, c_mktsegment, o_orderpriority AS term FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 120000),
u AS (SELECT DISTINCT c_custkey FROM customer), fg AS (SELECT DISTINCT c_mktsegment AS g, c_custkey FROM customer WHERE c_acctbal > 0),
k AS (SELECT g, term, count(*) AS k FROM fg JOIN (SELECT DISTINCT c_custkey, term FROM bought) USING (c_custkey) GROUP BY 1, 2),
c AS (SELECT g, term, k, n, big_k, big_n FROM k JOIN (SELECT g, count(*) AS n FROM fg GROUP BY g) USING (g) JOIN (SELECT term, count(DISTINCT c_custkey) AS big_k FROM bought GROUP BY term) USING (term), (SELECT count(*) AS big_n FROM u) WHERE k >= 1 AND big_k >= 3),
t AS (SELECT *, unnest(range(k, least(n, big_k) + 1)) AS x FROM c),
p AS (SELECT g, term, k, n, big_k, big_n, least(1.0, sum(CASE WHEN n - x > big_n - big_k THEN 0 ELSE exp(lgamma(big_k + 1) - lgamma(x + 1) - lgamma(big_k - x + 1) + lgamma(big_n - big_k + 1) - lgamma(n - x + 1) - lgamma(greatest(big_n - big_k - n + x, 0) + 1) - lgamma(big_n + 1) + lgamma(n + 1) + lgamma(big_n - n + 1)) END)) AS p FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS r, count(*) OVER (PARTITION BY g) AS m FROM p)
SELECT g, term, k, n, big_k, big_n, round(p, 6) AS p_value, round(((k + 0.5) / (n - k + 0.5)) / ((big_k - k + 0.5) / (big_n - big_k - (n - k) + 0.5)), 6) AS odds_ratio,
round(least(1.0, min(p * m / r) OVER (PARTITION BY g ORDER BY p DESC, r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r""")
def hypergeom_bh(spark, sf):
    customer = table(spark, sf, "customer")
    bought = table(spark, sf, "orders").filter("o_totalprice > 120000").select(F.col("o_orderpriority").alias("term"), F.col("o_custkey").alias("item"))
    universe = customer.select(F.col("c_custkey").alias("item"))
    foreground = customer.filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("item"))
    return rounded(st.enrichment(foreground, bought, universe, "g"), 6, "p_value", "odds_ratio", "q_value").select("g", "term", "k", "n", "big_k", "big_n", "p_value", "odds_ratio", "q_value")


@query("""WITH d AS (SELECT label AS a, list_position(embedding, list_max(embedding)) AS b FROM embeddings), c AS (SELECT a, b, count(*) AS c FROM d GROUP BY 1, 2),
t AS (SELECT sum(c * (c - 1) / 2) AS ij, sum(c) AS n FROM c), x AS (SELECT sum(c * (c - 1) / 2) AS i FROM (SELECT sum(c) AS c FROM c GROUP BY a)), y AS (SELECT sum(c * (c - 1) / 2) AS j FROM (SELECT sum(c) AS c FROM c GROUP BY b))
SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari, CAST(n AS BIGINT) AS n FROM t, x, y""")
def ari(spark, sf):
    return rounded(st.adjusted_rand(table(spark, sf, "embeddings").select(F.col("label").alias("a"), F.array_position("embedding", F.array_max("embedding")).alias("b")), "a", "b"), 6, "ari")


@query("""WITH d AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM d)
SELECT round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM r""")
def auc_rank(spark, sf):
    scored = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(st.auc(scored, "n_chars", "quality"), 6, "auc")


def labellings(spark, sf):
    """Each dimension of the embeddings as a labelling of all of them by its sign."""
    runs = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("seed", "x"))
    return runs.select("seed", F.col("vec_id").alias("item"), (F.col("x") > 0).cast("int").alias("label"))


SIGNS = "l AS (SELECT s AS seed, vec_id AS item, (embedding[s] > 0)::INT AS label FROM embeddings, (SELECT unnest(range(1, 65)) AS s) WHERE s <= len(embedding))"


@query(f"""WITH {SIGNS}, c AS (SELECT a.item AS a, b.item AS b, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS c FROM l a JOIN l b ON a.seed = b.seed GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT item) FROM l) AS n_items, round(avg(c), 6) AS mean, round(avg(4 * (c - 0.5) * (c - 0.5)), 6) AS dispersion FROM c""")
def consensus_dispersion(spark, sf):
    """How often 64 labellings put two of all items together, and how decided that is; the SQL makes the items-by-items matrix."""
    return rounded(st.consensus_dispersion(labellings(spark, sf), "seed", "item", "label"), 6, "mean", "dispersion")


@query("""WITH d AS (SELECT l_returnflag AS s, l_quantity AS c, l_linestatus = 'O' AS fg FROM lineitem), e AS (SELECT [quantile_cont(c, 0.25), quantile_cont(c, 0.5), quantile_cont(c, 0.75)] AS e FROM d),
b AS (SELECT s, fg, (c > e[1])::INT + (c > e[2])::INT + (c > e[3])::INT AS bin FROM d, e),
w AS (SELECT bin, count(*) AS w FROM b WHERE fg GROUP BY bin), o AS (SELECT s, bin, count(*) FILTER (fg) AS f, count(*) AS a FROM b GROUP BY 1, 2), t AS (SELECT bin, count(*) FILTER (fg) AS f, count(*) AS a FROM b GROUP BY bin)
SELECT s, round(sum(w * log2((o.f / t.f + 1e-9) / (o.a / t.a + 1e-9))) / sum(w), 6) AS log2fe FROM o JOIN t USING (bin) JOIN w USING (bin) GROUP BY s""")
def complexity_matched_fe(spark, sf):
    from ..operators.factor import matched_enrichment

    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("s"), F.col("l_quantity").alias("c"), (F.col("l_linestatus") == "O").alias("fg"))
    return rounded(matched_enrichment(rows, "s", "c", "fg", 4), 6, "log2fe")


# intervals


@query(f"""WITH {P}, w AS (SELECT chrom, anchor_id, greatest(anchor - {DAY}, 0) AS s, anchor + {DAY} + 1 AS e FROM anchors), b AS (SELECT event_id, tf, chrom, greatest(pos - 12, 0) AS s, pos + 13 AS e FROM peaks)
SELECT b.event_id, w.anchor_id, b.tf FROM b JOIN w ON b.chrom = w.chrom AND b.s < w.e AND w.s < b.e""")
def overlap_join(spark, sf):
    start, end = iv.recenter(F.col("pos"), F.col("pos"))
    blocks = peaks(spark, sf).select("event_id", "tf", "chrom", start.alias("start"), end.alias("end"))
    windows = anchors(spark, sf).select("chrom", "anchor_id", F.greatest(F.col("anchor") - DAY, F.lit(0)).alias("r_start"), (F.col("anchor") + DAY + 1).alias("r_end"))
    return iv.overlap_join(blocks, windows, ["chrom"], 2 * DAY).select("event_id", "anchor_id", "tf")


@query(f"""WITH {P} SELECT event_id, anchor_id, CASE WHEN strand = '+' THEN pos - anchor ELSE anchor - pos END AS offset_, score FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - {DAY} AND anchor + {DAY}""")
def point_projection(spark, sf):
    windows = anchors(spark, sf).withColumns({"low": F.col("anchor") - DAY, "high": F.col("anchor") + DAY})
    met = iv.point_in_interval_join(peaks(spark, sf), windows, ["chrom"], 2 * DAY)
    return met.select("event_id", "anchor_id", iv.project_point(F.col("pos"), F.col("anchor"), F.col("strand")).alias("offset_"), "score")


@query(f"""WITH {P}, h AS (SELECT DISTINCT anchor_id, tf, score FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - {DAY} AND anchor + {DAY})
SELECT s AS min_score, count(DISTINCT (anchor_id, tf)) AS n FROM (SELECT unnest([0, 50, 100, 200, 400]) AS s) JOIN h ON score >= s GROUP BY s""")
def assignments_at_scores(spark, sf):
    windows = anchors(spark, sf).select("chrom", "anchor_id", (F.col("anchor") - DAY).alias("low"), (F.col("anchor") + DAY).alias("high"))
    best = iv.point_in_interval_join(peaks(spark, sf), windows, ["chrom"], 2 * DAY).groupBy("anchor_id", "tf").agg(F.max("score").alias("score"))
    floors = F.explode(F.filter(F.array(*[F.lit(s) for s in (0, 50, 100, 200, 400)]), lambda s: s <= F.col("score")))
    return best.select(floors.alias("min_score")).groupBy("min_score").agg(F.count("*").alias("n"))


STEPS = "SELECT tf, start, \"end\", value FROM (SELECT tf, p AS start, lead(p) OVER (PARTITION BY tf ORDER BY p) AS \"end\", sum(w) OVER (PARTITION BY tf ORDER BY p ROWS UNBOUNDED PRECEDING) AS value FROM (SELECT tf, p, CAST(sum(w) AS BIGINT) AS w FROM (SELECT tf, s AS p, {w} AS w FROM {b} UNION ALL SELECT tf, e, -({w}) FROM {b}) GROUP BY 1, 2)) WHERE value <> 0 AND \"end\" IS NOT NULL"
BLOCKS = "b AS (SELECT tf, greatest(pos - 1800, 0) AS s, pos + 1801 AS e, score FROM peaks)"
MERGED = "o AS (SELECT *, max(e) OVER (PARTITION BY tf ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b), i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY tf ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o), merged AS (SELECT tf, min(s) AS s, max(e) AS e FROM i GROUP BY tf, k)"


def blocks(spark, sf):
    return peaks(spark, sf).select("tf", F.greatest(F.col("pos") - 1800, F.lit(0)).alias("start"), (F.col("pos") + 1801).alias("end"), "score")


@query(f"WITH {P}, {BLOCKS}, {MERGED} " + STEPS.format(w="1", b="merged").replace("value FROM (", "CAST(value AS BIGINT) AS value FROM (", 1))
def coverage_binary(spark, sf):
    return iv.coverage(iv.merge_intervals(blocks(spark, sf), ["tf"], tile=DAY), ["tf"], tile=DAY)


@query(f"WITH {P}, {BLOCKS} " + STEPS.format(w="score", b="b").replace("value FROM (", "CAST(value AS BIGINT) AS value FROM (", 1))
def coverage_score(spark, sf):
    return iv.coverage(blocks(spark, sf), ["tf"], weight=F.col("score"), tile=DAY)


@query(f"WITH {P}, {BLOCKS} " + STEPS.format(w="1", b="b").replace("value FROM (", "CAST(value AS BIGINT) AS value FROM (", 1))
def coverage_raw(spark, sf):
    return iv.coverage(blocks(spark, sf), ["tf"], tile=DAY)


@query(f"""WITH {P}, {BLOCKS}, lo AS (SELECT CAST(floor(min(s) / 3600) * 3600 AS BIGINT) AS lo FROM b), c AS (SELECT tf, s - lo AS s, e - lo AS e FROM b, lo), k AS (SELECT tf, s, e, unnest(range(s // 3600, (e - 1) // 3600 + 1)) AS bin FROM c)
SELECT tf, bin, CAST(sum(least(e, (bin + 1) * 3600) - greatest(s, bin * 3600)) AS BIGINT) AS value FROM k WHERE bin < (SELECT max(e) // 3600 FROM c) GROUP BY 1, 2""")
def rebinned_coverage(spark, sf):
    first, end = blocks(spark, sf).agg(F.floor(F.min("start") / 3600) * 3600, F.max("end")).first()
    return iv.rebin(iv.coverage(blocks(spark, sf), ["tf"], tile=DAY), ["tf"], 3600, ((end or 0) - (first or 0)) // 3600, first or 0)


@query(f"WITH {P}, {BLOCKS}, {MERGED} SELECT tf, s AS start, e AS \"end\" FROM merged")
def merge_intervals(spark, sf):
    return iv.merge_intervals(blocks(spark, sf), ["tf"], tile=DAY)


@query(f"WITH {P} SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY chrom, tf ORDER BY pos RANGE BETWEEN {10 * DAY} PRECEDING AND {10 * DAY} FOLLOWING), 6) AS weight FROM peaks")
def local_weight(spark, sf):
    return rounded(iv.local_weights(peaks(spark, sf), ["chrom", "tf"], reach=10 * DAY, tile=30 * DAY).select("event_id", "weight"), 6, "weight")


@query(f"""WITH {P}, g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, event_id) > {2 * DAY} THEN 1 ELSE 0 END AS o FROM peaks), c AS (SELECT *, CAST(sum(o) OVER (PARTITION BY chrom ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
SELECT event_id, cluster, count(*) OVER (PARTITION BY chrom, cluster) AS cluster_size FROM c""")
def gap_clusters(spark, sf):
    return iv.gap_clusters(peaks(spark, sf), ["chrom"], gap=2 * DAY, tie=["event_id"], tile=5 * DAY).select("event_id", "cluster", "cluster_size")


def _nearest_sql(tie: str) -> str:
    return f"n AS (SELECT event_id, tf, pos, arg_min(anchor, (abs(pos - anchor), {'anchor' if tie == 'left' else '-anchor'})) AS nearest FROM peaks LEFT JOIN (SELECT DISTINCT chrom, anchor FROM anchors) USING (chrom) WHERE tf <> 'purchase' GROUP BY 1, 2, 3)"


@query(f"WITH {P}, {_nearest_sql('left')} SELECT event_id, nearest, pos - nearest AS distance FROM n")
def nearest_anchor(spark, sf):
    return iv.nearest_join(peaks(spark, sf).filter("tf <> 'purchase'"), anchors(spark, sf), ["chrom"], tile=10 * DAY).select("event_id", "nearest", "distance")


@query(f"WITH {P}, {_nearest_sql('right')} SELECT event_id, nearest, pos - nearest AS distance FROM n WHERE abs(pos - nearest) <= {3 * DAY}")
def nearest_anchor_within(spark, sf):
    return iv.nearest_join(peaks(spark, sf).filter("tf <> 'purchase'"), anchors(spark, sf), ["chrom"], tie="right", within=3 * DAY, tile=10 * DAY).select("event_id", "nearest", "distance")


@query(f"WITH {P}, {_nearest_sql('left')} SELECT CASE WHEN abs(pos - nearest) <= {DAY} THEN 'promoter' WHEN abs(pos - nearest) <= {5 * DAY} THEN 'proximal' ELSE 'distal' END AS stratum, count(*) AS n FROM n GROUP BY 1")
def strata_counts(spark, sf):
    near = iv.nearest_join(peaks(spark, sf).filter("tf <> 'purchase'"), anchors(spark, sf), ["chrom"], tile=10 * DAY)
    return near.groupBy(iv.stratum(F.col("distance"), DAY, 5 * DAY).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"WITH {P}, {_nearest_sql('left')} SELECT tf, round(avg(CASE WHEN abs(pos - nearest) <= {DAY} THEN 1.0 ELSE 0.0 END), 6) AS near, round(avg(CASE WHEN abs(pos - nearest) > {DAY} AND abs(pos - nearest) <= {5 * DAY} THEN 1.0 ELSE 0.0 END), 6) AS middle, round(avg(CASE WHEN abs(pos - nearest) > {5 * DAY} THEN 1.0 ELSE 0.0 END), 6) AS far, median(abs(pos - nearest)) AS median_distance, count(*) AS n FROM n WHERE nearest IS NOT NULL GROUP BY tf")
def tf_locality(spark, sf):
    near = iv.nearest_join(peaks(spark, sf).filter("tf <> 'purchase'"), anchors(spark, sf), ["chrom"], tile=10 * DAY)
    return rounded(iv.locality(near, "tf", near=DAY, far=5 * DAY), 6, "near", "middle", "far")


@query(f"""WITH {P}, l AS (SELECT chrom, max(pos) + 1 AS len FROM peaks GROUP BY chrom),
s AS (SELECT k AS shuffle, chrom, tf, (pos + CAST('0x' || substr(md5('7|' || k || '|' || chrom || '|' || tf), 1, 8) AS BIGINT)) % len AS pos FROM peaks JOIN l USING (chrom), (SELECT unnest(range(1, 6)) AS k)),
o AS (SELECT count(DISTINCT tf) AS n FROM peaks GROUP BY chrom, pos // {3 * DAY}), z AS (SELECT shuffle, count(DISTINCT tf) AS n FROM s GROUP BY shuffle, chrom, pos // {3 * DAY}), f AS (SELECT unnest(range(1, 6)) AS floor)
SELECT floor, (SELECT count(*) FROM o WHERE n >= floor) AS observed, round((SELECT count(*) FROM z WHERE n >= floor) / 5, 6) AS null_mean, round((SELECT count(*) FROM z WHERE n >= floor) / 5 / nullif((SELECT count(*) FROM o WHERE n >= floor), 0), 6) AS fdr FROM f""")
def circular_shift_fdr(spark, sf):
    at = F.floor(F.col("pos") / (3 * DAY))
    points = peaks(spark, sf).select("chrom", "tf", "pos")
    seen = lambda df, *by: df.groupBy(*by, "chrom", at.alias("w")).agg(F.count_distinct("tf").alias("n"))
    shifted = iv.circular_shift(points, ["tf"], "chrom", "pos", 5, 7)
    return rounded(st.support_fdr(seen(points), seen(shifted, "shuffle"), "shuffle", "n", 1, 5, 5), 6, "null_mean", "fdr")


@query(f"""WITH {P} SELECT DISTINCT tf, anchor_id, (d > -{DAY // 2})::INT + (d > -3600)::INT + (d > 3600)::INT + (d > {DAY // 2})::INT AS bin
FROM (SELECT tf, anchor_id, CASE WHEN strand = '+' THEN pos - anchor ELSE anchor - pos END AS d FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - {DAY} AND anchor + {DAY})""")
def multi_bin_occupancy(spark, sf):
    windows = anchors(spark, sf).withColumns({"low": F.col("anchor") - DAY, "high": F.col("anchor") + DAY})
    return iv.multi_bin_occupancy(peaks(spark, sf), windows, ["chrom"], "tf", "anchor_id", [-DAY // 2, -3600, 3600, DAY // 2], 2 * DAY)


@query(f"""WITH {P} SELECT tf, count(DISTINCT anchor_id) AS n_bound, round(count(DISTINCT anchor_id) / (SELECT count(*) FROM anchors), 6) AS share FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND greatest(pos - 12, 0) < anchor + 21601 AND pos + 13 > greatest(anchor - 21600, 0) GROUP BY tf""")
def core_occupancy(spark, sf):
    start, end = iv.recenter(F.col("pos"), F.col("pos"))
    near = peaks(spark, sf).select("tf", "chrom", start.alias("start"), end.alias("end"))
    windows = anchors(spark, sf).select("chrom", "anchor_id", F.greatest(F.col("anchor") - 21_600, F.lit(0)).alias("r_start"), (F.col("anchor") + 21_601).alias("r_end"))
    n = anchors(spark, sf).agg(F.count("*").alias("n_anchors"))
    bound = iv.occupancy(near, windows, ["chrom"], ["tf", "anchor_id"], 43_200).groupBy("tf").agg(F.count("*").alias("n_bound"))
    return bound.crossJoin(n).select("tf", "n_bound", F.round(F.col("n_bound") / F.col("n_anchors"), 6).alias("share"))


@query(f"""WITH {P}, x AS (SELECT DISTINCT tf AS item, pos // {DAY} AS unit, chrom AS e FROM peaks), h AS (SELECT item, e, (row_number() OVER (PARTITION BY item ORDER BY md5(CAST(e AS VARCHAR)), e) - 1) % 2 AS half FROM (SELECT DISTINCT item, e FROM x)),
u AS (SELECT item, unit, max((half = 0)::INT) AS a, max((half = 1)::INT) AS b FROM x JOIN h USING (item, e) GROUP BY 1, 2), t AS (SELECT count(DISTINCT unit) AS n FROM x),
g AS (SELECT item, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_both FROM u GROUP BY item)
SELECT item, n_a, n_b, n_both, round((n_both / n_a + n_both / n_b) / 2, 6) AS raw, round(CASE WHEN least(n_a, n_b) <= n_a * n_b / n THEN 0 ELSE (n_both - n_a * n_b / n) / (least(n_a, n_b) - n_a * n_b / n) END, 6) AS corrected FROM g, t""")
def split_half_replication(spark, sf):
    rows = peaks(spark, sf).select(F.col("tf").alias("item"), F.floor(F.col("pos") / DAY).alias("unit"), F.col("chrom").alias("e"))
    return rounded(st.split_half(rows, "item", "unit", "e"), 6, "raw", "corrected")


# segments, factors, clusters: no SQL; tests hold them against plain NumPy


def anchored_points(spark, sf, unit: int = 60):
    """Points around anchors on a grid of minutes, within 1,500 of them."""
    windows = anchors(spark, sf).withColumns({"low": F.col("anchor") - 1500 * unit, "high": F.col("anchor") + 1500 * unit})
    met = iv.point_in_interval_join(peaks(spark, sf), windows, ["chrom"], 3000 * unit)
    offset = F.floor(iv.project_point(F.col("pos"), F.col("anchor"), F.col("strand")) / unit).cast("int")
    return met.select("anchor_id", "chrom", "anchor", "strand", "tf", "score", offset.alias("offset"))


@query()
def modules(spark, sf):
    from ..operators.segment import Segmenter, anchor_modules, module_ids

    return module_ids(anchor_modules(anchored_points(spark, sf), "anchor_id", "tf", min_score=50, segmenter=Segmenter(sigma=100)), "anchor_id")


@query()
def elements(spark, sf):
    from ..operators.segment import Segmenter, discover, label_elements

    day = peaks(spark, sf).select(F.lit("all").alias("chrom"), "pos", "tf", "score")
    found = discover(day, "chrom", "tf", min_score=50, floor=3, reach=1500, tile=5_000, grid=60, segmenter=Segmenter(sigma=25, mode="constant"))
    marks = anchors(spark, sf).select(F.lit("all").alias("chrom"), F.floor(F.col("anchor") / 60).alias("anchor"))
    return label_elements(found, marks, "chrom", gap=200, near=5, far=50)


@query(f"""WITH {P}, o AS (SELECT tf, CAST(floor((CASE WHEN strand = '+' THEN pos - anchor ELSE anchor - pos END) / 3600.0) AS BIGINT) AS bin, anchor_id FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - {DAY} AND anchor + {DAY}),
w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY anchor_id, tf) AS weight FROM o) SELECT bin, count(*) AS n, round(sum(weight), 6) AS weight FROM w GROUP BY bin""")
def density_curve(spark, sf):
    windows = anchors(spark, sf).withColumns({"low": F.col("anchor") - DAY, "high": F.col("anchor") + DAY})
    met = iv.point_in_interval_join(peaks(spark, sf), windows, ["chrom"], 2 * DAY)
    bins = met.select("tf", "anchor_id", F.floor(iv.project_point(F.col("pos"), F.col("anchor"), F.col("strand")) / 3600).alias("bin"))
    return rounded(iv.group_weights(bins, ["anchor_id", "tf"]).groupBy("bin").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), 6, "weight")


def customer_brands(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("row"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(part, "l_partkey")
    return lines.groupBy("row", F.col("p_brand").alias("col")).agg(F.count("*").alias("value"))


def brand_vectors(spark, sf):
    from ..operators.factor import vectors

    names = [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    return vectors(customer_brands(spark, sf), "row", "col", "value", names), names


@query()
def nmf_programs(spark, sf):
    """Each customer's weights on five brand programs, fitted in blocks."""
    from ..operators.factor import block_nmf, transform

    rows, names = brand_vectors(spark, sf)
    h, _ = block_nmf(rows, "row", 5, len(names), rounds=8)
    return transform(rows, "row", h)


@query()
def archetypes(spark, sf):
    """Segments' counts of dominant programs, factorised: the medoid of three seeds."""
    from ..operators.factor import medoid, top_columns, vectors
    from ..operators.stacks import Fit, keyed, sound, stacked_nmf

    dominant = nmf_programs(spark, sf).select(F.col("row").alias("c_custkey"), "dominant")
    counts = dominant.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment", "dominant").agg(F.count("*").alias("n"))
    rows = keyed(vectors(counts, "c_mktsegment", "dominant", "n", [1, 2, 3, 4, 5]), "c_mktsegment")
    fits = list(sound(stacked_nmf(rows, [Fit(2, s) for s in range(3)], 5)).values())
    return spark.createDataFrame([(a, r, p, float(v)) for a, r, p, v in top_columns(fits[medoid(fits)], [1, 2, 3, 4, 5], 5)], "archetype int, rank int, program int, loading double")


@query()
def archetype_ranks(spark, sf):
    """How well customers' dominant programs agree between three seeds at ranks 2 to 4; all nine fits side by side."""
    from ..operators.stacks import Fit, keyed, labels, sound, stacked_nmf

    rows, names = brand_vectors(spark, sf)
    rows, fits = keyed(rows, "row"), [Fit(k, s) for k in (2, 3, 4) for s in range(3)]
    fitted = sound(stacked_nmf(rows, fits, len(names), rounds=8))
    of = F.create_map(*[F.lit(v) for n, fit in enumerate(fits) for v in (n, fit.k)]), F.create_map(*[F.lit(v) for n, fit in enumerate(fits) for v in (n, fit.seed)])
    runs = labels(rows, {fit: fitted[fit] for fit in fits}).select(of[0][F.col("fit")].alias("rank"), of[1][F.col("fit")].alias("seed"), F.col("key").alias("item"), "label")
    return st.ari_by_rank(st.pairwise_ari(runs, "rank", "seed", "item", "label"), "rank")


BRANDS = "v AS (SELECT o_custkey AS r, p_brand AS c, count(*)::DOUBLE AS x FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {BRANDS}, g AS (SELECT a.c AS a, b.c AS b, sum(a.x * b.x) AS g FROM v a JOIN v b USING (r) GROUP BY 1, 2),
p AS (SELECT 0 AS k, c AS a, 1.0::DOUBLE AS h FROM (SELECT DISTINCT c FROM v) UNION ALL
  SELECT k + 1, a, y / sqrt(sum(y * y) OVER ()) FROM (SELECT max(p.k) AS k, g.a, sum(g.g * p.h) AS y FROM p JOIN g ON g.b = p.a WHERE p.k < 60 GROUP BY g.a)),
l AS (SELECT sum(x.h * g.g * y.h) AS l FROM p x JOIN g ON g.a = x.a JOIN p y ON y.a = g.b WHERE x.k = 60 AND y.k = 60)
SELECT CAST(s AS INT) AS seed, round(sqrt((SELECT sum(x * x) FROM v) - l), 2) AS error FROM l, (SELECT unnest([0, 1, 2]) AS s)""")
def rank_one_fits(spark, sf):
    """The error of fits of rank one from three seeds: what the largest singular value leaves, which SQL finds by power iteration."""
    from ..operators.stacks import Fit, keyed, stacked_nmf

    rows, names = brand_vectors(spark, sf)
    got = stacked_nmf(keyed(rows, "row"), [Fit(1, s) for s in range(3)], len(names))
    return rounded(spark.createDataFrame([(fit.seed, one.errors[-1]) for fit, one in got.items()], "seed int, error double"), 2, "error")


def brand_types(spark, sf):
    """Brands' counts of part types as vectors, and the types."""
    from ..operators.factor import vectors

    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), "p_type")
    types = [r[0] for r in part.select("p_type").distinct().orderBy("p_type").collect()]
    counts = table(spark, sf, "lineitem").select("l_partkey").join(part, "l_partkey").groupBy("brand", "p_type").agg(F.count("*").alias("n"))
    return vectors(counts, "brand", "p_type", "n", types), types


@query()
def stability(spark, sf):
    """How well each of three programs of the medoid fit recurs over five seeds, each with up to 300 rounds. A fit that collapses starts again from 50 other
    seeds, and 50 more up to ten times; all starts are random, for agreement of any others would be their own. A seed that no start mends is an error. No programs without lines."""
    from ..operators.factor import medoid
    from ..operators.factor import stability as recurs
    from ..operators.stacks import AT_ONCE, Fit, keyed, sound, stacked_nmf

    rows, types = brand_types(spark, sf)
    fitted = stacked_nmf(keyed(rows, "brand"), [Fit(3, s) for s in range(5)], len(types), rounds=300, extra=50, tries=10, apart=False, at_once=AT_ONCE)
    fits = [] if all(one.fault == "empty" for one in fitted.values()) else list(sound(fitted).values())
    found = recurs(fits, medoid(fits)) if fits else []
    return spark.createDataFrame([tuple(r.values()) for r in found], "component int, median double, least double, at_90 double, at_80 double")


@query()
def heldout_cv(spark, sf):
    """Ranks 1 to 3 by three folds, nine fits side by side, scored on the entries that each fold hides."""
    from ..operators.stacks import held_out_scores, keyed

    rows, types = brand_types(spark, sf)
    most = rows.agg(F.max(F.array_max("x"))).first()[0] or 1.0
    scaled = rows.withColumn("x", F.transform("x", lambda v: v / F.lit(float(most))))
    return held_out_scores(keyed(scaled, "brand"), [1, 2, 3], len(types), l2=0.01)


@query()
def ward_clusters(spark, sf):
    """Brands by their counts of part types, smoothed and scaled, in four clusters."""
    from ..operators.trees import profile_clusters

    return profile_clusters(brand_types(spark, sf)[0], "brand", 4, sigma=0.5)


@query()
def program_matching(spark, sf):
    """Programs of two halves of the brands' rows (by md5), each the medoid of three seeds, matched one to one by cosine over
    the types that both halves hold. The six fits run side by side; only programs are matched here, whose number is given."""
    from ..operators.cluster import assign, cosine, greedy_match
    from ..operators.factor import medoid
    from ..operators.stacks import Fit, keyed, sound, stacked_nmf

    rows, types = brand_types(spark, sf)
    half = rows.withColumn("half", F.conv(F.substring(F.md5("brand"), 1, 1), 16, 10).cast("int") % 2)
    both = half.select("half", F.posexplode("x").alias("i", "v")).filter("v > 0").groupBy("i").agg(F.count_distinct("half").alias("n")).filter("n = 2")
    shared = sorted(r.i for r in both.collect())
    fitted = sound(stacked_nmf(keyed(half, "brand", "half"), [Fit(3, s, part=p) for p in (0, 1) for s in range(3)], len(types)))
    a, b = (fits[medoid(fits)][:, shared] for p in (0, 1) for fits in [[h for fit, h in fitted.items() if fit.part == p]])
    c = cosine(a, b)
    greedy = {i: j for i, j, _ in greedy_match(c)}
    return spark.createDataFrame([(i + 1, j + 1, greedy[i] + 1, float(c[i, j])) for i, j in assign(1 - c)], "a int, b int, greedy int, cosine double")


@query("""WITH s AS (SELECT DISTINCT p_brand AS term, o_custkey AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), z AS (SELECT term, count(*) AS n FROM s GROUP BY term HAVING count(*) >= 3),
o AS (SELECT item, arg_min(term, (n, term)) AS term FROM s JOIN z USING (term) GROUP BY item), c AS (SELECT term, c_mktsegment AS seg, count(*)::DOUBLE AS c FROM o JOIN customer ON c_custkey = item GROUP BY 1, 2),
x AS (SELECT term, sum(c) AS x FROM c GROUP BY term), y AS (SELECT seg, sum(c) AS y FROM c GROUP BY seg), t AS (SELECT sum(c) AS n FROM c),
mi AS (SELECT sum(c / n * ln(n * c / (x * y))) AS mi FROM c JOIN x USING (term) JOIN y USING (seg), t), h AS (SELECT (SELECT -sum(x / n * ln(x / n)) FROM x, t) AS hx, (SELECT -sum(y / n * ln(y / n)) FROM y, t) AS hy),
e AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS e
  FROM (SELECT x, y, n, unnest(range(CAST(greatest(1, x + y - n) AS BIGINT), CAST(least(x, y) AS BIGINT) + 1))::DOUBLE AS k FROM x, y, t))
SELECT round((mi - e) / ((hx + hy) / 2 - e), 6) AS ami, CAST(n AS BIGINT) AS n FROM mi, h, e, t""")
def ami(spark, sf):
    """Agreement of customers' segments with the smallest brand set that holds each, by counts of the two labellings."""
    from ..operators.cluster import smallest_set_label

    sets = customer_brands(spark, sf).select(F.col("col").alias("term"), F.col("row").alias("item"))
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("item"), "c_mktsegment")
    return rounded(st.adjusted_mutual_information(smallest_set_label(items, sets).join(items, "item"), "term", "c_mktsegment"), 6, "ami")


@query("""WITH RECURSIVE s AS (SELECT p_brand AS a, n_name AS b, count(*) AS s FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
o AS (SELECT a, row_number() OVER (ORDER BY max(s) DESC, a) AS k FROM s GROUP BY a),
r AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS a, NULL::VARCHAR AS b, 0::BIGINT AS s, []::VARCHAR[] AS used
  UNION ALL SELECT k + 1, a, b, s, list_append(used, b) FROM (SELECT r.k, s.a, s.b, s.s, r.used, row_number() OVER (ORDER BY s.s DESC, s.b) AS p FROM r JOIN o ON o.k = r.k + 1 JOIN s ON s.a = o.a WHERE NOT list_contains(r.used, s.b)) WHERE p = 1)
SELECT a, b, s::DOUBLE AS s FROM r WHERE k > 0""")
def dominant_matching(spark, sf):
    """Each brand with the nation of its most lines among those that no brand before it took; brands by their most lines."""
    from ..operators.cluster import dominant_match

    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("a"))
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("b"))
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(part, "l_partkey").join(named, "l_suppkey")
    return dominant_match(lines.groupBy("a", "b").agg(F.count("*").alias("s")))


@query("SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day, count(*) AS n FROM events WHERE value >= 20 GROUP BY 1, 2")
def stream_counts(spark, sf):
    """Extension: the stream of events, filtered and counted by day, drained; equal to the batch result."""
    from ..streaming.events import drained_counts

    return drained_counts(spark, f"{sf}/events.parquet", 20)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000 THEN 1 ELSE 0 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM s GROUP BY user_id, k HAVING epoch_us(max(ts)) + 86400000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 172800000000 FROM events)""")
def stream_sessions(spark, sf):
    """Extension: sessions of a user's events from a stream with a watermark of two days, drained to files: those that nothing can add to."""
    from ..streaming.events import drained_sessions

    got = drained_sessions(spark, f"{sf}/events.parquet", "1 day", "2 days")
    return got.select("user_id", F.floor(F.col("start").cast("double")).alias("first"), "n")


@query("SELECT CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 2))::INT % 2 AS INT) AS half, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
def stream_split(spark, sf):
    """Extension: the stream of events written to a folder for each half of the users, and read back from there."""
    from ..session import scratch
    from ..streaming.events import split_stream

    got = split_stream(spark, f"{sf}/events.parquet", scratch(spark, "halves"))
    return got.groupBy("half", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS k FROM orders, e)
SELECT CAST(r.k AS BIGINT) AS bin, count(b.k) AS n FROM (SELECT unnest(range(0, 20)) AS k) r LEFT JOIN b ON b.k = r.k GROUP BY r.k""")
def histogram(spark, sf):
    """Twenty bins from the least to the largest price."""
    low, high = table(spark, sf, "orders").agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return st.histogram(table(spark, sf, "orders"), "o_totalprice", low, high, 20)


@query(f"WITH {NATION} SELECT col, round(sum(ln(1 + x)), 4) AS weight, row_number() OVER (ORDER BY sum(ln(1 + x)) DESC, col) AS place FROM v GROUP BY col")
def column_order(spark, sf):
    return rounded(st.column_order(nation_values(spark, sf), "col", "x"), 4, "weight")


@query("WITH q AS (" + ORACLES["hypergeom_bh"] + """), best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY q_value, p_value, term) AS place FROM q WHERE q_value < 0.9), five AS (SELECT * FROM best WHERE place <= 5)
SELECT count(DISTINCT g) AS n_groups, round(median(-log10(greatest(q_value, 1e-300))) FILTER (place = 1), 6) AS median_top, round(median(odds_ratio), 6) AS median_odds, count(DISTINCT term) AS n_terms, avg(CASE WHEN big_k >= 1000 THEN 1.0 ELSE 0.0 END) AS generic_share FROM five""")
def enrichment_quality(spark, sf):
    return rounded(st.enrichment_quality(hypergeom_bh(spark, sf), "g", least_q=0.9), 6, "median_top", "median_odds")


@query(f"""WITH {P}, x AS (SELECT DISTINCT tf AS item, pos // {DAY} AS unit, chrom AS e, s AS level FROM peaks JOIN (SELECT unnest([0, 50, 100, 200]) AS s) ON score >= s), h AS (SELECT level, item, e, (row_number() OVER (PARTITION BY level, item ORDER BY md5(CAST(e AS VARCHAR)), e) - 1) % 2 AS half FROM (SELECT DISTINCT level, item, e FROM x)),
u AS (SELECT level, item, unit, max((half = 0)::INT) AS a, max((half = 1)::INT) AS b FROM x JOIN h USING (level, item, e) GROUP BY 1, 2, 3),
g AS (SELECT level, item, round((sum(a * b) / sum(a) + sum(a * b) / sum(b)) / 2, 6) AS raw FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY raw DESC NULLS LAST, level DESC) AS k FROM g)
SELECT item, level AS pick, raw AS value, CASE WHEN raw >= 0.9 THEN 'reaches floor' ELSE 'peak below floor' END AS reason FROM r WHERE k = 1""")
def threshold_picks(spark, sf):
    """The score at which each feature replicates best between halves of its experiments."""
    out = None
    for level in (0, 50, 100, 200):
        rows = peaks(spark, sf).filter(F.col("score") >= level).select(F.col("tf").alias("item"), F.floor(F.col("pos") / DAY).alias("unit"), F.col("chrom").alias("e"))
        one = rounded(st.split_half(rows, "item", "unit", "e"), 6, "raw").select("item", F.lit(level).alias("level"), "raw")
        out = one if out is None else out.unionByName(one)
    return st.pick_level(out, "item", "level", "raw", 0.9)


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), v AS (SELECT p_partkey AS l_partkey, p_retailprice AS v FROM part), j AS (SELECT l_orderkey, l_partkey, v, row_number() OVER (PARTITION BY l_orderkey ORDER BY v, l_partkey) AS k FROM m JOIN v USING (l_partkey))
SELECT l_orderkey, round(median(v), 4) AS median, count(*) AS n, min(l_partkey) FILTER (k = 1) AS best, round(min(v), 4) AS best_value FROM j GROUP BY l_orderkey""")
def member_rollup(spark, sf):
    prices = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return rounded(st.member_rollup(table(spark, sf, "lineitem"), prices, "l_orderkey", "l_partkey", "p_retailprice"), 4, "median", "best_value")


@query("""WITH d AS (SELECT c_mktsegment AS g, p_brand AS item, count(*) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
t AS (SELECT g, item, w FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, item) AS r FROM d) WHERE r <= 5),
c AS (SELECT p_brand AS item, l_returnflag AS k, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), n AS (SELECT item, sqrt(sum(c * c)) AS n FROM c GROUP BY item),
s AS (SELECT a.item AS a, b.item AS b, sum(a.c * b.c) AS dot FROM c a JOIN c b USING (k) GROUP BY 1, 2)
SELECT x.g AS c_mktsegment, round(sum(x.w * y.w * dot / (nx.n * ny.n)) / sum(x.w * y.w), 6) AS coherence FROM t x JOIN t y ON x.g = y.g AND x.item < y.item JOIN s ON s.a = x.item AND s.b = y.item JOIN n nx ON nx.item = x.item JOIN n ny ON ny.item = y.item GROUP BY 1""")
def class_coherence(spark, sf):
    from ..operators.factor import class_coherence as coherence

    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(part, "l_partkey")
    buyer = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    sums = lines.join(buyer, "l_orderkey").groupBy("c_mktsegment", "item").agg(F.count("*").cast("double").alias("w"))
    top = rel.top_per_group(sums, ["c_mktsegment"], [F.desc("w"), F.col("item")], 5)
    return rounded(coherence(top, lines.select("item", "l_returnflag"), "c_mktsegment", "item", "l_returnflag", "w"), 6, "coherence")


@query(f"""WITH {P}, d AS (SELECT tf, CAST(floor(CASE WHEN strand = '+' THEN pos - anchor ELSE anchor - pos END / 3600) AS BIGINT) AS bin, count(*) AS n FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - {DAY} AND anchor + {DAY} GROUP BY 1, 2)
SELECT tf, arg_max(bin, (n, -bin)) AS top_bin, max(n) AS top FROM d GROUP BY tf""")
def profile_peaks(spark, sf):
    """Where each feature's profile around anchors is highest (ties: the most upstream bin)."""
    windows = anchors(spark, sf).withColumns({"low": F.col("anchor") - DAY, "high": F.col("anchor") + DAY})
    met = iv.point_in_interval_join(peaks(spark, sf), windows, ["chrom"], 2 * DAY)
    bins = met.groupBy("tf", F.floor(iv.project_point(F.col("pos"), F.col("anchor"), F.col("strand")) / 3600).alias("bin")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m")
    return bins.groupBy("tf").agg(best).select("tf", (-F.col("m.b")).alias("top_bin"), F.col("m.n").alias("top"))
