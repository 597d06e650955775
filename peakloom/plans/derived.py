"""Queries of derived figures: profiles, roll-ups, rank statistics, tests against two backgrounds, agreement over seeds, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import gram
from ..operators import intervals as iv
from ..operators import relational as rel
from ..operators import stats as st
from .queries import BLOCKS, DAY, MERGED, NATION, ORACLES, STEPS, P, anchors, blocks, months, nation_values, peaks, query, rounded, table

BINARY = STEPS.format(w="1", b="merged")
SCORE = STEPS.format(w="score", b="b")


# profiles and projections


@query(f"WITH {P}, {BLOCKS}, {MERGED}, r AS ({BINARY}) SELECT tf, start, \"end\", round(value / (SELECT greatest(count(*), 1) FROM anchors), 9) AS value FROM r")
def mean_profile(spark, sf):
    runs = iv.coverage(iv.merge_intervals(blocks(spark, sf), ["tf"], tile=DAY), ["tf"], tile=DAY)
    return rounded(iv.mean_profile(runs, anchors(spark, sf).agg(F.count("*").alias("n"))), 9, "value")


@query(f"""WITH {P}, {BLOCKS}, {MERGED}, r AS ({BINARY}), s AS ({SCORE}), k AS (SELECT tf, count(*) AS n_kept FROM peaks WHERE score >= 50 GROUP BY tf)
SELECT tf, n_total, coalesce(n_kept, 0) AS n_kept, CAST(binary_total AS BIGINT) AS binary_total, CAST(binary_max AS BIGINT) AS binary_max, CAST(score_total AS BIGINT) AS score_total, CAST(score_max AS BIGINT) AS score_max
FROM (SELECT tf, count(*) AS n_total FROM peaks GROUP BY tf) LEFT JOIN k USING (tf) LEFT JOIN (SELECT tf, sum(value * ("end" - start)) AS binary_total, max(value) AS binary_max FROM r GROUP BY tf) USING (tf) LEFT JOIN (SELECT tf, sum(value * ("end" - start)) AS score_total, max(value) AS score_max FROM s GROUP BY tf) USING (tf)""")
def feature_summary(spark, sf):
    held = blocks(spark, sf)
    binary = iv.coverage(iv.merge_intervals(held, ["tf"], tile=DAY), ["tf"], tile=DAY)
    return iv.feature_summary(peaks(spark, sf), peaks(spark, sf).filter("score >= 50"), binary, iv.coverage(held, ["tf"], weight=F.col("score"), tile=DAY))


@query(f"WITH {P} SELECT anchor_id, count(pos) AS n_points, count(DISTINCT tf) AS n_features FROM anchors LEFT JOIN peaks ON peaks.chrom = anchors.chrom AND pos BETWEEN anchor - {DAY} AND anchor + {DAY} GROUP BY anchor_id")
def contained_points(spark, sf):
    elements = anchors(spark, sf).withColumns({"low": F.col("anchor") - DAY, "high": F.col("anchor") + DAY})
    return iv.contained(elements, peaks(spark, sf), ["chrom"], "anchor_id", "tf", 2 * DAY)


@query(f"WITH {P} SELECT event_id, pos // 25 * 25 AS snapped FROM peaks")
def grid_snap(spark, sf):
    return peaks(spark, sf).select("event_id", iv.snap(F.col("pos")).alias("snapped"))


@query(f"""WITH {P}, m AS (SELECT event_id, anchor_id, strand, anchor, greatest(greatest(pos - 1800, 0), anchor - {DAY}) AS s, least(pos + 1801, anchor + {DAY} + 1) AS e FROM peaks JOIN anchors ON peaks.chrom = anchors.chrom AND greatest(pos - 1800, 0) < anchor + {DAY} + 1 AND pos + 1801 > greatest(anchor - {DAY}, 0))
SELECT event_id, anchor_id, CASE WHEN strand = '+' THEN s - anchor + {DAY} ELSE anchor - (e - 1) + {DAY} END AS low, CASE WHEN strand = '+' THEN e - anchor + {DAY} ELSE anchor - s + {DAY} + 1 END AS high FROM m""")
def interval_projection(spark, sf):
    held = peaks(spark, sf).select("event_id", "chrom", F.greatest(F.col("pos") - 1800, F.lit(0)).alias("start"), (F.col("pos") + 1801).alias("end"))
    windows = anchors(spark, sf).withColumns({"r_start": F.greatest(F.col("anchor") - DAY, F.lit(0)), "r_end": F.col("anchor") + DAY + 1})
    met = iv.overlap_join(held, windows, ["chrom"], 2 * DAY)
    low, high = iv.project_interval(F.col("start"), F.col("end"), F.col("anchor"), F.col("strand"), DAY)
    return met.select("event_id", "anchor_id", low.alias("low"), high.alias("high"))


@query(f"WITH {P} SELECT anchor_id, CASE WHEN strand = '+' THEN anchor - 500 ELSE anchor - 100 END AS low, CASE WHEN strand = '+' THEN anchor + 100 ELSE anchor + 500 END AS high FROM anchors")
def absolute_bounds(spark, sf):
    low, high = iv.absolute_bounds(F.lit(-500), F.lit(100), F.col("anchor"), F.col("strand"))
    return anchors(spark, sf).select("anchor_id", low.alias("low"), high.alias("high"))


@query(f"WITH {P} SELECT tf, count(*) AS n FROM peaks WHERE score BETWEEN 50 AND 200 AND tf IN ('click', 'purchase', 'error') GROUP BY tf")
def score_range(spark, sf):
    return peaks(spark, sf).filter(F.col("score").between(50, 200) & F.col("tf").isin("click", "purchase", "error")).groupBy("tf").agg(F.count("*").alias("n"))


# roll-ups


@query("SELECT p_brand, l_returnflag, max(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def max_by_gene(spark, sf):
    members = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("q"))
    return rel.max_by_group(lines, members, "l_partkey", "p_brand", "l_returnflag", "q")


@query(f"WITH {NATION}, m AS (SELECT DISTINCT l_orderkey, p_brand AS row FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, col, round(avg(x), 4) AS mean, count(*) AS n_items FROM m JOIN v USING (row) GROUP BY 1, 2")
def module_means(spark, sf):
    """Mean activity of an order's brands by nation, as of a module's features by tissue."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("row"))
    members = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    return rounded(rel.member_means(members, nation_values(spark, sf), "l_orderkey", "row", "col", "x"), 4, "mean")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS module, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), a AS (SELECT l_orderkey AS module FROM lineitem WHERE l_quantity > 40 GROUP BY 1), i AS (SELECT module, row_number() OVER (ORDER BY module) - 1 AS row_id FROM a)
SELECT row_id, module, item, CAST(1 AS DOUBLE) AS value FROM m JOIN i USING (module)""")
def module_matrix(spark, sf):
    """Orders with a line of over 40 pieces as dense rows, brands as columns."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("module"), "l_partkey", "l_quantity")
    modules = lines.groupBy("module").agg(F.sum((F.col("l_quantity") > 40).cast("int")).alias("assigned"))
    return rel.matrix_rows(modules, lines.join(part, "l_partkey"), "module", "item", "assigned", tile=4096)


@query(f"""WITH {P}, n AS (SELECT anchor_id, anchors.chrom, anchor, strand, (SELECT arg_min(p.event_id, (abs(p.pos - anchor), p.event_id)) FROM peaks p WHERE p.chrom = anchors.chrom AND p.tf <> 'purchase') AS g FROM anchors),
p AS (SELECT g, count(DISTINCT anchor_id) AS n, count(DISTINCT strand) AS k FROM n WHERE g IS NOT NULL GROUP BY g) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_items, round(sum(n) / count(*), 6) AS factor, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (k > 1) AS n_spanning FROM p""")
def collapse_factor(spark, sf):
    """How many purchases share their nearest other event, and how many such groups span both strands."""
    others = peaks(spark, sf).filter("tf <> 'purchase'").groupBy("chrom", "pos").agg(F.min("event_id").alias("g"))
    near = lambda tie: iv.nearest_join(anchors(spark, sf), others.select("chrom", F.col("pos").alias("at")), ["chrom"], position="anchor", anchor="at", tie=tie, tile=10 * DAY)
    # of two places at the same distance the one with the smaller event counts
    both = near("left").select("anchor_id", "chrom", "strand", "nearest").unionByName(near("right").select("anchor_id", "chrom", "strand", "nearest"))
    named = both.join(others.withColumnRenamed("pos", "nearest"), ["chrom", "nearest"]).groupBy("anchor_id", "strand").agg(F.min("g").alias("g"))
    return rounded(rel.collapse(named, "g", "anchor_id", "strand"), 6, "factor")


@query("SELECT p_brand, min(p_name) AS p_name, min(p_type) AS p_type FROM part GROUP BY p_brand")
def any_value(spark, sf):
    return rel.any_value(table(spark, sf, "part"), ["p_brand"], "p_name", "p_type")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_pairs(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS program, count(*) AS n, CAST(trunc(median(epoch(o_orderdate) // 86400)) AS INT) AS median_day, round_even(avg(o_totalprice), 4) AS mean_weight FROM orders GROUP BY 1")
def program_summary(spark, sf):
    from ..operators.factor import program_summary as summary

    day = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)") / DAY)
    rows = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("program"), day.alias("day"), "o_totalprice")
    return summary(rows, "program", "o_totalprice", "day")


# rank statistics, agreement, enrichment

RANKS = "(SELECT row, t, rank() OVER (PARTITION BY row ORDER BY {0}) + (count(*) OVER (PARTITION BY row, {0}) - 1) / 2 AS r FROM m)"


@query("WITH m AS (SELECT p_brand AS row, date_trunc('month', l_shipdate) AS t, sum(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT a.row AS row, round(corr(a.r, b.r), 6) AS r, count(*) AS n FROM " + RANKS.format("x") + " a JOIN " + RANKS.format("y") + " b USING (row, t) GROUP BY 1")
def spearman(spark, sf):
    return rounded(st.spearman(months(spark, sf), ["row"], "x", "y"), 6, "r")


@query("""WITH m AS (SELECT p_brand AS row, date_trunc('month', l_shipdate) AS t, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), g AS (SELECT row, t FROM (SELECT DISTINCT row FROM m), (SELECT DISTINCT t FROM m)),
f AS (SELECT row, t, coalesce(CASE WHEN x > 40 THEN x END, avg(CASE WHEN x > 40 THEN x END) OVER (PARTITION BY row)) AS x FROM g LEFT JOIN m USING (row, t))
SELECT a.row AS a, b.row AS b, round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM f a JOIN f b ON a.t = b.t AND a.row < b.row GROUP BY 1, 2""")
def pearson_filled(spark, sf):
    """Small and missing values become their row's mean before the rows are correlated."""
    m = months(spark, sf).select("row", "t", F.when(F.col("x") > 40, F.col("x")).alias("x"))
    grid = m.select("row").distinct().crossJoin(m.select("t").distinct())  # brands by months
    full = st.fill_by_row_mean(grid.join(m, ["row", "t"], "left"), "row", "x")
    return rounded(gram.pairwise_pearson(full, "row", "t", "x"), 6, "r")


@query("""WITH r AS (SELECT k, s, vec_id, floor((embedding[s] + 1) * k / 2) AS lab FROM embeddings, (SELECT unnest(range(1, 65)) AS s), (SELECT unnest([2, 4, 16]) AS k) WHERE s <= len(embedding)),
c AS (SELECT a.k AS k, a.s AS a, b.s AS b, a.lab AS la, b.lab AS lb, count(*) AS c FROM r a JOIN r b ON a.k = b.k AND a.vec_id = b.vec_id AND a.s < b.s GROUP BY ALL), t AS (SELECT k, a, b, sum(c * (c - 1) / 2) AS ij, sum(c) * (sum(c) - 1) / 2 AS nn FROM c GROUP BY k, a, b),
x AS (SELECT k, a, b, sum(c * (c - 1) / 2) AS i FROM (SELECT k, a, b, la, sum(c) AS c FROM c GROUP BY k, a, b, la) GROUP BY k, a, b), y AS (SELECT k, a, b, sum(c * (c - 1) / 2) AS j FROM (SELECT k, a, b, lb, sum(c) AS c FROM c GROUP BY k, a, b, lb) GROUP BY k, a, b),
v AS (SELECT k, CASE WHEN (i + j) / 2 = i * j / nn THEN 1 ELSE (ij - i * j / nn) / ((i + j) / 2 - i * j / nn) END AS ari FROM t JOIN x USING (k, a, b) JOIN y USING (k, a, b)),
g AS (SELECT k, count(*) AS n, avg(ari) AS mean, quantile_cont(ari, 0.25) AS q1, median(ari) AS median, quantile_cont(ari, 0.75) AS q3 FROM v GROUP BY k)
SELECT k, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, k = (SELECT k FROM g ORDER BY round(median, 9) DESC, k LIMIT 1) AS picked FROM g""")
def ari_over_seeds(spark, sf):
    """Each dimension of the embeddings, cut into k bins, as a seed's labelling: agreement of all seeds, two by two, for each k."""
    runs = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("seed", "x")).withColumn("k", F.explode(F.array(*map(F.lit, (2, 4, 16)))))
    runs = runs.select("k", "seed", "vec_id", F.floor((F.col("x") + 1) * F.col("k") / 2).alias("label"))
    return rounded(st.ari_by_rank(st.pairwise_ari(runs, "k", "seed", "vec_id", "label"), "k"), 6, "mean", "q1", "median", "q3")


_TESTS = ORACLES["hypergeom_bh"].removeprefix("WITH ")
_OWN = _TESTS.replace("bought AS (SELECT DISTINCT c_custkey, c_mktsegment, o_orderpriority AS term FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 120000)", "bought AS (SELECT DISTINCT c_custkey, c_mktsegment, o_orderpriority AS term FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 120000 AND c_acctbal > 0)").replace("u AS (SELECT DISTINCT c_custkey FROM customer)", "u AS (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0)")


@query(f"SELECT *, 'own' AS background FROM (WITH {_OWN}) UNION ALL SELECT *, 'whole' FROM (WITH {_TESTS})")
def enrichment_two_backgrounds(spark, sf):
    customer = table(spark, sf, "customer")
    bought = table(spark, sf, "orders").filter("o_totalprice > 120000").select(F.col("o_orderpriority").alias("term"), F.col("o_custkey").alias("item"))
    foreground = customer.filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("item"))
    got = st.enrichment_two_backgrounds(foreground, bought, customer.select(F.col("c_custkey").alias("item")), "g")
    return rounded(got, 6, "p_value", "odds_ratio", "q_value").select("g", "term", "k", "n", "big_k", "big_n", "p_value", "odds_ratio", "q_value", "background")


@query("WITH f AS (" + ORACLES["circular_shift_fdr"] + ") SELECT floor, observed, null_mean, fdr FROM f WHERE fdr <= 1.05 ORDER BY floor LIMIT 1")
def first_floor(spark, sf):
    """The first support floor whose false-discovery rate is at most the target."""
    from .queries import circular_shift_fdr

    return st.first_floor(circular_shift_fdr(spark, sf), 1.05)


@query(f"""WITH {P}, n AS (SELECT event_id, score, min(abs(pos - anchor)) AS d FROM peaks LEFT JOIN (SELECT DISTINCT chrom, anchor FROM anchors) USING (chrom) WHERE tf <> 'purchase' GROUP BY 1, 2)
SELECT (score >= 20)::INT + (score >= 50)::INT + (score >= 100)::INT + (score >= 200)::INT AS bin, count(*) AS n, round(avg(CASE WHEN d <= {DAY} THEN 1.0 ELSE 0.0 END), 6) AS recovered, median(d) AS median_distance FROM n GROUP BY 1""")
def recovery_by_support(spark, sf):
    """Share of events within a day of a purchase, by bins of their score."""
    near = iv.nearest_join(peaks(spark, sf).filter("tf <> 'purchase'"), anchors(spark, sf), ["chrom"], tile=10 * DAY)
    return rounded(st.recovery(near.withColumn("hit", F.abs("distance") <= DAY), "score", "hit", "distance", [20, 50, 100, 200]), 6, "recovered")


# scalars


@query("""SELECT p_partkey, split_part(p_name || ' (' || p_partkey || ')', ' (', 1) AS symbol, split_part('T' || p_partkey || '.' || p_size, '.', 1) AS bare, CASE WHEN p_size = 1 THEN 'MT' ELSE p_size::VARCHAR END AS chrom,
replace(lower(p_type || '_' || p_name), '_', ' ') AS pretty, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS safe, printf('%.2e', p_retailprice + 0.03) AS sci, contains(upper(p_name), 'RED') OR contains(upper(p_brand), 'RED') AS has_red FROM part""")
def string_functions(spark, sf):
    c, key = F.col, F.col("p_partkey").cast("string")
    chrom = F.concat(F.lit("chr"), F.when(c("p_size") == 1, "M").otherwise(c("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", sc.before_paren(F.concat("p_name", F.lit(" ("), key, F.lit(")"))).alias("symbol"), sc.unversioned(F.concat(F.lit("T"), key, F.lit("."), c("p_size").cast("string"))).alias("bare"), sc.bare_chromosome(chrom).alias("chrom"), sc.pretty_term(F.concat(F.lit("GO_"), "p_type", F.lit("_"), "p_name"), "GO_").alias("pretty"), sc.safe_name(F.concat("p_name", F.lit("/"), "p_brand")).alias("safe"), sc.scientific(c("p_retailprice") + 0.03).alias("sci"), sc.contains_text("red", "p_name", "p_brand").alias("has_red"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(greatest(-100, least(round_even(l_discount * 2000 - 50, 0), 100)) AS INT) AS hundredths, CAST(greatest(0, least(l_quantity * 30, 1000)) AS INT) AS score, round(log10(l_extendedprice + 1), 9) AS log_z FROM lineitem")
def math_functions(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.hundredths((F.col("l_discount") * 2000 - 50) / 100).cast("int").alias("hundredths"), sc.clipped_score(F.col("l_quantity") * 30).cast("int").alias("score"), F.round(sc.log_z(F.col("l_extendedprice")), 9).alias("log_z"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000 THEN 1 ELSE 0 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    """Extension: sessions of a user's events, a day apart at least, as Spark's session windows."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = events.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return got.select("user_id", F.floor(F.col("w.start").cast("double")).alias("first"), "n")


# tables, entropy, enrichment, sweeps


@query("SELECT p_brand, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def crosstab(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rel.crosstab(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").join(part, "l_partkey"), "p_brand", "l_returnflag", ["A", "N", "R"])


@query("WITH c AS (SELECT p_brand, o_orderpriority AS k, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), n AS (SELECT p_brand, sum(c) AS n FROM c GROUP BY 1) SELECT p_brand, CAST(n AS BIGINT) AS n, round(-sum(c / n * ln(c / n)), 6) AS entropy FROM c JOIN n USING (p_brand) GROUP BY p_brand, n")
def class_entropy(spark, sf):
    from ..operators.factor import class_entropy as entropy

    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").join(orders, "l_orderkey")
    return rounded(entropy(lines, "p_brand", "o_orderpriority"), 6, "entropy")


@query("WITH t AS (SELECT count(*) FILTER (l_linestatus = 'O') AS f, count(*) AS a FROM lineitem) SELECT l_returnflag AS s, round(log2((count(*) FILTER (l_linestatus = 'O') / min(f) + 1e-9) / (count(*) / min(a) + 1e-9)), 6) AS log2fe FROM lineitem, t GROUP BY 1")
def raw_enrichment(spark, sf):
    from ..operators.factor import raw_enrichment as raw

    return rounded(raw(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("s"), (F.col("l_linestatus") == "O").alias("fg")), "s", "fg"), 6, "log2fe")


@query("WITH s AS (" + ORACLES["feature_summary"] + ") SELECT count(*) AS n, round(quantile_cont(score_max / binary_max, 0.25), 6) AS q1, round(median(score_max / binary_max), 6) AS median, round(quantile_cont(score_max / binary_max, 0.75), 6) AS q3 FROM s")
def ratio_quantiles(spark, sf):
    """Quartiles over features of the score profile's maximum to the binary one's."""
    ratios = feature_summary(spark, sf).select(F.lit(1).alias("all"), F.try_divide("score_max", "binary_max").alias("r"))
    return rounded(st.quantile_stats(ratios, ["all"], "r").select("n", "q1", "median", "q3"), 6, "q1", "median", "q3")


@query(f"WITH {P} SELECT CAST(f AS BIGINT) AS floor, 'ok' AS status, (SELECT count(*) FROM peaks WHERE score >= f) AS n FROM (SELECT unnest([0, 50, 100]) AS f) UNION ALL SELECT -1, 'failed', NULL")
def parameter_sweep(spark, sf):
    """Peaks at several floors; a floor that isn't allowed is reported as failed, and the others go on."""

    def run(floor):
        if floor < 0:
            raise ValueError("a floor from 0")
        return peaks(spark, sf).filter(F.col("score") >= floor).agg(F.count("*").alias("n"))

    done, failed = st.sweep([{"floor": f} for f in (0, 50, -1, 100)], run)
    rows = [(r["floor"], "ok", r["n"]) for r in done] + [(r["floor"], "failed", None) for r in failed]
    return spark.createDataFrame(rows, "floor bigint, status string, n bigint")
