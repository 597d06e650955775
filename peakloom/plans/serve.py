"""The serve layer's queries over a build made of the supplied tables: a key and its SQL for each method of the catalogue.

Customers stand for anchors, orders for modules, part brands for features, order priorities for programs, nations for tissues
and lineages. The build's tables are given once, in SQL that both engines read; the methods are DataFrame code (catalog),
the SQL beside each is its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .queries import ORACLES, QUERIES, rounded, table

PROGRAM = "CAST(substr(o_orderpriority, 1, 1) AS INT)"
TERM = "concat(p_type, ' ', p_size)"
GENE = "CASE WHEN c_custkey % 50 = 0 THEN '' ELSE concat('GENE', c_custkey % 40) END"


def _ranked_terms(kind: str, of: str) -> str:
    return f"""SELECT {kind}, CAST(rank AS INT) AS rank, term, concat('GO:', substr(md5(term), 1, 7)) AS go_id, CAST(n AS INT) AS fg_in, CAST(1 AS DOUBLE) / (1 + n) AS p_value, CAST(3 AS DOUBLE) / (3 + n) AS q_value, concat('GENE', n % 40, ', GENE', n % 7, ',other') AS genes_in_overlap
FROM (SELECT *, row_number() OVER (PARTITION BY {kind} ORDER BY n DESC, term) AS rank FROM (SELECT {of} AS {kind}, {TERM} AS term, count(*) AS n FROM lines GROUP BY 1, 2) c) r WHERE rank <= 40"""


#: Each table of the build. Names in braces are the supplied ones; @path@ is an ordered list of programs as text.
TABLES = {
    "tss": f"SELECT CAST(c_custkey AS INT) AS tss_id, concat('T', c_custkey) AS transcript_id, concat('G', c_nationkey) AS gene_id, {GENE} AS gene_name, c_mktsegment AS chrom, CAST(c_custkey * 1000 AS INT) AS tss, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {{customer}}",
    "tf": "SELECT CAST(row_number() OVER (ORDER BY tf) AS INT) AS tf_idx, tf, n AS n_peaks_total, CAST(CASE WHEN n % 3 = 0 THEN NULL ELSE n % 4 END AS INT) AS cluster_filtered, CAST(n % 17 AS INT) AS peak_dist_filtered, CAST(n % 5 AS INT) AS cluster_no_filter, CAST(n % 19 AS INT) AS peak_dist_no_filter FROM (SELECT p_brand AS tf, count(*) AS n FROM {part} GROUP BY p_brand) b",
    "lines": "SELECT l_orderkey, o_custkey, o_orderpriority, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, p_brand, p_type, p_size, n_name FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey",
    "peaks": "SELECT CAST(o_custkey AS INT) AS tss_id, tf_idx, CAST(l_partkey % 3001 - 1500 AS INT) AS local_offset, CAST(l_quantity * 20 AS INT) AS score FROM lines JOIN tf ON p_brand = tf",
    "modules": "SELECT CAST(o_orderkey AS INT) AS module_id, tss_id, transcript_id, gene_name, CAST(o_orderkey % 2000 - 1500 AS INT) AS lo_offset, CAST(o_orderkey % 2000 - 1400 + o_orderkey % 7 AS INT) AS center_offset, CAST(o_orderkey % 300 + 20 AS INT) AS width FROM {orders} JOIN tss ON o_custkey = tss_id",
    "module_program": f"SELECT CAST(o_orderkey AS INT) AS module_id, {PROGRAM} AS dominant_program, o_totalprice / 500000 AS dominant_weight FROM {{orders}}",
    "programs": "SELECT dominant_program AS program, count(*) AS n_modules, round(avg(dominant_weight), 4) AS mean_dom_weight, concat('features of ', dominant_program) AS top_tfs, concat('reading ', dominant_program) AS reading FROM module_program GROUP BY dominant_program",
    "program_tf_top": f"SELECT program, CAST(rank AS INT) AS rank, tf, loading FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY loading DESC, tf) AS rank FROM (SELECT {PROGRAM} AS program, p_brand AS tf, CAST(sum(l_quantity) AS DOUBLE) AS loading FROM lines GROUP BY 1, 2) c) r WHERE rank <= 20",
    "program_go_top": _ranked_terms("program", PROGRAM),
    "archetype_go_top": _ranked_terms("archetype", "CAST(o_custkey % 3 + 1 AS INT)"),
    "gene_configs": "SELECT transcript_id, min(gene_name) AS gene_name, count(*) AS n_modules, @path@ AS program_path FROM modules JOIN module_program USING (module_id) GROUP BY transcript_id",
    "gene_archetypes": f"SELECT concat('T', c_custkey) AS transcript_id, {GENE} AS gene_name, CAST(c_custkey % 3 + 1 AS INT) AS dominant_archetype, round(c_acctbal / 10000, 6) AS dominant_weight FROM {{customer}}",
    "archetypes": "SELECT dominant_archetype AS archetype, count(*) AS n_genes FROM gene_archetypes GROUP BY dominant_archetype",
    "archetype_program_loading": f"SELECT CAST(o_custkey % 3 + 1 AS INT) AS archetype, {PROGRAM} AS program, CAST(count(*) AS DOUBLE) AS loading FROM {{orders}} GROUP BY 1, 2",
    "gene_lineage": "SELECT p_brand AS gene, n_name AS lineage, count(*) AS n_lines, round(avg(l_extendedprice), 4) AS mean_chronos, round(median(l_extendedprice), 4) AS median_chronos, round(avg(CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS frac_essential FROM lines GROUP BY 1, 2",
    "gene_summary": "SELECT gene, n_lines, median_chronos, lineage AS most_essential_lineage FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY median_chronos, lineage) AS k FROM gene_lineage) g WHERE k = 1",
    "lineages": "SELECT n_name AS lineage, count(*) AS n_lines FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "chronos": "SELECT concat('M', l_suppkey) AS model_id, p_brand AS gene, round(avg(l_extendedprice), 4) AS value FROM lines GROUP BY 1, 2",
    "expression": "SELECT concat('M', l_suppkey) AS model_id, p_brand AS gene, round(avg(l_quantity), 4) AS value FROM lines GROUP BY 1, 2",
    "cell_lines": "SELECT concat('M', s_suppkey) AS model_id, s_name AS name, n_name AS lineage FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "tissues": "SELECT n_name AS tissue, count(*) AS n_samples FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "transcript_tissue": "SELECT concat('T', o_custkey) AS transcript_id, n_name AS tissue, count(*) AS n_samples, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q3 FROM lines GROUP BY 1, 2",
    "tf_tissue": "SELECT p_brand AS tf, n_name AS tissue, round(avg(l_extendedprice), 2) AS tpm FROM lines GROUP BY 1, 2",
    "module_activity": "SELECT CAST(l_orderkey AS INT) AS module_id, n_name AS tissue, round(avg(l_quantity), 4) AS mean_tf_tpm, count(DISTINCT p_brand) AS n_tfs_in_module FROM lines GROUP BY 1, 2",
    "module_target": "SELECT CAST(l_orderkey AS INT) AS module_id, round(avg(l_discount) * 10 - 0.5, 4) AS r_module_target, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS n_tfs_high_r FROM lines WHERE l_quantity > 5 GROUP BY 1",
    "module_tf_target": "SELECT CAST(l_orderkey AS INT) AS module_id, p_brand AS tf, round(max(l_discount) * 10 - 0.5, 4) AS r FROM lines GROUP BY 1, 2",
    "program_tau": f"SELECT {PROGRAM} AS program, round(avg(o_totalprice), 4) AS tau FROM {{orders}} GROUP BY 1",
    "tf_target": "SELECT a.tf AS target, b.tf AS tf, CAST((a.tf_idx * 7 + b.tf_idx * 13) % 200 - 100 AS DOUBLE) / 100 AS r FROM tf a JOIN tf b ON a.tf_idx <> b.tf_idx",
    "profiles": "SELECT 'binary' AS flavour, p_brand AS tf, CAST(l_linenumber AS INT) AS pos, CAST(count(*) AS DOUBLE) AS value FROM lines GROUP BY 2, 3 UNION ALL SELECT 'score', p_brand, CAST(l_linenumber AS INT), CAST(sum(l_quantity) AS DOUBLE) FROM lines GROUP BY 2, 3",
}
SUPPLIED = ("customer", "orders", "lineitem", "part", "supplier", "nation")
#: The list of a transcript's programs by module, in each engine's words.
PATH = {"spark": "listagg(CAST(dominant_program AS STRING), ',') WITHIN GROUP (ORDER BY module_id)", "duckdb": "string_agg(CAST(dominant_program AS VARCHAR), ',' ORDER BY module_id)"}


def _with(names: list[str], dialect: str) -> str:
    """WITH clause of the tables named and those that they are made of, in an order that defines them first."""
    told: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in told:
            for other in TABLES:
                if other != name and re.search(rf"(FROM|JOIN) {other}\b", TABLES[name]):
                    add(other)
            told[name] = f"{name} AS ({TABLES[name].replace('@path@', PATH[dialect])})"

    for n in names:
        add(n)
    return "WITH " + ", ".join(told.values())


def build(spark: SparkSession, sf: str, *names: str) -> Catalog:
    """The tables named, as a catalogue."""
    tables = {}
    for name in names:
        text = f"{_with([name], 'spark')} SELECT * FROM {name}"
        tables[name] = spark.sql(text, **{t: table(spark, sf, t) for t in SUPPLIED if f"{{{t}}}" in text})
    return Catalog(spark, tables)


def serve(name: str, needs: str, run: Callable[[Catalog], DataFrame], sql: str) -> None:
    """Registers serve_<name>."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return run(build(spark, sf, *needs.split()))

    QUERIES[f"serve_{name}"] = query
    plain = _with(needs.split(), "duckdb")
    for t in SUPPLIED:
        plain = plain.replace(f"{{{t}}}", t)
    ORACLES[f"serve_{name}"] = f"{plain} {sql}"


serve("list_genes", "tss", lambda c: c.list_genes(), "SELECT DISTINCT gene_name FROM tss WHERE gene_name <> ''")
serve("list_transcripts", "tss", lambda c: c.list_transcripts(), "SELECT DISTINCT transcript_id FROM tss")
serve("list_tfs", "tf", lambda c: c.list_tfs(), "SELECT DISTINCT tf FROM tf")
serve("tss_meta", "tss", lambda c: c.tss_meta("T7"), "SELECT * FROM tss WHERE transcript_id = 'T7'")
serve("transcripts_of_gene", "tss", lambda c: c.transcripts_of_gene("GENE3"), "SELECT * FROM tss WHERE gene_name = 'GENE3'")
serve("tf_meta", "tf", lambda c: c.tf_meta("Brand#1"), "SELECT * FROM tf WHERE tf = 'Brand#1'")
serve("gene_config", "gene_configs", lambda c: c.gene_config("T7"), "SELECT * FROM gene_configs WHERE transcript_id = 'T7'")
serve("gene_archetype", "gene_archetypes", lambda c: c.gene_archetype("T7"), "SELECT * FROM gene_archetypes WHERE transcript_id = 'T7'")
serve("programs", "programs", lambda c: c.programs(), "SELECT * FROM programs")
serve("archetypes", "archetypes", lambda c: c.archetypes(), "SELECT * FROM archetypes")
serve("archetype_loadings", "archetype_program_loading", lambda c: c.archetype_loadings(), "SELECT * FROM archetype_program_loading")
serve("modules_of", "modules module_program programs", lambda c: c.modules_of("T7"), "SELECT m.*, dominant_program, dominant_weight, reading, top_tfs FROM modules m JOIN module_program USING (module_id) LEFT JOIN programs p ON p.program = dominant_program WHERE transcript_id = 'T7'")
serve("peaks_of", "peaks tf", lambda c: c.peaks_of(7, 500), "SELECT tf, local_offset, score FROM peaks JOIN tf USING (tf_idx) WHERE tss_id = 7 AND score >= 500")
serve("tf_summary", "peaks tf", lambda c: rounded(c.tf_summary(7), 6, "mean_offset"), "SELECT tf, count(*) AS n, max(score) AS top_score, round(avg(local_offset), 6) AS mean_offset FROM peaks JOIN tf USING (tf_idx) WHERE tss_id = 7 GROUP BY tf")
serve("top_tss_of", "peaks tf tss", lambda c: c.top_tss_of("Brand#1", 500, 25), "SELECT tss_id, count(*) AS n_peaks, min(local_offset) AS least, max(local_offset) AS most, transcript_id, gene_name FROM peaks JOIN tf USING (tf_idx) JOIN tss USING (tss_id) WHERE tf = 'Brand#1' AND score >= 500 GROUP BY tss_id, transcript_id, gene_name ORDER BY n_peaks DESC, tss_id LIMIT 25")
serve("program_top_tfs", "program_tf_top", lambda c: c.program_top_tfs(2, 10), "SELECT * FROM program_tf_top WHERE program = 2 AND rank <= 10")
serve("program_top_tfs_enriched", "program_tf_top tf tf_tissue", lambda c: c.program_top_tfs_enriched(2, 10), "SELECT p.*, cluster_filtered, cluster_no_filter, tissue AS top, tpm AS top_value FROM program_tf_top p LEFT JOIN tf USING (tf) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY tpm DESC, tissue) AS k FROM tf_tissue) WHERE k = 1) t USING (tf) WHERE program = 2 AND rank <= 10".replace("p.*", "p.program, p.rank, p.tf, p.loading"))
serve("program_top_terms", "program_go_top", lambda c: c.top_terms("program", 2, 10), "SELECT * FROM program_go_top WHERE program = 2 AND rank <= 10")
serve("archetype_top_terms", "archetype_go_top", lambda c: c.top_terms("archetype", 1, 10), "SELECT * FROM archetype_go_top WHERE archetype = 1 AND rank <= 10")
TERMS = "terms AS (SELECT term, min(go_id) AS go_id, count(DISTINCT program) AS n_programs, count(DISTINCT archetype) AS n_archetypes, min(q_value) AS min_q FROM (SELECT term, go_id, q_value, program, NULL AS archetype FROM program_go_top UNION ALL SELECT term, go_id, q_value, NULL, archetype FROM archetype_go_top) GROUP BY term)"
serve("list_terms", "program_go_top archetype_go_top", lambda c: c.list_terms(), f", {TERMS} SELECT * FROM terms")
serve("find_terms", "program_go_top archetype_go_top", lambda c: c.find_terms("my 1"), f", {TERMS} SELECT * FROM terms WHERE contains(upper(term), 'MY 1')")
serve("programs_of_term", "program_go_top", lambda c: c.groups_of_term("program", "LARGE 22"), "SELECT * FROM program_go_top WHERE term = 'LARGE 22'")
serve("archetypes_of_term", "archetype_go_top", lambda c: c.groups_of_term("archetype", "LARGE 22"), "SELECT * FROM archetype_go_top WHERE term = 'LARGE 22'")
serve("program_centers", "modules module_program", lambda c: c.program_centers(2), "SELECT module_id, center_offset, width, dominant_weight FROM modules JOIN module_program USING (module_id) WHERE dominant_program = 2")
serve("genes_in_archetype", "gene_archetypes gene_configs", lambda c: c.genes_in_archetype(2, 50), "SELECT a.transcript_id, a.gene_name, dominant_archetype, dominant_weight, n_modules, program_path FROM gene_archetypes a JOIN gene_configs c USING (transcript_id) WHERE dominant_archetype = 2 ORDER BY dominant_weight DESC, a.transcript_id LIMIT 50")
serve("program_cooccurrence", "modules module_program", lambda c: c.program_cooccurrence(), ", m AS (SELECT DISTINCT gene_name AS k, dominant_program AS g FROM modules JOIN module_program USING (module_id) WHERE gene_name <> ''), s AS (SELECT g, count(*) AS n FROM m GROUP BY g), t AS (SELECT count(DISTINCT k) AS n_rows FROM m) SELECT a.g AS a, b.g AS b, count(*) AS n_shared, round(CAST(count(*) AS DOUBLE) * min(n_rows) / (CAST(min(x.n) AS DOUBLE) * min(y.n)), 3) AS lift FROM m a JOIN m b USING (k) JOIN s x ON a.g = x.g JOIN s y ON b.g = y.g, t GROUP BY 1, 2")
serve("cluster_members", "tf", lambda c: c.cluster_members("filtered", 1), "SELECT tf, 'filtered' AS cluster_set, cluster_filtered AS cluster, peak_dist_filtered AS peak_distance FROM tf WHERE cluster_filtered = 1")
serve("tf_clusters", "tf", lambda c: c.tf_clusters(), "SELECT tf, 'filtered' AS cluster_set, cluster_filtered AS cluster, peak_dist_filtered AS peak_distance FROM tf WHERE cluster_filtered IS NOT NULL UNION ALL SELECT tf, 'no_filter', cluster_no_filter, peak_dist_no_filter FROM tf WHERE cluster_no_filter IS NOT NULL")
serve("tf_program_loadings", "program_tf_top", lambda c: c.tf_program_loadings("Brand#1"), "SELECT * FROM program_tf_top WHERE tf = 'Brand#1'")
serve("representative_modules", "module_program module_tf_target modules", lambda c: c.representative_modules(2, 10), ", own AS (SELECT module_id, dominant_weight FROM module_program WHERE dominant_program = 2 ORDER BY dominant_weight DESC, module_id LIMIT 10), named AS (SELECT module_id, string_agg(tf, ', ' ORDER BY k) AS top_tfs FROM (SELECT module_id, tf, row_number() OVER (PARTITION BY module_id ORDER BY abs(r) DESC, tf) AS k FROM module_tf_target SEMI JOIN own USING (module_id)) WHERE k <= 5 GROUP BY module_id) SELECT m.*, dominant_weight, top_tfs FROM modules m JOIN own USING (module_id) LEFT JOIN named USING (module_id)")
serve("strand_shares", "modules module_program tss", lambda c: c.strand_distribution(), "SELECT dominant_program, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus, round(count(*) FILTER (strand = '+') / count(*), 4) AS share FROM modules m JOIN module_program USING (module_id) JOIN tss ON tss.tss_id = m.tss_id GROUP BY dominant_program")
serve("program_diff", "gene_configs", lambda c: c.program_diff("T7", "T8"), ", a AS (SELECT DISTINCT unnest(string_split(program_path, ',')) AS program FROM gene_configs WHERE transcript_id = 'T7'), b AS (SELECT DISTINCT unnest(string_split(program_path, ',')) AS program FROM gene_configs WHERE transcript_id = 'T8') SELECT coalesce(a.program, b.program) AS program, CASE WHEN b.program IS NULL THEN 'a only' WHEN a.program IS NULL THEN 'b only' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.program = b.program")
serve("gene_frequency", "program_go_top tss", lambda c: c.gene_frequency("LARGE 22"), "SELECT item, count(*) AS n FROM (SELECT trim(unnest(string_split(genes_in_overlap, ','))) AS item FROM program_go_top WHERE term = 'LARGE 22') WHERE item IN (SELECT gene_name FROM tss WHERE gene_name <> '') GROUP BY item")
serve("lineage_index", "lineages", lambda c: c.lineage_index(), "SELECT * FROM lineages")
serve("gene_lineage", "gene_lineage", lambda c: c.gene_lineage("Brand#1"), "SELECT * FROM gene_lineage WHERE gene = 'Brand#1'")
serve("gene_summary", "gene_summary", lambda c: c.gene_summary(["Brand#1", "Brand#7", "none"]), "SELECT * FROM gene_summary WHERE gene IN ('Brand#1', 'Brand#7', 'none')")
for _name in ("chronos", "expression"):
    serve(f"{_name}_matrix", _name, lambda c, n=_name: c.matrix(n, ["Brand#1", "Brand#2"]), f"SELECT model_id, max(value) FILTER (gene = 'Brand#1') AS \"Brand#1\", max(value) FILTER (gene = 'Brand#2') AS \"Brand#2\" FROM {_name} WHERE gene IN ('Brand#1', 'Brand#2') GROUP BY model_id")
serve("cell_line_metadata", "cell_lines", lambda c: c.cell_line_metadata(), "SELECT * FROM cell_lines")
serve("tf_target_correlation", "chronos expression", lambda c: c.tf_target_correlation("Brand#1", 5), "SELECT x.gene AS tf, round_even(corr(x.value, y.value), 3) AS r, count(*) AS n FROM expression x JOIN chronos y USING (model_id) WHERE y.gene = 'Brand#1' GROUP BY x.gene HAVING count(*) >= 5")
serve("tf_target_values", "chronos expression cell_lines", lambda c: c.tf_target_values("Brand#2", "Brand#1"), "SELECT x.model_id, x.value AS expression, y.value AS chronos, name, lineage FROM expression x JOIN chronos y USING (model_id) LEFT JOIN cell_lines USING (model_id) WHERE x.gene = 'Brand#2' AND y.gene = 'Brand#1'")
serve("tissue_index", "tissues", lambda c: c.tissue_index(), "SELECT * FROM tissues")
serve("transcript_stats", "transcript_tissue", lambda c: rounded(c.transcript_stats("T7"), 4, "below", "above"), "SELECT *, round(greatest(mean - q1, 0), 4) AS below, round(greatest(q3 - mean, 0), 4) AS above FROM transcript_tissue WHERE transcript_id = 'T7'")
serve("tf_expression", "tf_tissue", lambda c: c.tf_expression("Brand#1"), "SELECT tissue, tpm FROM tf_tissue WHERE tf = 'Brand#1'")
serve("module_activity", "module_activity modules", lambda c: c.module_activity("T7"), "SELECT a.*, center_offset FROM module_activity a JOIN modules USING (module_id) WHERE transcript_id = 'T7'")
serve("module_target_evidence", "modules module_program module_target", lambda c: c.module_target_evidence("T7"), "SELECT module_id, center_offset, dominant_program, r_module_target, n_tfs_high_r, CASE WHEN n_tfs_high_r = 0 THEN 'no-driver' WHEN n_tfs_high_r = 1 THEN 'single-driver' ELSE 'multi-driver' END AS driver_class FROM modules JOIN module_program USING (module_id) JOIN module_target USING (module_id) WHERE transcript_id = 'T7'")
serve("module_tf_evidence", "module_tf_target", lambda c: c.module_tf_evidence(7), "SELECT * FROM module_tf_target WHERE module_id = 7")
serve("program_driver_classes", "module_program module_target", lambda c: c.driver_class_distribution(), "SELECT dominant_program, CASE WHEN n_tfs_high_r IS NULL THEN '' WHEN n_tfs_high_r = 0 THEN 'no-driver' WHEN n_tfs_high_r = 1 THEN 'single-driver' ELSE 'multi-driver' END AS driver_class, count(*) AS n FROM module_program LEFT JOIN module_target USING (module_id) GROUP BY 1, 2")
serve("program_tf_tissue", "program_tf_top tf_tissue", lambda c: c.program_tf_tissue(2, ["NATION_1", "NATION_2"], 10), "SELECT program, rank, tf, loading, max(tpm) FILTER (tissue = 'NATION_1') AS \"NATION_1\", max(tpm) FILTER (tissue = 'NATION_2') AS \"NATION_2\" FROM program_tf_top LEFT JOIN tf_tissue USING (tf) WHERE program = 2 AND rank <= 10 GROUP BY 1, 2, 3, 4")
serve("program_specificity", "program_tau", lambda c: c.program_specificity(), "SELECT * FROM program_tau")
serve("archetype_specificity", "gene_archetypes transcript_tissue", lambda c: rounded(c.archetype_specificity(), 6, "tau"), ", v AS (SELECT dominant_archetype, tissue, avg(mean) AS v FROM transcript_tissue JOIN gene_archetypes USING (transcript_id) GROUP BY 1, 2) SELECT dominant_archetype, round(sum(1 - v / m) / (count(*) - 1), 6) AS tau, count(*) AS n FROM v JOIN (SELECT dominant_archetype, max(v) AS m FROM v GROUP BY 1) USING (dominant_archetype) GROUP BY dominant_archetype")
serve("tf_target_table", "tf_target", lambda c: c.tf_target_table("Brand#1"), "SELECT * FROM tf_target WHERE target = 'Brand#1' AND abs(r) >= 0.3")
serve("profiles", "profiles", lambda c: c.profiles("score").select("tf", F.concat_ws(",", F.transform("profile", lambda v: v.cast("bigint").cast("string"))).alias("profile")), "SELECT tf, string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS profile FROM profiles WHERE flavour = 'score' GROUP BY tf")
serve("top_terms_table", "program_go_top", lambda c: c.top_terms_table("program"), "SELECT program, CAST(k AS INT) AS rank, term, go_id, fg_in, p_value, q_value, genes_in_overlap FROM (SELECT *, row_number() OVER (PARTITION BY program ORDER BY q_value, p_value, term) AS k FROM program_go_top) WHERE k <= 5")
serve("frequent_paths", "gene_configs", lambda c: c.frequent_paths(), "SELECT program_path, count(*) AS n_genes, min(gene_name) AS example FROM gene_configs GROUP BY program_path ORDER BY n_genes DESC, program_path LIMIT 50")
serve("manifest", "tss tf programs", lambda c: c.manifest(), "SELECT 'programs' AS \"table\", count(*) AS n_rows FROM programs UNION ALL SELECT 'tf', count(*) FROM tf UNION ALL SELECT 'tss', count(*) FROM tss")
