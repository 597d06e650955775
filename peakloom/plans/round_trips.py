"""Queries of sources and sinks: supplied rows are written in a format of the build, into the shared folder, and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..session import scratch
from ..sources import files as fs
from .queries import P, peaks, query, table


def _blocks(spark, sf):
    return peaks(spark, sf).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), (F.col("pos") - 1_704_000_000).cast("int").alias("start"), (F.col("pos") - 1_703_999_975).cast("int").alias("end"), F.col("tf").alias("name"), F.col("score").cast("int").alias("score"))


BED = "SELECT 'chr' || chrom AS chrom, CAST(pos - 1704000000 AS INT) AS start, CAST(pos - 1703999975 AS INT) AS \"end\", tf AS name, CAST(score AS INT) AS score FROM peaks"


@query(f"WITH {P} {BED}")
def bed_scan(spark, sf):
    """Blocks as gzipped BED, with a track line in every file's way."""
    path = scratch(spark, "bed")
    _blocks(spark, sf).write.option("compression", "gzip").csv(path, sep="\t")
    spark.createDataFrame([("track name=x",), ("# comment",)], "line string").write.mode("append").option("compression", "gzip").text(path)
    return fs.read_bed(spark, f"{path}/*.gz").drop("feature")


@query(f"WITH {P} SELECT CASE WHEN tf = 'click' THEN 'tap' ELSE tf END AS feature, count(*) AS n, CAST(min(pos - 1704000000) AS INT) AS least FROM peaks GROUP BY 1")
def discovered_features(spark, sf):
    """A file for each feature, found by pattern, under current names from a map with comments; too few files would fail."""
    path, names = scratch(spark, "features"), scratch(spark, "names")
    fs.write_files(_blocks(spark, sf), path, "name", ".bed.gz")
    spark.createDataFrame([("# which are current",), ("antigen\tclass\tcurrent_symbol",), ("click\trenamed_gene\ttap",), ("error\tother\tfault",)], "line string").coalesce(1).write.text(names)
    found = fs.discover(spark, f"{path}/*.bed.gz", fs.rename_map(spark, names), least=3)
    return found.groupBy("feature").agg(F.count("*").alias("n"), F.min("start").alias("least"))


@query("SELECT 'chr' || c_nationkey AS chrom, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 ELSE c_custkey * 10 + 99 END AS INT) AS anchor, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'G' || c_custkey AS gene_id, c_mktsegment AS gene_name, 'T' || c_custkey AS transcript_id FROM customer WHERE c_acctbal > 0")
def gtf_anchors(spark, sf):
    """Tagged transcripts' strand-aware starts, from GTF lines."""
    return fs.read_gtf(spark, _gtf(spark, sf)).drop("gene_biotype")


@query("SELECT DISTINCT c_mktsegment AS gene_name FROM customer")
def gtf_symbols(spark, sf):
    return fs.gene_symbols(spark, _gtf(spark, sf))


def _gtf(spark, sf):
    path, c = scratch(spark, "gtf"), F.col("c_custkey")
    strand, tag = F.when(c % 2 == 0, "+").otherwise("-"), F.when(F.col("c_acctbal") > 0, ' tag "basic"; tag "Ensembl_canonical";').otherwise(' tag "basic";')
    ids = F.format_string('gene_id "G%d"; gene_name "%s"; transcript_id "T%d";', c, F.col("c_mktsegment"), c)
    line = lambda feature, more: F.concat_ws("\t", F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")), F.lit("src"), F.lit(feature), (c * 10 + 1).cast("string"), (c * 10 + 100).cast("string"), F.lit("."), strand, F.lit("."), F.concat(ids, more))
    lines = table(spark, sf, "customer").select(F.explode(F.array(line("gene", F.lit("")), line("transcript", tag))).alias("value"))
    spark.createDataFrame([("#!genome",)], "value string").unionByName(lines).write.text(path)
    return path


@query(f"WITH {P} SELECT 'chr' || chrom AS chrom, CAST(pos - 1704000000 AS INT) AS start, CAST(pos - 1703999975 AS INT) AS \"end\", tf, CAST(score AS INT) AS score, 'SRX' || event_id AS srx, 'Group ' || chrom AS cell_group FROM peaks")
def strip_seven(spark, sf):
    """Raw assembled lines to seven columns; a track line and short lines go."""
    path = scratch(spark, "raw")
    name = F.format_string("ID=SRX%d;Name=%s%%20(@%%20cell);Cell%%20group=Group%%20%d;", "event_id", "tf", "chrom")
    lines = peaks(spark, sf).select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom").cast("string")), (F.col("pos") - 1_704_000_000).cast("string"), (F.col("pos") - 1_703_999_975).cast("string"), name, F.col("score").cast("string")).alias("value"))
    spark.createDataFrame([("track name=all",), ("a\tb",)], "value string").unionByName(lines).write.text(path)
    return fs.strip7(spark, path)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def tsv_round_trip(spark, sf):
    path = scratch(spark, "tsv")
    fs.write_tsv(table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return fs.read_tsv(spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double")


@query("SELECT CAST(c_custkey AS VARCHAR) AS model_id, s AS gene, CASE WHEN s = 'A1' THEN c_acctbal WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS DOUBLE) END AS value FROM customer, (SELECT unnest(['A1', 'B2']) AS s)")
def wide_matrix(spark, sf):
    """Headers 'SYMBOL (id)', of equal symbols the first column counts; empty and NaN cells are null."""
    path = scratch(spark, "wide")
    nation = F.when(F.col("c_nationkey") == 3, F.lit("NaN")).otherwise(F.col("c_nationkey").cast("string"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ModelID"), F.col("c_acctbal").cast("string").alias("A1 (17)"), nation.alias("B2 (4)"), F.lit("7").alias("A1 (99)"))
    rows.coalesce(1).write.csv(path, header=True)  # one header, as such files have
    return fs.read_matrix(spark, path, "model_id", "gene", "value")


@query("SELECT 'T' || s_suppkey AS transcript_id, 'tissue ' || k % 2 AS tissue, CAST(s_nationkey + k AS DOUBLE) AS tpm, 'S' || k AS sample FROM supplier, (SELECT unnest([0, 1, 3]) AS k) WHERE s_acctbal > 0")
def samples_by_tissue(spark, sf):
    """Transcripts by samples, cut to known transcripts (their versions stripped) and to samples with a tissue."""
    path, names = scratch(spark, "samples"), scratch(spark, "tissues")
    wide = table(spark, sf, "supplier").select(F.format_string("T%d.%d", "s_suppkey", "s_nationkey").alias("transcript_id"), F.lit("g").alias("gene_id"), *[(F.col("s_nationkey") + k).cast("string").alias(f"S{k}") for k in range(4)])
    fs.write_tsv(wide.coalesce(1), path)
    fs.write_tsv(spark.createDataFrame([(f"S{k}", None if k == 2 else f"tissue {k % 2}") for k in range(4)], "SAMPID string, SMTSD string"), names, gzip=False)
    known = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.format_string("T%d", "s_suppkey").alias("transcript_id"))
    return fs.read_samples(spark, path, names, known)


@query("SELECT p_brand AS term, 'GO:' || min(p_partkey) OVER (PARTITION BY p_brand) AS go_id, CAST(p_partkey AS VARCHAR) AS gene FROM part")
def gene_sets(spark, sf):
    path = scratch(spark, "sets")
    sets = table(spark, sf, "part").groupBy("p_brand").agg(F.concat(F.lit("GO:"), F.min("p_partkey").cast("string")).alias("exactSource"), F.collect_set(F.col("p_partkey").cast("string")).alias("geneSymbols"))
    one = sets.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("exactSource", "geneSymbols"))))).alias("value"))
    one.write.text(path)
    return fs.read_gene_sets(spark, path)


@query("SELECT l_orderkey AS row, CAST(substr(p_brand, 7) AS BIGINT) AS col, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def sparse_load(spark, sf):
    """Compressed sparse row blocks (npz), a block a row of binary content, loaded as cells."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("CAST(substr(p_brand, 7) AS BIGINT)").alias("col"))
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), "l_partkey").join(part, "l_partkey").groupBy("row", "col").agg(F.count("*").cast("double").alias("value"))
    path = scratch(spark, "sparse")
    fs.sparse_blocks(cells, 4096).write.parquet(path)
    return fs.sparse_cells(spark.read.parquet(path))


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE (k - 1) % 10 = 0")
def stride_sample(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return fs.strided(table(spark, sf, "lineitem").select("l_returnflag", *keys), keys, ["l_returnflag"], 10)


@query(f"WITH {P}, b AS ({BED}) SELECT chrom, start, \"end\", name, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start, \"end\", chrom, score) AS k FROM b) WHERE (k - 1) % 10 = 0")
def strided_scan(spark, sf):
    """Every tenth line of each feature's gzip file, by a scan that parses no other and shuffles nothing."""
    path = scratch(spark, "sorted")
    rows = _blocks(spark, sf).withColumn("__key", F.col("name")).repartition("__key").sortWithinPartitions("__key", "start", "end", "chrom", "score")
    rows.write.partitionBy("__key").option("compression", "gzip").csv(path, sep="\t")
    return fs.read_strided(spark, f"{path}/*/*.gz", 1, stride=10).drop("feature")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#3'")
def shard_of_key(spark, sf):
    """A folder for each brand, of which one is read."""
    path = scratch(spark, "shards")
    fs.write_table(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), path, by="p_brand", sort=["p_partkey"])
    return spark.read.parquet(path).filter("p_brand = 'Brand#3'").drop("p_brand")


@query("SELECT p_brand, count(*) AS n, sum(CAST(p_size AS BIGINT)) AS sizes FROM part WHERE p_size > 10 GROUP BY p_brand".replace("sum(CAST(p_size AS BIGINT))", "CAST(sum(p_size) AS BIGINT)"))
def catalog_table(spark, sf):
    """Two halves of part into one table with declared types, and a view over it."""
    part, name = table(spark, sf, "part"), f"peakloom_part_{spark.sparkContext.applicationId.replace('-', '_')}"
    path = scratch(spark, "table")
    fs.create_table(part.filter("p_size <= 25"), name, path, {"p_size": "smallint", "p_partkey": "bigint", "p_brand": "string"})
    fs.insert_rows(part.filter("p_size > 25"), name)
    view = fs.create_view(spark, f"{name}_large", f"SELECT * FROM {name} WHERE p_size > 10")
    return view.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


@query("SELECT count(*) AS n_rows, true AS whole FROM orders")
def checked_archive(spark, sf):
    """An archive whose manifest (files, bytes, checksums, rows) is held against what is read back."""
    path = scratch(spark, "archive")
    fs.write_archive(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return fs.check_archive(spark, path)


@query("SELECT s_suppkey, s_name FROM supplier")
def atomic_table(spark, sf):
    """Written beside its place and moved there; a second write replaces it whole, and a finished build isn't made again."""
    path, supplier = scratch(spark, "atomic"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    fs.write_atomic(supplier.limit(1), path)
    fs.write_atomic(supplier, path)
    return fs.resume(spark, path, lambda: supplier.limit(0))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def checked_keys(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return rel.assert_unique(counts, ["p_brand"])
