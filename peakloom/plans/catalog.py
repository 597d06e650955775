"""The serve layer: typed queries over the tables of a finished build. A table that is missing reads as an empty frame
where the build may lack it, and fails where it may not (core tables)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import contains_text
from ..operators import relational as rel
from ..operators import stats as st

#: Columns of each table; weights are arrays whose length is the rank.
SCHEMAS = {
    "tss": "tss_id int, transcript_id string, gene_id string, gene_name string, chrom string, tss int, strand string",
    "tf": "tf_idx int, tf string, n_peaks_total long, n_peaks_kept long, binary_total double, score_total double, n_bound_tss_core long, frac_tss_core double, cluster_filtered int, peak_dist_filtered int, cluster_no_filter int, peak_dist_no_filter int",
    "peaks": "tss_id int, tf_idx int, local_offset short, score short",
    "modules": "module_id int, tss_id int, transcript_id string, gene_name string, module_local_idx int, lo_offset int, hi_offset int, center_offset int, width int, n_peaks_in int, n_tfs_supporting int, n_tfs_assigned int",
    "module_program": "module_id int, dominant_program int, dominant_weight float, weights array<float>",
    "programs": "program int, n_modules int, median_center int, median_width int, mean_dom_weight float, top_tfs string, reading string",
    "program_tf_top": "program int, rank int, tf string, loading float",
    "program_go_top": "program int, rank int, term string, go_id string, fg_in int, set_size_in_bg int, odds_ratio float, p_value double, q_value double, genes_in_overlap string",
    "gene_configs": "transcript_id string, gene_name string, n_modules int, program_path string, centers string, widths string",
    "gene_archetypes": "transcript_id string, gene_name string, dominant_archetype int, dominant_weight float, weights array<float>",
    "archetypes": "archetype int, n_genes int, mean_modules float, top_programs string",
    "archetype_program_loading": "archetype int, program int, loading float",
    "archetype_go_top": "archetype int, rank int, term string, go_id string, fg_in int, set_size_in_bg int, odds_ratio float, p_value double, q_value double, genes_in_overlap string",
    "gene_lineage": "gene string, lineage string, n_lines int, mean_chronos double, median_chronos double, frac_essential double",
    "gene_summary": "gene string, n_lines int, median_chronos double, frac_essential double, most_essential_lineage string, most_essential_chronos double",
    "lineages": "lineage string, n_lines int",
    "chronos": "model_id string, gene string, value double",
    "expression": "model_id string, gene string, value double",
    "cell_lines": "model_id string, name string, lineage string",
    "tissues": "tissue string, n_samples int",
    "transcript_tissue": "transcript_id string, tissue string, n_samples int, mean float, median float, q1 float, q3 float, std float",
    "tf_tissue": "tf string, tissue string, tpm double",
    "module_activity": "module_id int, tissue string, mean_tf_tpm float, n_tfs_in_module int",
    "module_target": "module_id int, r_module_target float, top_driver_tf string, top_driver_r float, n_tfs_high_r int, n_supporting_tissues int, top_supporting_tissue string",
    "module_tf_target": "module_id int, tf string, r float",
    "program_tau": "program int, tau double",
    "tf_target": "target string, tf string, r double, n int",
    "pairs": "item_a string, item_b string, n_shared long, n_a long, n_b long, jaccard double, lift double",
    "profiles": "flavour string, tf string, pos int, value double",
}
CORE = {"tss", "tf", "peaks", "modules", "module_program", "programs"}


@dataclass
class Catalog:
    """Tables by name; each query is a method that gives a DataFrame, ordered completely where it is ordered."""

    spark: SparkSession
    tables: dict[str, DataFrame]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        """Tables as parquet folders below path."""
        found = {}
        for name in SCHEMAS:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                found[name] = spark.read.parquet(f"{path}/{name}")
        return cls(spark, found)

    def t(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in CORE:
            raise FileNotFoundError(f"the build has no table {name}")
        return self.spark.createDataFrame([], SCHEMAS[name])

    def has(self, *names: str) -> bool:
        return all(n in self.tables for n in names)

    def manifest(self) -> DataFrame:
        """(table, n_rows) of what is there."""
        out = None
        for name, df in sorted(self.tables.items()):
            one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "table string, n_rows long") if out is None else out

    # lists and single rows

    def _list(self, name: str, column: str) -> DataFrame:
        return self.t(name).filter((F.col(column) != "") & F.col(column).isNotNull()).select(column).distinct().orderBy(column)

    def list_genes(self):
        return self._list("tss", "gene_name")

    def list_transcripts(self):
        return self._list("tss", "transcript_id")

    def list_tfs(self):
        return self._list("tf", "tf")

    def tss_meta(self, transcript: str):
        return self.t("tss").filter(F.col("transcript_id") == transcript).orderBy("tss_id").limit(1)

    def transcripts_of_gene(self, gene: str):
        return self.t("tss").filter(F.col("gene_name") == gene).orderBy("chrom", "tss", "transcript_id")

    def tf_meta(self, tf: str):
        return self.t("tf").filter(F.col("tf") == tf)

    def gene_config(self, transcript: str):
        return self.t("gene_configs").filter(F.col("transcript_id") == transcript)

    def gene_archetype(self, transcript: str):
        return self.t("gene_archetypes").filter(F.col("transcript_id") == transcript)

    def programs(self):
        return self.t("programs").orderBy("program")

    def archetypes(self):
        return self.t("archetypes").orderBy("archetype")

    def archetype_loadings(self):
        return self.t("archetype_program_loading").orderBy("archetype", "program")

    # an anchor's modules and peaks

    def modules_of(self, transcript: str):
        m = self.t("modules").filter(F.col("transcript_id") == transcript).join(self.t("module_program"), "module_id")
        top = self.t("programs").select(F.col("program").alias("dominant_program"), "reading", "top_tfs")
        return m.join(top, "dominant_program", "left").orderBy("center_offset", "module_id")

    def peaks_of(self, tss_id: int, min_score: int = 0):
        hit = self.t("peaks").filter((F.col("tss_id") == tss_id) & (F.col("score") >= min_score))
        return hit.join(self.t("tf").select("tf_idx", "tf"), "tf_idx").select("tf", "local_offset", "score").orderBy("tf", "local_offset", "score")

    def tf_summary(self, tss_id: int, min_score: int = 0):
        """By feature: peaks, best score, mean offset; ordered upstream to downstream."""
        p = self.peaks_of(tss_id, min_score)
        return p.groupBy("tf").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.avg("local_offset").alias("mean_offset")).orderBy("mean_offset", "tf")

    def top_tss_of(self, tf: str, min_score: int = 500, n: int = 50):
        idx = self.tf_meta(tf).select("tf_idx")
        hit = self.t("peaks").filter(F.col("score") >= min_score).join(idx, "tf_idx", "left_semi").groupBy("tss_id").agg(F.count("*").alias("n_peaks"), F.min("local_offset").alias("least"), F.max("local_offset").alias("most"))
        return hit.join(self.t("tss").select("tss_id", "transcript_id", "gene_name"), "tss_id").orderBy(F.desc("n_peaks"), "tss_id").limit(n)

    # programs, archetypes, terms

    def program_top_tfs(self, program: int, n: int = 30):
        return self.t("program_tf_top").filter((F.col("program") == program) & (F.col("rank") <= n)).orderBy("rank")

    def program_top_tfs_enriched(self, program: int, n: int = 30):
        """With the features' clusters and the tissue where each is highest."""
        own = self.t("tf").select("tf", "cluster_filtered", "cluster_no_filter")
        tissue = st.top_category(self.t("tf_tissue"), "tf", "tissue", "tpm").withColumn("top_value", F.round("top_value", 2))
        return self.program_top_tfs(program, n).join(own, "tf", "left").join(tissue, "tf", "left").orderBy("rank")

    def top_terms(self, kind: str, group: int, n: int = 15):
        """kind: program or archetype."""
        return self.t(f"{kind}_go_top").filter((F.col(kind) == group) & (F.col("rank") <= n)).orderBy("rank")

    def list_terms(self):
        """Terms of both sources: how many programs and archetypes have them, least q."""
        p = self.t("program_go_top").select("term", "go_id", "q_value", F.col("program"))
        a = self.t("archetype_go_top").select("term", "go_id", "q_value", F.col("archetype"))
        both = p.unionByName(a, allowMissingColumns=True)
        got = both.groupBy("term").agg(F.min("go_id").alias("go_id"), F.count_distinct("program").alias("n_programs"), F.count_distinct("archetype").alias("n_archetypes"), F.min("q_value").alias("min_q"))
        return got.orderBy(F.desc(F.col("n_programs") + F.col("n_archetypes")), "term")

    def groups_of_term(self, kind: str, term: str):
        return self.t(f"{kind}_go_top").filter(F.col("term") == term).orderBy("q_value", kind)

    def program_centers(self, program: int):
        own = self.t("module_program").filter(F.col("dominant_program") == program).select("module_id", "dominant_weight")
        return self.t("modules").join(own, "module_id").select("module_id", "center_offset", "width", "dominant_weight").orderBy("module_id")

    def genes_in_archetype(self, archetype: int, n: int = 100):
        own = self.t("gene_archetypes").filter(F.col("dominant_archetype") == archetype)
        return own.join(self.t("gene_configs").select("transcript_id", "n_modules", "program_path"), "transcript_id").orderBy(F.desc("dominant_weight"), "transcript_id").limit(n)

    def program_cooccurrence(self):
        """Programs that occur in the same genes, the diagonal included; genes without name don't count."""
        m = self.t("modules").filter("gene_name is not null and gene_name <> ''").join(self.t("module_program"), "module_id")
        return rel.group_cooccurrence(m.select("gene_name", "dominant_program"), "gene_name", "dominant_program")

    def tf_clusters(self):
        """(tf, cluster_set, cluster, peak_distance) of both clusterings."""
        t = self.t("tf")
        sets = [t.select("tf", F.lit(n).alias("cluster_set"), F.col(f"cluster_{n}").alias("cluster"), F.col(f"peak_dist_{n}").alias("peak_distance")) for n in ("filtered", "no_filter")]
        return sets[0].unionByName(sets[1]).filter("cluster is not null")

    def cluster_members(self, cluster_set: str, cluster: int):
        return self.tf_clusters().filter((F.col("cluster_set") == cluster_set) & (F.col("cluster") == cluster)).orderBy("tf")

    def tf_program_loadings(self, tf: str):
        return self.t("program_tf_top").filter(F.col("tf") == tf).orderBy("program")

    def representative_modules(self, program: int, n: int = 20, features: int = 5):
        """A program's heaviest modules with their features by correlation, at most five as one text."""
        own = self.t("module_program").filter(F.col("dominant_program") == program).orderBy(F.desc("dominant_weight"), "module_id").limit(n)
        r = self.t("module_tf_target").join(own.select("module_id"), "module_id", "left_semi")
        named = rel.joined_top(r, ["module_id"], "tf", [F.desc(F.abs("r")), F.col("tf")], features, "top_tfs")
        return self.t("modules").join(own.select("module_id", "dominant_weight"), "module_id").join(named, "module_id", "left").orderBy(F.desc("dominant_weight"), "module_id")

    def strand_distribution(self):
        m = self.t("modules").join(self.t("module_program"), "module_id").join(self.t("tss").select("tss_id", "strand"), "tss_id")
        plus, minus = (F.sum((F.col("strand") == s).cast("long")) for s in "+-")
        return m.groupBy("dominant_program").agg(plus.alias("plus"), minus.alias("minus"), F.round(F.try_divide(plus, plus + minus), 4).alias("share")).orderBy("dominant_program")

    def program_diff(self, a: str, b: str):
        """Programs of two transcripts: in one only, or shared."""
        of = lambda t: self.gene_config(t).select(F.explode(F.split("program_path", ",")).alias("program"))
        return rel.presence_diff(of(a), of(b), "program")

    def gene_frequency(self, term: str):
        """How often each known gene is in the term's overlaps."""
        rows = self.t("program_go_top").filter(F.col("term") == term)
        return rel.explode_count(rows, "genes_in_overlap", ",", self.t("tss").select("gene_name")).orderBy(F.desc("n"), "item")

    # pairs

    def pair_query(self, text: str = "", min_shared: int = 5, order: str = "n_shared", limit: int = 200):
        return rel.pair_search(self.t("pairs"), text, min_shared, order, limit)

    def pair_stats(self, floor: int = 50):
        return rel.pair_stats(self.t("pairs"), floor)

    def cobinding_partners(self, tf: str, min_score: int = 500):
        members = self.t("peaks").filter(F.col("score") >= min_score).join(self.t("tf").select("tf_idx", "tf"), "tf_idx")
        return rel.partners(members, "tss_id", "tf", tf).orderBy(F.desc("n_shared"), "item")

    # dependency screens

    def lineage_index(self):
        return self.t("lineages").orderBy("lineage")

    def gene_lineage(self, gene: str):
        return self.t("gene_lineage").filter(F.col("gene") == gene).orderBy("median_chronos", "lineage")

    def gene_summary(self, genes: Sequence[str]):
        return self.t("gene_summary").filter(F.col("gene").isin(list(genes))).orderBy("gene")

    def matrix(self, name: str, genes: Sequence[str]):
        """chronos or expression, a column per gene."""
        return self.t(name).filter(F.col("gene").isin(list(genes))).groupBy("model_id").pivot("gene", sorted(genes)).agg(F.first("value", True)).orderBy("model_id")

    def cell_line_metadata(self):
        return self.t("cell_lines").orderBy("model_id")

    def tf_target_correlation(self, target: str, least: int = 50):
        """Each feature's expression against the target's dependency, pairwise complete; three digits."""
        y = self.t("chronos").filter(F.col("gene") == target).select("model_id", F.col("value").alias("y"))
        x = self.t("expression").select("model_id", F.col("gene").alias("tf"), F.col("value").alias("x"))
        return st.pearson(x.join(y, "model_id"), ["tf"], "x", "y", least).withColumn("r", F.bround("r", 3)).orderBy(F.desc(F.abs("r")), "tf")

    def tf_target_values(self, tf: str, target: str):
        x = self.t("expression").filter(F.col("gene") == tf).select("model_id", F.col("value").alias("expression"))
        y = self.t("chronos").filter(F.col("gene") == target).select("model_id", F.col("value").alias("chronos"))
        return x.join(y, "model_id").join(self.t("cell_lines"), "model_id", "left").orderBy("model_id")

    # tissues

    def tissue_index(self):
        return self.t("tissues").orderBy("tissue")

    def transcript_stats(self, transcript: str):
        return st.error_bars(self.t("transcript_tissue").filter(F.col("transcript_id") == transcript)).orderBy(F.desc("mean"), "tissue")

    def tf_expression(self, tf: str):
        return self.t("tf_tissue").filter(F.col("tf") == tf).select("tissue", "tpm").orderBy(F.desc("tpm"), "tissue")

    def module_activity(self, transcript: str):
        own = self.t("modules").filter(F.col("transcript_id") == transcript).select("module_id", "center_offset")
        return self.t("module_activity").join(own, "module_id").orderBy("center_offset", "tissue")

    def module_target_evidence(self, transcript: str):
        own = self.t("modules").filter(F.col("transcript_id") == transcript).select("module_id", "center_offset").join(self.t("module_program").select("module_id", "dominant_program"), "module_id")
        return own.join(self.t("module_target"), "module_id").withColumn("driver_class", rel.driver_class(F.col("n_tfs_high_r"))).orderBy("center_offset", "module_id")

    def module_tf_evidence(self, module_id: int):
        return self.t("module_tf_target").filter(F.col("module_id") == module_id).orderBy(F.desc(F.abs("r")), "tf")

    def driver_class_distribution(self):
        m = self.t("module_program").join(self.t("module_target"), "module_id", "left")
        return m.groupBy("dominant_program", rel.driver_class(F.col("n_tfs_high_r")).alias("driver_class")).agg(F.count("*").alias("n")).orderBy("dominant_program", "driver_class")

    def program_tf_tissue(self, program: int, tissues: Sequence[str], n: int = 30):
        """A program's top features by tissue, a column each."""
        wide = self.t("tf_tissue").groupBy("tf").pivot("tissue", list(tissues)).agg(F.first("tpm", True))
        return self.program_top_tfs(program, n).join(wide, "tf", "left").orderBy("rank")

    def program_specificity(self):
        return self.t("program_tau").orderBy("program")

    def archetype_specificity(self):
        """Tau of each archetype's mean over its genes, by tissue."""
        own = self.t("gene_archetypes").select("transcript_id", "dominant_archetype")
        means = self.t("transcript_tissue").join(own, "transcript_id").groupBy("dominant_archetype", "tissue").agg(F.avg("mean").alias("v"))
        return st.tau(means, "dominant_archetype", "v").orderBy("dominant_archetype")

    def tf_target_table(self, target: str, floor: float = 0.3):
        return self.t("tf_target").filter((F.col("target") == target) & (F.abs("r") >= floor)).orderBy(F.desc("r"), "tf")

    def profiles(self, flavour: str):
        """(tf, profile) with the profile as an array by position."""
        rows = self.t("profiles").filter(F.col("flavour") == flavour)
        listed = F.array_sort(F.collect_list(F.struct("pos", "value")))
        return rows.groupBy("tf").agg(F.transform(listed, lambda x: x["value"]).alias("profile")).orderBy("tf")

    # workbook tables

    def top_terms_table(self, kind: str, n: int = 5):
        order: list[Column] = [F.col("q_value"), F.col("p_value"), F.col("term")]
        return rel.top_per_group(self.t(f"{kind}_go_top").drop("rank"), [kind], order, n).orderBy(kind, "rank")

    def frequent_paths(self, n: int = 50):
        return self.t("gene_configs").groupBy("program_path").agg(F.count("*").alias("n_genes"), F.min("gene_name").alias("example")).orderBy(F.desc("n_genes"), "program_path").limit(n)

    def find_terms(self, text: str):
        return self.list_terms().filter(contains_text(text, "term"))
