import gzip
import json

import pytest

from peakloom.functions import scalars
from peakloom.plans.catalog import SCHEMAS, Catalog
from peakloom.sources import files
from pyspark.sql import functions as F


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "OLD.bed.gz", "wt") as f:
        f.write("track name=x\nchr1\t10\t20\tn\t500\t+\nchr1\t30\t40\tn\t50\n")
    (tmp_path / "TF2.bed").write_text("chr2\t1\t2\tn\t1000\n")
    names = spark.createDataFrame([("OLD", "NEW")], "a string, b string")
    got = files.discover(spark, f"{tmp_path}/*.bed*", names, least=2)
    assert sorted((r.feature, r.chrom, r.start, r.score) for r in got.collect()) == [("NEW", "chr1", 10, 500), ("NEW", "chr1", 30, 50), ("TF2", "chr2", 1, 1000)]
    with pytest.raises(ValueError):
        files.discover(spark, f"{tmp_path}/*.bed*", least=3)
    (tmp_path / "raw.txt").write_text("track x\nchr1\t5\t9\tID=SRX12;Name=GATA1%20(@%20K)(;Cell%20group=Blood%20x;\t77\t.\nbad\t1\n")
    assert tuple(files.strip7(spark, f"{tmp_path}/raw.txt").first()) == ("chr1", 5, 9, "GATA1", 77, "SRX12", "Blood x")
    (tmp_path / "a.gtf").write_text('#c\n1\te\ttranscript\t11\t50\t.\t-\t.\tgene_id "G"; gene_name "N"; transcript_id "T"; tag "basic"; tag "Ensembl_canonical";\n1\te\tgene\t1\t2\t.\t+\t.\tgene_id "G"; gene_name "N";\n')
    assert tuple(files.read_gtf(spark, f"{tmp_path}/a.gtf").first())[:6] == ("1", 49, "-", "G", "N", "T")
    assert [r[0] for r in files.gene_symbols(spark, f"{tmp_path}/a.gtf").collect()] == ["N"]
    (tmp_path / "m.csv").write_text("ModelID,A (1),B (2),A (3)\nx,1.5,NaN,9\ny,,2,9\n")
    assert sorted(map(tuple, files.read_matrix(spark, f"{tmp_path}/m.csv", "model").collect()), key=str) == sorted([("x", "A", 1.5), ("x", "B", None), ("y", "A", None), ("y", "B", 2.0)], key=str)
    (tmp_path / "s.json").write_text(json.dumps({"T1": {"exactSource": "GO:1", "geneSymbols": ["a", "b", "a"]}}))
    assert sorted(map(tuple, files.read_gene_sets(spark, f"{tmp_path}/s.json").collect())) == [("T1", "GO:1", "a"), ("T1", "GO:1", "b")]
    df = spark.createDataFrame([("a", str(i)) for i in range(5)] + [("a", "x")], "k string, score string")
    assert files.score_tier(df, 3).count() == 2
    assert files.write_table(df, f"{tmp_path}/out", by="k") == 6
    calls = []
    build = lambda: calls.append(1) or df
    assert files.resume(spark, f"file://{tmp_path}/r", build).count() == files.resume(spark, f"file://{tmp_path}/r", build).count() == 6 and len(calls) == 1
    assert files.strided(df.filter("score <> 'x'"), ["score"], ["k"], 2).count() == 3


def test_spec(monkeypatch):
    spec = files.BuildSpec("q5", min_score=100)
    assert spec.path == "q5.all.s100"
    spec.check(spec.stamp(n=1))
    for bad in (lambda: files.BuildSpec("q5").check(spec.stamp()), lambda: files.BuildSpec(""), lambda: files.BuildSpec("a", min_score=2000)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        files.BuildSpec.from_env("NONE_")
    monkeypatch.setenv("NONE_TIER", "t")
    assert files.BuildSpec.from_env("NONE_", {"rank": 4}).rank == 4


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(scalars.before_paren(F.lit("TP53 (7157)")), scalars.unversioned(F.lit("ENST1.2")), scalars.bare_chromosome(F.lit("chrM")), scalars.scientific(F.lit(0.000123)), scalars.safe_name(F.lit("a/b c")), scalars.hundredths(F.lit(-0.257)), scalars.clipped_score(F.lit(2000))).first()
    assert tuple(got) == ("TP53", "ENST1", "MT", "1.23e-04", "a_b_c", -26, 1000)
    assert scalars.score_of_q(1e-5) == 50 and one.select(scalars.pretty_term(F.lit("GOBP_CELL_CYCLE"), "GOBP_")).first()[0] == "cell cycle"


def test_catalog(spark):
    def frame(name, *data):
        return spark.createDataFrame(list(data), SCHEMAS[name])

    tables = {
        "tss": frame("tss", (1, "T1", "G1", "A", "1", 100, "+"), (2, "T2", "G2", "B", "1", 900, "-"), (3, "T3", "G3", "", "2", 5, "+")),
        "tf": frame("tf", (0, "X", 9, 8, 1.0, 2.0, 2, 0.5, 1, -30, None, None), (1, "Y", 9, 8, 1.0, 2.0, 2, 0.5, 2, 10, 1, 5)),
        "peaks": frame("peaks", (1, 0, -10, 600), (1, 1, 20, 700), (2, 0, 5, 900), (2, 0, 7, 100)),
        "modules": frame("modules", (0, 1, "T1", "A", 0, -20, 30, 5, 51, 2, 2, 2), (1, 2, "T2", "B", 0, 0, 9, 4, 10, 2, 1, 1), (2, 2, "T2", "B", 1, 50, 90, 60, 41, 2, 1, 1)),
        "module_program": frame("module_program", (0, 1, 0.9, [0.9, 0.1]), (1, 1, 0.6, [0.6, 0.4]), (2, 2, 0.8, [0.2, 0.8])),
        "programs": frame("programs", (1, 2, 5, 30, 0.7, "X, Y", "r"), (2, 1, 60, 41, 0.8, "Y", "s")),
        "program_go_top": frame("program_go_top", (1, 1, "GO_B", "1", 1, 5, 2.0, 0.01, 0.02, "A, B, Z"), (2, 1, "GO_B", "1", 1, 5, 2.0, 0.01, 0.03, "A")),
        "archetype_go_top": frame("archetype_go_top", (1, 1, "GO_C", "2", 1, 5, 2.0, 0.01, 0.5, "A")),
        "gene_configs": frame("gene_configs", ("T1", "A", 1, "1", "5", "51"), ("T2", "B", 2, "1,2", "4,60", "10,41")),
        "module_target": frame("module_target", (0, 0.5, "X", 0.6, 2, 3, "liver"), (1, 0.1, "Y", 0.2, 0, 0, None)),
        "module_tf_target": frame("module_tf_target", (0, "X", -0.6), (0, "Y", 0.5), (1, "Y", 0.2)),
        "tf_tissue": frame("tf_tissue", ("X", "liver", 5.0), ("X", "lung", 9.0), ("Y", "liver", 1.0)),
        "program_tf_top": frame("program_tf_top", (1, 1, "X", 0.9), (1, 2, "Y", 0.5)),
    }
    c = Catalog(spark, tables)
    one = lambda df: [tuple(r) for r in df.collect()]
    assert one(c.list_genes()) == [("A",), ("B",)] and one(c.list_tfs()) == [("X",), ("Y",)] and c.tss_meta("T9").isEmpty()
    assert [r.module_id for r in c.modules_of("T2").collect()] == [1, 2]
    assert one(c.peaks_of(1, 650)) == [("Y", 20, 700)] and [r.tf for r in c.tf_summary(1).collect()] == ["X", "Y"]
    assert [(r.tss_id, r.n_peaks) for r in c.top_tss_of("X").collect()] == [(1, 1), (2, 1)]
    assert [(r.term, r.n_programs, r.n_archetypes) for r in c.list_terms().collect()] == [("GO_B", 2, 0), ("GO_C", 0, 1)]
    assert one(c.program_cooccurrence().orderBy("a", "b")) == [(1, 1, 2, 1.0), (1, 2, 1, 1.0), (2, 1, 1, 1.0), (2, 2, 1, 2.0)]
    assert one(c.cluster_members("no_filter", 1)) == [("Y", "no_filter", 1, 5)]
    assert [(r.module_id, r.top_tfs) for r in c.representative_modules(1).collect()] == [(0, "X, Y"), (1, "Y")]
    assert one(c.strand_distribution()) == [(1, 1, 1, 0.5), (2, 0, 1, 0.0)]
    assert sorted(one(c.program_diff("T1", "T2"))) == [("1", "shared"), ("2", "b only")]
    assert one(c.gene_frequency("GO_B")) == [("A", 2), ("B", 1)]
    assert one(c.cobinding_partners("X")) == [("Y", 1, 1, 50.0, 100.0, 0.5)]
    assert one(c.driver_class_distribution()) == [(1, "multi-driver", 1), (1, "no-driver", 1), (2, "", 1)]
    assert [(r.tf, r.top, r.top_value) for r in c.program_top_tfs_enriched(1).collect()] == [("X", "lung", 9.0), ("Y", "liver", 1.0)]
    assert one(c.module_tf_evidence(0).select("tf")) == [("X",), ("Y",)] and c.gene_lineage("A").isEmpty() and c.pair_query("x").isEmpty()
    assert c.tf_target_correlation("A").isEmpty() and c.archetype_specificity().isEmpty() and c.frequent_paths(1).count() == 1
    for q in (c.list_transcripts, c.programs, c.archetypes, c.archetype_loadings, c.tf_clusters, c.lineage_index, c.cell_line_metadata, c.tissue_index, c.program_specificity, c.manifest):
        q().collect()
    for df in (c.transcripts_of_gene("A"), c.tf_meta("X"), c.gene_config("T1"), c.gene_archetype("T1"), c.top_terms("program", 1), c.groups_of_term("program", "GO_B"), c.program_centers(1), c.genes_in_archetype(1), c.tf_program_loadings("X"), c.pair_stats(), c.gene_summary(["A"]), c.matrix("chronos", ["A"]), c.tf_target_values("X", "A"), c.transcript_stats("T1"), c.tf_expression("X"), c.module_activity("T1"), c.module_target_evidence("T1"), c.program_tf_tissue(1, ["liver"]), c.tf_target_table("A"), c.profiles("binary"), c.top_terms_table("program"), c.find_terms("go")):
        df.collect()
    with pytest.raises(FileNotFoundError):
        Catalog(spark, {}).programs()


def test_env_file_is_under_the_environment(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# build\nexport PEAKLOOM_TIER='q1e-5'\nPEAKLOOM_RANK=7\nOTHER=1\n")
    monkeypatch.setenv("PEAKLOOM_RANK", "9")
    spec = files.BuildSpec.from_env(defaults={"axis": "main", "rank": 3}, env_file=str(tmp_path / ".env"))
    assert (spec.tier, spec.axis, spec.rank) == ("q1e-5", "main", 9)


def test_archive_tells_of_changes(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    files.write_archive(spark.range(100).selectExpr("id", "CAST(id AS string) AS s").repartition(3), path)
    assert tuple(files.check_archive(spark, path).first()) == (100, True)
    one = next((tmp_path / "archive/data").glob("part-*"))
    one.write_bytes(one.read_bytes()[:-3] + b"abc")
    crc = one.parent / f".{one.name}.crc"
    crc.unlink(missing_ok=True)
    assert files.check_archive(spark, path).first().whole is False


def test_sparse_files(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "m.npz", data=np.array([1.0, 2.0]), indices=np.array([3, 1]), indptr=np.array([0, 1, 1, 2]), shape=np.array([3, 4]))
    got = files.sparse_cells(spark.read.format("binaryFile").load(f"file://{tmp_path}/m.npz"))
    assert sorted(map(tuple, got.collect())) == [(0, 3, 1.0), (2, 1, 2.0)]


def test_strided_scan(spark, tmp_path):
    """Strides from file sizes, gzip or not, several files a task, comments counted and left out, no shuffle."""
    import gzip

    want = {}
    for name, n, pack in (("A.bed.gz", 5000, True), ("B.bed", 900, False), ("C.bed.gz", 3, True), ("D.bed.gz", 0, True)):
        lines = ["track name=x"] * (n > 0) + [f"chr{i % 7}\t{i}\t{i + 10}\tx\t{i % 1000}" for i in range(n)]
        data = "".join(f"{line}\n" for line in lines).encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if pack else data)
        size = (tmp_path / name).stat().st_size * (4 if pack else 1)
        stride = max(1, int(size / 50) // 40)
        want[name.split(".")[0]] = [int(line.split("\t")[1]) for line in lines[::stride] if not line.startswith("track")]
    got = files.read_strided(spark, str(tmp_path), 40)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    held = got.collect()
    assert sorted(map(str, held)) == sorted(map(str, got.collect()))
    for name, starts in want.items():
        assert sorted(r.start for r in held if r.feature == name) == starts
    assert len(want["A"]) > 30 and len(want["C"]) == 3 and files.read_strided(spark, str(tmp_path / "D.bed.gz"), 40).count() == 0


def test_features_are_read_off_the_last_part_of_a_path(spark, tmp_path):
    """The pattern isn't sought in the whole path, row by row: that took time with the square of its parts' lengths."""
    folder = tmp_path / ("long" * 50) / "a.bed.gz"
    folder.mkdir(parents=True)
    for name in ("x.bed", "y", "z.bed.txt"):
        (folder / name).write_text("chr1\t1\t2\tn\t5\n")
    got = files.read_bed(spark, str(folder))
    assert {r["feature"] for r in got.collect()} == {"x", "y", "z.bed.txt"}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract(substring_index(_metadata" in plan
