"""Readers and writers with declared schemas. Reject policy: rows that can't be parsed are dropped only where said so."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parts, written

PEAK = "chrom string, start int, end int, name string, score int"
PEAK7 = "chrom string, start int, end int, tf string, score int, srx string, cell_group string"
GTF = "seqid string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string"


@dataclass(frozen=True)
class BuildSpec:
    """The axes of a build, which are part of its path."""

    tier: str
    axis: str = "all"
    min_score: int = 250
    rank: int = 10
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.tier or not self.axis or "/" in self.tier + self.axis:
            raise ValueError("tier and axis are plain names")
        if not 0 <= self.min_score <= 1000 or self.rank < 1:
            raise ValueError("min_score from 0 to 1000, rank from 1")

    @property
    def path(self) -> str:
        return f"{self.tier}.{self.axis}.s{self.min_score}"

    @classmethod
    def from_env(cls, prefix: str = "PEAKLOOM_", defaults: dict | None = None, env_file: str | None = None) -> BuildSpec:
        """Environment over a file of NAME=value lines over defaults; a missing tier fails loudly."""
        got, told = dict(defaults or {}), {}
        if env_file and os.path.exists(env_file):
            with open(env_file) as lines:
                for line in lines:
                    name, found, value = line.strip().removeprefix("export ").partition("=")
                    if found and not name.startswith("#"):
                        told[name.strip()] = value.strip().strip("'\"")
        for k, kind in (("tier", str), ("axis", str), ("min_score", int), ("rank", int)):
            if (v := os.environ.get(prefix + k.upper(), told.get(prefix + k.upper()))) is not None:
                got[k] = kind(v)
        if "tier" not in got:
            raise KeyError(f"{prefix}TIER isn't set")
        return cls(**got)

    def stamp(self, **facts) -> str:
        return json.dumps(asdict(self) | facts, sort_keys=True)

    def check(self, stamp: str) -> None:
        """Fails if the stamp is of another build."""
        told = json.loads(stamp)
        for k in ("tier", "axis", "min_score"):
            if told.get(k) != getattr(self, k):
                raise ValueError(f"the build has {k}={told.get(k)}, wanted {getattr(self, k)}")


def read_bed(spark: SparkSession, paths: str | Sequence[str], schema: str = PEAK) -> DataFrame:
    """Tab-separated blocks, gzip or not; comment and track lines are left out. feature: the file's name without suffix."""
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t", schema=schema, comment="#", mode="PERMISSIVE")
    # the last part of the path first: sought in all of it, for each row, the pattern would cost its parts' lengths squared
    name = F.regexp_extract(F.substring_index("_metadata.file_path", "/", -1), r"^([^/]+?)(\.bed)?(\.gz)?$", 1)
    return df.withColumn("feature", name).filter("chrom not like 'track%' and chrom not like 'browser%'")


def discover(spark: SparkSession, pattern: str, renames: DataFrame | None = None, least: int = 1, schema: str = PEAK) -> DataFrame:
    """All files of a pattern, features under their current names ((old, current) rows); fewer than least features fail."""
    df = read_bed(spark, pattern, schema)
    if renames is not None:
        df = df.join(renames.toDF("feature", "__current").distinct(), "feature", "left").withColumn("feature", F.coalesce("__current", "feature")).drop("__current")
    if df.select("feature").distinct().limit(least).count() < least:
        raise ValueError(f"fewer than {least} features in {pattern}")
    return df


def rename_map(spark: SparkSession, path: str) -> DataFrame:
    """(antigen, current_symbol) rows of class renamed_gene, from a TSV with # comments and a header."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    return df.filter("class = 'renamed_gene'").select("antigen", "current_symbol")


def strip7(spark: SparkSession, path: str) -> DataFrame:
    """Raw assembled lines to seven columns: experiment and cell group come out of the name field; lines with fewer than five fields go."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).filter(~F.col("value").startswith("track") & (F.size(f) >= 5))
    name = f[3]
    group = F.regexp_replace(F.regexp_extract(name, r"Cell%20group=([^;]*)", 1), "%20", " ")
    antigen = F.regexp_extract(name, r"Name=([^%;(]+)", 1)
    return raw.select(f[0].alias("chrom"), F.expr("try_cast(split(value, '\t')[1] AS int)").alias("start"), F.expr("try_cast(split(value, '\t')[2] AS int)").alias("end"), antigen.alias("tf"), F.expr("try_cast(split(value, '\t')[4] AS int)").alias("score"), F.regexp_extract(name, r"([SED]RX[0-9]+)", 1).alias("srx"), group.alias("cell_group"))


def score_tier(lines: DataFrame, least: int, column: str = "score") -> DataFrame:
    """Rows whose score, read as a whole number, reaches least; others, malformed ones too, go."""
    return lines.filter(F.expr(f"try_cast(`{column}` AS int) >= {int(least)}"))


def attribute(name: str, column: str = "attributes") -> Column:
    got = F.regexp_extract(column, rf'\b{name} "([^"]*)"', 1)
    return F.when(got != "", got)


def read_gtf(spark: SparkSession, path: str, feature: str = "transcript", tag: str | None = "Ensembl_canonical") -> DataFrame:
    """Anchors: one row per (tagged) feature with its ids and the strand-aware start."""
    df = spark.read.csv(path, sep="\t", schema=GTF, comment="#", quote="").filter(F.col("feature") == feature)
    if tag:
        df = df.filter(F.col("attributes").rlike(rf'\btag "{tag}"'))
    at = F.when(F.col("strand") == "+", F.col("start") - 1).otherwise(F.col("end") - 1)
    ids = [attribute(k).alias(k) for k in ("gene_id", "gene_name", "transcript_id", "gene_biotype")]
    return df.select(F.col("seqid").alias("chrom"), at.alias("anchor"), "strand", *ids)


def gene_symbols(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (f[2] == "gene")).select(attribute("gene_name", "value").alias("gene_name")).dropna().distinct()


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, nullValue="NA")


def read_matrix(spark: SparkSession, path: str, row: str, column: str = "column", value: str = "value", keep: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """A wide matrix as (row, column, value): headers are cut at ' (', of equal ones the first counts, NaN and text are null.

    Read as text columns and unpivoted in one narrow pass; the number of columns only shapes the plan."""
    wide = spark.read.csv(path, sep=sep, header=False)
    names = [str(v).split(" (")[0] for v in wide.first()]
    places = {}
    for i, n in enumerate(names):
        if i and n not in places and (keep is None or n in keep):
            places[n] = i
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(f"_c{i}").alias("v")) for n, i in places.items()]))
    long = wide.filter(F.col("_c0") != F.lit(names[0])).select(F.col("_c0").alias(row), cells.alias("x"))
    v = F.expr("try_cast(x.v AS double)")
    return long.select(row, F.col("x.c").alias(column), F.when(~F.isnan(v), v).alias(value))


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, go_id, gene) of a JSON file {term: {exactSource, geneSymbols}}."""
    text = spark.read.text(path, wholetext=True)
    sets = F.from_json("value", "map<string, struct<exactSource: string, geneSymbols: array<string>>>")
    return text.select(F.explode(sets).alias("term", "s")).select("term", F.col("s.exactSource").alias("go_id"), F.explode(F.array_distinct("s.geneSymbols")).alias("gene"))


def strided(df: DataFrame, order: Sequence[str], by: Sequence[str], stride: int) -> DataFrame:
    """Every stride-th row of each group in order, from the first: a sampling operator. Rows are numbered in ranges of the order, of about
    equal size, and the ranges' sizes summed, so that no task sorts a group."""
    from pyspark.sql import Window

    from ..operators.relational import null_safe_join

    n = parts(df)
    held = written(df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = held.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    ranked = held.repartition(n, *by, "__part").withColumn("__r", own)
    ranked = null_safe_join(ranked, sizes.withColumn("__before", before).drop("__n"), [*by, "__part"])
    return ranked.filter((F.col("__before") + F.col("__r") - 1) % stride == 0).select(*df.columns)


def read_strided(spark: SparkSession, paths: str | Sequence[str], target: int, schema: str = PEAK, stride: int | None = None, ratio: float = 4.0, row_bytes: int = 50) -> DataFrame:
    """About target rows of each tab-separated file, evenly spread, from its first line on: a sampling scan without a shuffle. feature: the file's name.

    A file's stride comes from its size (gzip files taken as `ratio` times as large, a row as row_bytes), or is given. Lines are
    counted as they are read, comments and track lines too, which then go; a file that Spark reads in several blocks (gzip files are one) is
    counted anew in each, so that the sample depends on spark.sql.files.maxPartitionBytes alone. Lines that aren't picked are never parsed."""
    import numpy as np
    import pandas as pd

    def pick(frames):
        block, seen = None, 0
        for f in frames:
            at = list(zip(f["path"].to_numpy(), f["start"].to_numpy(), strict=True))
            edges = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if at[low] != block:
                    block, seen = at[low], 0
                step = stride or max(1, int(f["size"].iloc[low] * (ratio if block[0].endswith(".gz") else 1.0) / row_bytes) // target)
                own = np.arange(low + (-seen) % step, high, step)
                seen += high - low
                yield pd.DataFrame({"value": f["value"].to_numpy()[own], "path": block[0]})

    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"))
    rows = lines.mapInPandas(pick, "value string, path string").filter("value not like '#%' and value not like 'track%' and value not like 'browser%' and value <> ''")
    return rows.select(F.from_csv("value", schema, {"sep": "\t"}).alias("r"), F.regexp_extract("path", r"([^/]+?)(\.bed)?(\.gz)?$", 1).alias("feature")).select("r.*", "feature")


def write_table(df: DataFrame, path: str, by: str | None = None, sort: Sequence[str] = ()) -> int:
    """Zstd parquet, replaced whole; one folder per key with by; rows sorted within files for skipping. Gives the rows written and read back."""
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_tsv(df: DataFrame, path: str, gzip: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, sep="\t", header=True)


def resume(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path if it is complete (it has its success mark), else built, written and read back."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        write_table(build(), path)
    return spark.read.parquet(path)


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_files(df: DataFrame, path: str, by: str, suffix: str) -> None:
    """One gzipped tab-separated file for each value of a column, named by it: path/value + suffix. Files are named on the driver, for
    features are some thousands; the rows of one go through one task, as one file must."""
    spark, folder = df.sparkSession, f"{path}-parts"
    df.withColumn("__key", F.col(by)).repartition(by).write.partitionBy("__key").option("compression", "gzip").csv(folder, sep="\t")
    root, store = _store(spark, folder)
    store.mkdirs(_store(spark, path)[0])
    for d in store.listStatus(root):
        if d.isDirectory():
            value = d.getPath().getName().partition("=")[2]
            for f in store.listStatus(d.getPath()):
                if f.getPath().getName().startswith("part-"):
                    store.rename(f.getPath(), _store(spark, f"{path}/{value}{suffix}")[0])
    store.delete(root, True)


def read_samples(spark: SparkSession, path: str, samples: str, known: DataFrame, sample: str = "SAMPID", tissue: str = "SMTSD") -> DataFrame:
    """(transcript_id, tissue, tpm, sample) of a wide TSV of transcripts (versioned) by samples: of the known transcripts, and of samples
    that the table at `samples` gives a tissue. The table of samples shapes the plan and is small; cells are never joined to it."""
    of = {r[0]: r[1] for r in spark.read.csv(samples, sep="\t", header=True).filter(F.col(tissue).isNotNull()).select(sample, tissue).collect()}
    wide = spark.read.csv(path, sep="\t", header=True)
    cells = F.explode(F.array(*[F.struct(F.lit(of[c]).alias("tissue"), F.expr(f"try_cast(`{c}` AS double)").alias("tpm"), F.lit(c).alias("sample")) for c in wide.columns if c in of]))
    rows = wide.withColumn("transcript_id", F.substring_index("transcript_id", ".", 1)).join(known.select("transcript_id").distinct(), "transcript_id", "left_semi")
    return rows.select("transcript_id", cells.alias("x")).select("transcript_id", "x.tissue", "x.tpm", "x.sample")


def sparse_blocks(cells: DataFrame, rows: int) -> DataFrame:
    """(first_row, content): cells (row, col, value) as compressed sparse row blocks of so many rows, each an npz with data, indices,
    indptr, shape and row numbers."""
    import io

    import numpy as np
    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"])
        names, at = np.unique(frame["row"].to_numpy(), return_index=True)
        held = io.BytesIO()
        np.savez_compressed(held, data=frame["value"].to_numpy(), indices=frame["col"].to_numpy(), indptr=np.append(at, len(frame)), shape=np.array([len(names), frame["col"].max() + 1]), rows=names)
        return pd.DataFrame({"first_row": [int(names[0])], "content": [held.getvalue()]})

    return cells.groupBy(F.floor(F.col("row") / rows).alias("__b")).applyInPandas(lambda _, f: pack(f[["row", "col", "value"]]), "first_row bigint, content binary")


def sparse_cells(files: DataFrame, column: str = "content") -> DataFrame:
    """(row, col, value) of compressed sparse row matrices in npz format, as a binaryFile scan or sparse_blocks gives them; without row
    numbers in a file its rows are numbered from 0."""

    def load(frames):
        import io

        import numpy as np
        import pandas as pd

        for f in frames:
            for content in f[column]:
                z = np.load(io.BytesIO(content))
                names = z["rows"] if "rows" in z.files else np.arange(len(z["indptr"]) - 1)
                yield pd.DataFrame({"row": np.repeat(names, np.diff(z["indptr"])), "col": z["indices"], "value": z["data"].astype(float)})

    return files.select(column).mapInPandas(load, "row bigint, col bigint, value double")


def create_table(df: DataFrame, name: str, path: str, casts: dict[str, str]) -> None:
    """A catalogue table over parquet at path, of the columns named, with their types; replaces one of that name."""
    df.select(*[F.col(c).cast(t).alias(c) for c, t in casts.items()]).write.mode("overwrite").option("path", path).option("compression", "zstd").saveAsTable(name)


def insert_rows(df: DataFrame, name: str) -> None:
    """Appends df's columns of the table's names, as its types."""
    fields = df.sparkSession.table(name).schema.fields
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.insertInto(name)


def create_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS {sql}")
    return spark.table(name)


def write_atomic(df: DataFrame, path: str) -> None:
    """Replaces the table at path whole: written beside it, moved there when it is complete."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.new")
    at, store = _store(spark, path)
    store.delete(at, True)
    if not store.rename(_store(spark, f"{path}.new")[0], at):
        raise OSError(f"{path} wasn't moved to its place")


def _sums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files at path; content is read where the files are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_archive(df: DataFrame, path: str) -> None:
    """Compressed tab-separated files, and beside them a manifest of their sizes, checksums and rows."""
    write_tsv(df, f"{path}/data")
    spark = df.sparkSession
    rows = read_tsv(spark, f"{path}/data", df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).groupBy(F.substring_index(F.input_file_name(), "/", -1).alias("file")).agg(F.count("*").alias("n_rows"))
    _sums(spark, f"{path}/data").join(rows, "file", "left").fillna(0, ["n_rows"]).write.mode("overwrite").json(f"{path}/manifest")
    written, told = df.count(), spark.read.json(f"{path}/manifest").agg(F.sum("n_rows")).first()[0] or 0
    if written != told:
        raise OSError(f"{written} rows were given to the archive, {told} are in it")


def check_archive(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, whole): rows by the manifest, and whether every file is there with its size and checksum."""
    told = spark.read.schema("file string, bytes bigint, sha256 string, n_rows bigint").json(f"{path}/manifest")
    same = told.join(_sums(spark, f"{path}/data").withColumn("found", F.lit(True)), ["file", "bytes", "sha256"], "full")
    return same.agg(F.sum("n_rows").alias("n_rows"), F.every(F.coalesce("found", F.lit(False)) & F.col("n_rows").isNotNull()).alias("whole"))
