"""Plumbing shared by the training-data operators: shared storage, Arrow mapping, safe column selection."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Words end at the six ASCII space characters; bytes.split() cuts at exactly these.
SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local
    mode (tests); on a cluster, where executors couldn't see that, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="peakloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new folder of this application in the shared one; all but those to keep go when it ends."""
    own = f"{shared_dir(spark)}/peakloom/{'kept' if keep else spark.sparkContext.applicationId}"
    if not keep:
        at, store = _store(spark, own)
        store.mkdirs(at)
        store.deleteOnExit(at)
    return f"{own}/{uuid.uuid4().hex}/{label}"


#: Row groups of rows of megabytes: Parquet looks at a group's size after 100 rows only, and a reader decodes a group of so few rows at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs one task, not the plan."""
    path = new_path(df.sparkSession, label)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for tables that nothing reads any more; other tables are let be."""
    for t in tables:
        if path := vars(t).get("_written"):
            at, store = _store(t.sparkSession, os.path.dirname(path))
            store.delete(at, True)


def columns(df: DataFrame, **named: str | Column) -> DataFrame:
    """Only the columns named, under our own names, so that extra columns of the input can't clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in named.items()])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or it with marks before it, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release_memory() -> None:
    """Hands free memory back to the system: an idle worker must not keep a task's memory beside the workers of the next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


#: What a worker process keeps from task to task of one stage, such as encoded words. Tasks of other stages drop it.
KEPT: dict[str, object] = {}


def forget() -> None:
    """A function of the module, so that it meets the worker's own KEPT and no pickled copy."""
    KEPT.clear()


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: bool = False) -> DataFrame:
    """mapInArrow; keeps: the tasks use what the worker's KEPT holds."""

    def run(batches):
        if not keeps:
            forget()
        try:
            yield from f(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def pieces_of(texts: pa.Array, size: int = 8 << 20) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about so many bytes each."""
    if not len(texts):
        return []
    weight = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.unique(np.concatenate([[0], np.searchsorted(weight, np.arange(size, weight[-1], size)), [len(texts)]])).tolist()
    return list(zip(cut, cut[1:]))


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, without making str objects."""
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column)


def write_shared(path: str, data: bytes) -> None:
    """One file of our own format into the shared folder; a retried task replaces it whole."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    if path.startswith(("file:", "/")):
        at, tmp = (p.removeprefix("file:").replace("///", "/", 1).replace("//", "/", 1) if p.startswith("file:") else p for p in (path, tmp))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    tmp_at = fs.FileSystem.from_uri(tmp)[1]
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(tmp_at) as f:
        f.write(data)
    store.move(tmp_at, at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


MAX_MARK_BITS = 1 << 30


class Marks:
    """A bit map of hashed keys, broadcast: of bounded size, it only saves work. What it lets through is checked exactly after."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self.shared = spark.sparkContext.broadcast(bits)

    @staticmethod
    def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        low = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
        return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)

    def filter_arrow(self, key: str):
        shared = self.shared

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(Marks.has(shared.value, b.column(key).to_numpy())))

        return run


def bits_of(df: DataFrame, key: str) -> np.ndarray:
    """A bit map of the key's values; df is read twice. The driver gathers at most MAX_MARK_BITS bits, as words of 64."""
    size = min(MAX_MARK_BITS, max(1 << 12, 1 << (10 * df.count()).bit_length()))
    word = F.shiftright(F.col(key).bitwiseAND(F.lit(size - 1)), 6)
    words = df.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({key} & 63L AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def marks_of(df: DataFrame, key: str) -> Marks:
    return Marks(df.sparkSession, bits_of(df, key))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (public domain); its three shifts and two factors are fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: the sum of random numbers for (place, byte), mixed with the length."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    out = np.zeros(n, np.uint64)
    if n and offsets[-1] > offsets[0]:
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        at, lens = offsets - offsets[0], np.diff(offsets)
        place = np.arange(len(data)) - np.repeat(at[:-1], lens)
        numbers = mix((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(0x9E3779B97F4A7C15))
        full = lens > 0
        out[full] = np.add.reduceat(numbers, at[:-1][full])
        out = mix(out + lens.astype(np.uint64))
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (between ASCII white space) of texts, none null, and the places where each text's begin, and their end."""
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    known, codes = hashes_of(coded.dictionary), coded.indices.to_numpy()
    offsets = offsets - offsets[0]
    real = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    if real.all():
        return known[codes], offsets
    real = real[codes]
    return known[codes[real]], np.concatenate([[0], np.cumsum(real)])[offsets]
