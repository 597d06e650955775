"""Integer vectors in packed blocks, tiles of queries and shards, and top lists that merge in a tree.

Vectors become integers floor(factor * x) and are packed in blocks of bounded size, dealt out by a hash of their id, one
row a block. A tile is one block of queries with a run of shards; tiles meet by an equi-join of packed rows, so that a
task holds a block and a run whatever the tables' size, and no pair of rows is ever a row of a table. What a tile
returns is a packed top list for each of its queries; lists of up to FAN runs merge at a time, level by level.

Arithmetic is exact: a product is made in the narrowest of float32, float64 and int64 whose whole numbers reach it.

Defined cases: a row without id, or whose vector is null or holds null or non-finite components, takes no part; of rows with
one id the least vector stands for it; vectors meet those of their own length only; a table whose products could
pass 64 bits is refused with an error; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, materialise, release_memory

#: Rows of a shard and of a block of queries; both fewer where vectors are long, for a block holds at most CELLS numbers.
ROWS, QUERIES, CELLS = 4096, 8192, 1 << 22
#: Shards of one tile, and lists that one task merges, at most.
RUN, FAN = 16, 16
#: Stands in place of a score in a list that isn't full; no product reaches it.
NONE = np.iinfo(np.int64).min

_PACKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])
PACKED = "dim int, block bigint, n int, kind string, ids binary, labels binary, x binary"
_LISTS = pa.schema([("dim", pa.int32()), ("q", pa.int64()), ("g", pa.int64()), ("head", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
LISTS = "dim int, q bigint, g bigint, head binary, ids binary, scores binary"


def whole_vectors(df: DataFrame, factor: int, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(vec_id, label, x): x holds floor(factor * component) of the rows that take part. With a label, rows without one go."""
    v = columns(df, vec_id=F.col(id_col).cast("bigint"), label=F.lit(0).cast("bigint") if label is None else label.cast("bigint"), v=F.col(vector_col).cast("array<double>"))
    v = v.filter("vec_id is not null and label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * float(factor))).alias("x"))
    return v.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("m")).select("vec_id", "m.label", "m.x")


def sizes_of(vectors: DataFrame, times: int = 1) -> dict[int, tuple[int, int]]:
    """(rows, largest product) by length of the vectors. times: what products are multiplied with later."""
    top = F.greatest(F.coalesce(F.array_max("x"), F.lit(0)), -F.greatest(F.coalesce(F.array_min("x"), F.lit(0)), F.lit(-(2**62))))
    found = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(top).alias("top")).collect()  # a row for each length
    out = {r.d: (r.n, r.d * r.top * r.top) for r in found}
    if any(most * times >= 2**63 for _, most in out.values()):
        raise ValueError("inner products of these vectors could pass 64 bits")
    return out


def blocks_of(sizes: dict[int, tuple[int, int]], rows: int) -> dict[int, int]:
    """Number of blocks by length."""
    return {d: max(1, math.ceil(n / min(rows, max(256, CELLS // max(1, d))))) for d, (n, _) in sizes.items()}


def by_length(counts: dict[int, int], dim: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, n)]), dim)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as they need."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    n, d = table.num_rows, table["dim"][0].as_py()
    x = narrow(table["x"].combine_chunks().flatten().to_numpy().reshape(n, d))
    ids, labels = (table[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label"))
    return pa.Table.from_batches([batch(_PACKED, [d], [table["block"][0].as_py()], [n], [x.dtype.name], [ids], [labels], [x.tobytes()])])


def pack(vectors: DataFrame, blocks: dict[int, int], label: str) -> DataFrame:
    """A row for each block of vectors, ids ascending; written."""
    dealt = vectors.withColumn("dim", F.size("x")).withColumn("block", F.pmod(F.xxhash64("vec_id"), by_length(blocks, F.col("dim"))))
    return materialise(dealt.groupBy("dim", "block").applyInArrow(_pack, PACKED), label)


class Block:
    """A packed row as arrays."""

    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(row["n"], row["dim"])
        self.row = row


def as_exact(bound: int) -> type:
    """The type in which sums of whole numbers up to the bound are exact, and quickest."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def tiled(shards: DataFrame, queries: DataFrame, n_shards: dict[int, int], n_queries: dict[int, int], run: Callable, bound: int) -> tuple[DataFrame, int]:
    """Lists of every tile, and the number of runs. shards, queries: packed rows, more columns allowed; run(shard rows, query row)
    gives (head, ids, scores) of the query block's lists."""
    tasks = 4 * shards.sparkSession.sparkContext.defaultParallelism
    tiles = sum(n_shards[d] * n_queries.get(d, 0) for d in n_shards)
    size = max(1, min(RUN, tiles // tasks))
    runs = {d: math.ceil(n / size) for d, n in n_shards.items()}
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    dealt = shards.filter(F.col("dim").isin(list(n_queries))).withColumn("__n", by_length(n_queries, F.col("dim")).cast("bigint")).withColumn("q", every("__n")).withColumn("g", F.floor(F.col("block") / size)).drop("__n")
    asked = queries.withColumn("__n", by_length(runs, F.col("dim")).cast("bigint")).withColumn("g", every("__n")).drop("__n").withColumnRenamed("block", "q")

    def work(held: pa.Table, own: pa.Table) -> pa.Table:
        if not held.num_rows or not own.num_rows:
            return _LISTS.empty_table()
        row = own.to_pylist()[0]
        head, ids, scores = run(held.to_pylist(), row)
        out = pa.Table.from_batches([batch(_LISTS, [row["dim"]], [row["q"]], [row["g"]], [head.tobytes()], [ids.astype(np.int64).tobytes()], [scores.astype(np.int64).tobytes()])])
        release_memory()
        return out

    key = ["dim", "q", "g"]
    return dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(work, LISTS), max(runs.values())


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of candidates the k with the highest scores, equal ones by id; NONE is the lowest."""
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def merged(lists: DataFrame, runs: int, k: int) -> DataFrame:
    """One list for each query block: FAN runs' lists become one, level by level."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, scores = (np.concatenate([np.frombuffer(r[c], np.int64).reshape(-1, k) for r in rows], 1) for c in ("ids", "scores"))
        ids, scores = best(ids, scores, k)
        return pa.Table.from_batches([batch(_LISTS, [rows[0]["dim"]], [rows[0]["q"]], [rows[0]["g"]], [rows[0]["head"]], [ids.tobytes()], [scores.tobytes()])])

    while runs > 1:
        lists = lists.withColumn("g", F.floor(F.col("g") / FAN)).groupBy("dim", "q", "g").applyInArrow(merge, LISTS)
        runs = math.ceil(runs / FAN)
    return lists


def unpacked(lists: DataFrame, read: Callable[[dict], Sequence[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """Rows of int64 columns; read(row of lists) gives their arrays."""
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                yield batch(schema, *read(row))

    return by_arrow(lists, run, ", ".join(f"{c} bigint" for c in names))


def from_lists(row: dict, k: int) -> tuple[np.ndarray, ...]:
    """(place of the list, rank from 1, id, score) of what the lists hold."""
    ids, scores = (np.frombuffer(row[c], np.int64).reshape(-1, k) for c in ("ids", "scores"))
    at, place = np.nonzero(scores != NONE)
    return at, place + 1, ids[at, place], scores[at, place]
