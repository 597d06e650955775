"""Sums over pairs of rows as masked matrix products of blocks.

A join of rows on their common columns makes a record for every pair and column before it sums. Here the cells are packed in
blocks of at most ROWS by COLUMNS (values, and a mask of what is missing), each pair of blocks of the same columns meets once, and six
matrix products give n and the sums of x, y, x^2, y^2 and xy over the columns that both rows of a pair have. What is shuffled is
the blocks, once for each block of rows on the other side, and one record for each pair and block of columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from .stats import clean

ROWS, COLUMNS = 256, 1024
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _blocks(df: DataFrame, row: str, column: str, value: str, n_rows: int, n_columns: int, shift: bool):
    """(rb, cb, row array, column array, x binary): dense blocks, NaN where there is no value. shift: each row less its least value, so that
    sums of squares don't cancel and rows of one value are all 0."""
    cells = df.select(F.col(row).alias("row"), F.col(column).cast("string").alias("col"), clean(value).alias("x")).filter("row is not null and col is not null and x is not null")
    cells = cells.groupBy("row", "col").agg(F.avg("x").alias("x"))
    if shift:
        cells = cells.withColumn("x", F.col("x") - F.min("x").over(Window.partitionBy("row")))
    cells = cells.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(n_rows)).cast("int")).withColumn("cb", F.pmod(F.xxhash64("col"), F.lit(n_columns)).cast("int"))
    kind = dict(cells.dtypes)["row"]
    schema = df.sparkSession.createDataFrame([], f"rb int, cb int, rows array<{kind}>, cols array<string>, x binary").schema
    arrow = to_arrow_schema(schema)

    def pack(table: pa.Table) -> pa.Table:
        rows, cols = (table[c].combine_chunks().dictionary_encode() for c in ("row", "col"))
        x = np.full((len(rows.dictionary), len(cols.dictionary)), np.nan)
        x[rows.indices.to_numpy(), cols.indices.to_numpy()] = table["x"].to_numpy()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), d) for d in (rows.dictionary, cols.dictionary)]
        own = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("rb", "cb")]
        return pa.Table.from_arrays([a.cast(f.type) for a, f in zip([*own, *lists, pa.array([x.tobytes()], pa.binary())], arrow)], schema=arrow)

    return written(cells.groupBy("rb", "cb").applyInArrow(pack, schema), "blocks"), kind


def _sizes(*tables: tuple[DataFrame, str, str]) -> list[tuple[int, int]]:
    return [tuple(df.agg(F.approx_count_distinct(row), F.approx_count_distinct(column)).first()) for df, row, column in tables]


def _unpacked(row: dict):
    x = np.frombuffer(row["x"]).reshape(len(row["rows"]), len(row["cols"]))
    return x, np.array(row["cols"], object).astype(str)


def pair_sums(df: DataFrame, row: str, column: str, value: str, other: DataFrame | None = None, rows: int = ROWS, columns: int = COLUMNS, shift: bool = True) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) over the columns that both have, values less their row's least (with shift): of every two rows a < b, or with
    another table of every row of df and every row of it. Pairs without a common column aren't there. A cell given
    more than once counts with its mean; null and NaN cells are missing; rows and columns without name take no part."""
    sizes = _sizes((df, row, column), *([(other, row, column)] if other is not None else []))
    n_columns = max(1, math.ceil(max(c for _, c in sizes) / columns))
    n_left, n_right = (max(1, math.ceil(n / rows)) for n in (sizes[0][0], sizes[-1][0]))
    left, kind = _blocks(df, row, column, value, n_left, n_columns, shift)
    right = left if other is None else _blocks(other, row, column, value, n_right, n_columns, shift)[0]
    every = lambda low, high: F.explode(F.sequence(low, high))
    square, zero = other is None, F.lit(0)
    left = left.withColumnRenamed("rb", "i").withColumn("j", every(F.col("i") if square else zero, F.lit(n_right - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).withColumnRenamed("rb", "j").withColumn("i", every(zero, F.col("j") if square else F.lit(n_left - 1)))
    schema = df.sparkSession.createDataFrame([], f"a {kind}, b {kind}, {', '.join(f'{c} double' for c in SUMS)}").schema
    arrow = to_arrow_schema(schema)

    def products(own: pa.Table, met: pa.Table) -> pa.Table:
        if not own.num_rows or not met.num_rows:
            return arrow.empty_table()
        l, r = (t.to_pylist()[0] for t in (own, met))
        same = square and l["i"] == r["j"]
        (x, xc), (y, yc) = _unpacked(l), _unpacked(r)
        _, at, to = np.intersect1d(xc, yc, assume_unique=True, return_indices=True)
        x, y = x[:, at], y[:, to]
        mx, my = (~np.isnan(z) for z in (x, y))
        x, y, mx, my = np.where(mx, x, 0), np.where(my, y, 0), mx.astype(float), my.astype(float)
        sums = [mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T]
        i, j = np.nonzero(np.triu(sums[0], 1) if same else sums[0])
        names = [pa.array(t["rows"], f.type).take(pa.array(k)) for t, f, k in ((l, arrow.field("a"), i), (r, arrow.field("b"), j))]
        return pa.Table.from_arrays([*names, *(pa.array(s[i, j]) for s in sums)], schema=arrow)

    key = ["cb", "i", "j"]
    got = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(products, schema)
    if square:  # blocks are by hash: turn pairs that came the wrong way
        turned = F.col("a") > F.col("b")
        swap = {"a": "b", "b": "a", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
        got = got.select(*[F.when(turned, F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in got.columns])
    return got.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS])


def pairwise_pearson(df: DataFrame, row: str, column: str, value: str, least: int = 3, other: DataFrame | None = None, **blocks) -> DataFrame:
    """(a, b, r, n) of the pairs of pair_sums with at least `least` common columns; r is null at zero variance, which is one below 1e-12
    of the sum of squares."""
    s = pair_sums(df, row, column, value, other, **blocks).filter(F.col("n") >= least)
    about = lambda xx, x, y: F.col(xx) - F.col(x) * F.col(y) / F.col("n")
    s = s.withColumns({"xx": about("sxx", "sx", "sx"), "yy": about("syy", "sy", "sy"), "xy": about("sxy", "sx", "sy")})
    flat = (F.col("xx") <= 1e-12 * F.col("sxx")) | (F.col("yy") <= 1e-12 * F.col("syy"))
    return s.select("a", "b", F.when(~flat, F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))).alias("r"), F.col("n").cast("bigint").alias("n"))


def distances(df: DataFrame, row: str, column: str, value: str, **blocks) -> DataFrame:
    """(a, b, d): Euclidean distances of every two rows a < b over the columns that both have."""
    s = pair_sums(df, row, column, value, shift=False, **blocks)
    return s.select("a", "b", F.sqrt(F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0))).alias("d"))
