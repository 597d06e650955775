"""Hard negatives: product quantisation with stored residual norms, rigorous bounds from look-up tables, exact integer rerank.

Each vector is stored with its codes (one for every two components, codebooks of 256 fitted to a bounded sample of SAMPLE
rows) and the norm r of what the codes leave. For an anchor a and a row x with codes' sum x', the look-up tables give a.x',
and |a.x - a.x'| <= |a| r; r is stored with the rounding of single precision added, so that the bounds hold for
sure. They decide, within a tile (see tiles.py), which rows need the exact integer product; a bad codebook costs work, not results.

First pass, positives: of the rows with the anchor's label those whose upper bound reaches the n-th highest lower bound are
reranked exactly, and the tiles' lists of n merge in a tree. Second pass, negatives: each positive's score p opens a
window of scores, from low/100 p to high/100 p. Rows of other labels that the bounds place surely inside give a first floor, the
exact products of the nearest estimates below the window's end a second; then every row whose bounds reach the window above the floor
is reranked exactly. Both passes end with exact whole numbers only.

Defined cases: those of tiles.py; rows without label take no part; an anchor with fewer positives has those it has, one with none no
rows; a window that no row meets gives none; a negative positive score's window is empty; equal scores go by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, materialise
from .tiles import LISTS, NONE, PACKED, QUERIES, ROWS, Block, _LISTS, _PACKED, best, blocks_of, from_lists, merged, pack, sizes_of, tiled, unpacked, whole_vectors

SAMPLE, SIZE, WIDTH = 8192, 256, 2
#: Anchors that a tile works on at once, and estimates below a window's end that are tried first.
STEP, FIRST = 64, 8


def fit_codebooks(sample: np.ndarray, width: int = WIDTH, size: int = SIZE, rounds: int = 8, seed: int = 5) -> list[np.ndarray]:
    """A codebook for each run of `width` components, by k-means."""
    rng, out = np.random.default_rng(seed), []
    for a in range(0, sample.shape[1], width):
        x = sample[:, a : a + width].astype(np.float64)
        book = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin((book**2).sum(1) - 2 * x @ book.T, 1)
            counts = np.bincount(near, minlength=len(book))
            for j in range(x.shape[1]):
                book[:, j] = np.where(counts > 0, np.bincount(near, x[:, j], len(book)) / np.maximum(counts, 1), book[:, j])
        out.append(book.astype(np.float32))
    return out


def encode(x: np.ndarray, books: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the norms of what they leave, with room for the rounding of sums in single precision."""
    n, d = x.shape
    codes, left = np.zeros((n, len(books) if books else 0), np.uint8), x.astype(np.float64)
    size = np.sqrt((left**2).sum(1))
    at = 0
    for m, book in enumerate(books or []):
        part = slice(at, at + book.shape[1])
        codes[:, m] = np.argmin((book.astype(np.float64) ** 2).sum(1) - 2 * left[:, part] @ book.T.astype(np.float64), 1)
        left[:, part] -= book[codes[:, m]]
        at += book.shape[1]
    rest = np.sqrt((left**2).sum(1))
    return codes, (rest * (1 + 1e-6) + (codes.shape[1] + d + 64) * 2.0**-23 * (size + rest)).astype(np.float32)


class Coded(Block):
    """A packed shard with codes and residual norms."""

    def __init__(self, row: dict, books: dict[int, list[np.ndarray]]):
        super().__init__(row)
        self.books = books.get(row["dim"])
        self.codes, self.rest = np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1), np.frombuffer(row["rest"], np.float32)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, how far the exact products can be from them), for each anchor and row."""
        a, at = anchors.astype(np.float32), 0
        near = np.zeros((len(a), len(self.ids)), np.float32)
        for m, book in enumerate(self.books or []):
            near += np.take(a[:, at : at + book.shape[1]] @ book.T, self.codes[:, m], axis=1)
            at += book.shape[1]
        size = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
        return near, size.astype(np.float32)[:, None] * self.rest

    def exact(self, anchors: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Whole products of the pairs (anchor, row)."""
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 65536):
            out[a : a + 65536] = np.einsum("ij,ij->i", anchors[rows[a : a + 65536]].astype(np.int64), self.x[cols[a : a + 65536]].astype(np.int64))
        return out


def top_lists(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists (n, k) of the highest scores of each row's candidates, equal ones by id."""
    order = np.lexsort((ids, ~scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < k
    out_ids, out = np.full((n, k), -1, np.int64), np.full((n, k), NONE)
    out_ids[rows[kept], place[kept]], out[rows[kept], place[kept]] = ids[kept], scores[kept]
    return out_ids, out


def _nth(x: np.ndarray, n: int) -> np.ndarray:
    """Each row's n-th highest; the lowest there is where there are fewer."""
    return np.partition(x, x.shape[1] - n, 1)[:, x.shape[1] - n] if x.shape[1] >= n else np.full(len(x), -np.inf, x.dtype)


def _positives(shared, k: int):
    def run(held: list[dict], row: dict):
        own = Block(row)
        ids, scores = np.full((len(own.ids), k), -1, np.int64), np.full((len(own.ids), k), NONE)
        for r in held:
            shard = Coded(r, shared.value)
            for a in range(0, len(own.ids), STEP):
                part = slice(a, a + STEP)
                fits = (own.labels[part, None] == shard.labels) & (own.ids[part, None] != shard.ids)
                near, off = shard.bounds(own.x[part])
                floor = _nth(np.where(fits, near - off, -np.inf), k)
                at, cols = np.nonzero(fits & (near + off >= floor[:, None]))
                found = top_lists(at, shard.ids[cols], shard.exact(own.x[part], at, cols), len(fits), k)
                ids[part], scores[part] = best(*(np.concatenate(x, 1) for x in zip((ids[part], scores[part]), found)), k)
        return own.ids, ids, scores

    return run


def _negatives(shared, n_pos: int, k: int, low: int, high: int):
    def run(held: list[dict], row: dict):
        own = Block(row)
        pos_ids, pos = (np.frombuffer(row[c], np.int64).reshape(-1, n_pos) for c in ("pos_ids", "pos_scores"))
        there = pos != NONE
        p = np.where(there, pos, 0)
        bottom, top = -((-low * p) // 100), (high * p) // 100  # whole scores s with low p <= 100 s <= high p
        bottom, top = np.where(there, bottom, 1), np.where(there, top, 0)
        ids, scores = np.full((len(own.ids) * n_pos, k), -1, np.int64), np.full((len(own.ids) * n_pos, k), NONE)
        for r in held:
            shard = Coded(r, shared.value)
            for a in range(0, len(own.ids), STEP):
                part = slice(a, a + STEP)
                x, fits = own.x[part], own.labels[part, None] != shard.labels
                near, off = shard.bounds(x)
                lower, upper = near - off, near + off
                for w in range(n_pos):
                    least, most = bottom[part, w, None].astype(np.float64), top[part, w, None].astype(np.float64)
                    open_ = fits & (lower <= most) & (upper >= least) & (least <= most)
                    if not open_.any():
                        continue
                    sure = np.where(open_ & (lower >= least) & (upper <= most), lower, -np.inf)
                    floor = np.maximum(_nth(sure, k)[:, None], least)
                    tried = np.where(open_ & (near <= most) & (upper >= floor), near, -np.inf)
                    some = min(FIRST, tried.shape[1])
                    cols = np.argpartition(tried, tried.shape[1] - some, 1)[:, tried.shape[1] - some :]
                    at = np.repeat(np.arange(len(cols)), cols.shape[1])
                    exact = shard.exact(x, at, cols.ravel()).reshape(cols.shape)
                    inside = open_[np.arange(len(cols))[:, None], cols] & (exact >= bottom[part, w, None]) & (exact <= top[part, w, None])
                    floor = np.maximum(floor, _nth(np.where(inside, exact, -np.inf), k)[:, None])
                    at, cols = np.nonzero(open_ & (upper >= floor))
                    exact = shard.exact(x, at, cols)
                    kept = (exact >= bottom[part, w][at]) & (exact <= top[part, w][at])
                    found = top_lists(at[kept], shard.ids[cols[kept]], exact[kept], len(x), k)
                    lists = np.arange(a, a + len(x)) * n_pos + w
                    ids[lists], scores[lists] = best(*(np.concatenate(y, 1) for y in zip((ids[lists], scores[lists]), found)), k)
        return np.concatenate([own.ids, pos_ids.ravel(), pos.ravel()]), ids, scores

    return run


def _coded(shared):
    schema = pa.schema([*_PACKED, ("codes", pa.binary()), ("rest", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                codes, rest = encode(block.x, shared.value.get(row["dim"]))
                yield batch(schema, *[[row[f.name]] for f in _PACKED], [codes.tobytes()], [rest.tobytes()])

    return run


def _sampled(every: DataFrame) -> dict[int, list[np.ndarray]]:
    """Codebooks by vector length, of the SAMPLE rows with the smallest hashed ids. A length that the sample misses has none: its
    vectors are bounded by their own norms."""
    rows = every.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE).select("x").toArrow()["x"].to_pylist()
    by_dim: dict[int, list] = {}
    for x in rows:
        by_dim.setdefault(len(x), []).append(x)
    return {d: fit_codebooks(np.array(x, np.float64)) for d, x in by_dim.items() if d}


def hard_negatives(vectors: DataFrame, anchors: DataFrame, label: Column, n_pos: int = 5, n_neg: int = 3, low: int = 50, high: int = 95, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchors: rows with ids that are in vectors; label: whole numbers."""
    spark = vectors.sparkSession
    every = materialise(whole_vectors(vectors, factor, id_col, vector_col, label), "whole_vectors")
    asked = every.join(columns(anchors, vec_id=F.col(id_col).cast("bigint")).distinct(), "vec_id", "left_semi")
    sizes, wanted = sizes_of(every, 100), sizes_of(asked, 100)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not wanted:
        return spark.createDataFrame([], ", ".join(f"{c} bigint" for c in names)).withColumn("rank", F.col("rank").cast("int"))
    bound = max(most for _, most in sizes.values())
    n_shards, n_queries = blocks_of(sizes, ROWS), blocks_of(wanted, QUERIES)
    shared = spark.sparkContext.broadcast(_sampled(every))
    shards = materialise(by_arrow(pack(every, n_shards, "shards"), _coded(shared), f"{PACKED}, codes binary, rest binary"), "coded_shards")
    queries = pack(asked, n_queries, "anchors")
    lists, runs = tiled(shards, queries, n_shards, n_queries, _positives(shared, n_pos), bound)
    positives = merged(lists, runs, n_pos).select("dim", F.col("q").alias("block"), F.col("ids").alias("pos_ids"), F.col("scores").alias("pos_scores"))
    opened = materialise(queries.join(positives, ["dim", "block"]), "windows")
    lists, runs = tiled(shards, opened, n_shards, n_queries, _negatives(shared, n_pos, n_neg, low, high), bound)

    def read(row):
        at, rank, ids, scores = from_lists(row, n_neg)
        head = np.frombuffer(row["head"], np.int64)
        n = len(head) // (1 + 2 * n_pos)
        anchor, pos_ids, pos = head[:n], head[n : n + n * n_pos], head[n + n * n_pos :]
        return anchor[at // n_pos], pos_ids[at], rank, ids, pos[at], scores

    return unpacked(merged(lists, runs, n_neg), read, names).withColumn("rank", F.col("rank").cast("int"))
