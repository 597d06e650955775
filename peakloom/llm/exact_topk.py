"""Exact top-k search by integer inner product: tiled matrix products of queries and shards, partial selection per tile, tree merging.

See tiles.py for blocks, tiles, exact arithmetic and the defined cases (null, odd, repeated and empty ones). Inside a tile
the products of some hundred queries with a shard are one matrix product; of each row of it the k best are selected
without sorting, and join the best of the tile's earlier shards. A query's own row is no candidate; equal scores go by the
smaller id; with fewer than k candidates all are returned.

Work is queries times rows, in matrix products; what is shuffled is the packed vectors once for each block of QUERIES queries,
and k scores for each query and tile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import NONE, QUERIES, ROWS, Block, as_exact, best, blocks_of, from_lists, merged, pack, sizes_of, tiled, unpacked, whole_vectors

#: Queries of one matrix product.
STEP = 256


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, in ascending order; of equal ones at the edge the first. Needs k columns at least."""
    n = scores.shape[1]
    if n == k:
        return np.tile(np.arange(n), (len(scores), 1))
    edge = np.partition(scores, n - k, 1)[:, n - k, None]
    take, tie = scores > edge, scores == edge
    need = k - take.sum(1)
    many = np.flatnonzero(tie.sum(1) > need)
    tie[many] &= np.cumsum(tie[many], 1, dtype=np.int32) <= need[many, None]
    return np.nonzero(take | tie)[1].reshape(-1, k)


def products(queries: np.ndarray, x: np.ndarray, kind: type) -> np.ndarray:
    return queries.astype(kind) @ x.astype(kind).T


def _search(k: int, bound: int):
    kind = as_exact(bound)
    least = NONE if kind is np.int64 else -np.inf

    def run(held: list[dict], row: dict):
        own = Block(row)
        ids, scores = np.full((len(own.ids), k), -1, np.int64), np.full((len(own.ids), k), NONE)
        for shard in map(Block, held):
            x, few = shard.x.astype(kind), min(k, len(shard.ids))
            place = np.searchsorted(shard.ids, own.ids).clip(max=len(shard.ids) - 1)
            same = np.flatnonzero(shard.ids[place] == own.ids)
            for a in range(0, len(own.ids), STEP):
                some = products(own.x[a : a + STEP], x, kind)
                mine = same[(same >= a) & (same < a + STEP)]
                some[mine - a, place[mine]] = least
                at = select(some, few)
                got = np.take_along_axis(some, at, 1)
                got = got if kind is np.int64 else np.where(np.isinf(got), 0, got).astype(np.int64) + np.where(np.isinf(got), NONE, 0)
                ids[a : a + STEP], scores[a : a + STEP] = best(np.concatenate([ids[a : a + STEP], shard.ids[at]], 1), np.concatenate([scores[a : a + STEP], got], 1), k)
        return own.ids, ids, scores

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every query the k rows with the highest inner product of floor(factor * x).

    queries: rows with ids that are in vectors; their vectors come from there."""
    from .common import columns, materialise

    every = materialise(whole_vectors(vectors, factor, id_col, vector_col), "whole_vectors")
    asked = every.join(columns(queries, vec_id=F.col(id_col).cast("bigint")).distinct(), "vec_id", "left_semi")
    sizes, wanted = sizes_of(every), sizes_of(asked)
    schema = "query_id bigint, rank bigint, vec_id bigint, score bigint"
    if not wanted:
        return vectors.sparkSession.createDataFrame([], schema).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    n_shards, n_queries = blocks_of(sizes, ROWS), blocks_of(wanted, QUERIES)
    bound = max(most for _, most in sizes.values())
    lists, runs = tiled(pack(every, n_shards, "shards"), pack(asked, n_queries, "queries"), n_shards, n_queries, _search(k, bound), bound)

    def read(row):
        at, rank, ids, scores = from_lists(row, k)
        return np.frombuffer(row["head"], np.int64)[at], rank, ids, scores

    return unpacked(merged(lists, runs, k), read, ["query_id", "rank", "vec_id", "score"]).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
