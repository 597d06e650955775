"""Approximate nearest neighbours by additive quantisation, with exact reranking.

Codebooks have full dimension: the m-th is fitted by k-means to what the first m - 1 leave of a bounded sample. A vector
is encoded by beam search over all of them, and stored with its codes, the norm of their sum, and itself. Vectors with one
nearest first codeword form a list; a query is sent to the `probe` lists whose codewords are nearest to it (all 256
by default, for which lists hold the near neighbours depends on the rows; fewer do where there are clusters). Lists and their queries
meet by a shuffle; lists of many vectors are dealt out in parts of about ROWS, many queries of a list in blocks of about
QUERIES, so that what a task holds is bounded and nothing passes through the driver. There the tables of inner products of
the queries with all codewords give an approximate distance by one look-up for each code, plus the stored norm; the nearest
`shortlist` are reranked exactly, and so is every other row whose distance, less the error of its code, is within the
k-th of these (rows of very unlike sizes share few codewords, which then say little); only `k` rows per query and part leave the task.

Of more than k + 1 equal vectors only the k + 1 with the smallest ids can be in a result; the others leave before the
index is built, so that a very common vector can't fill the short lists. Nothing else is dropped: every vector is indexed.

Edge cases: null or zero vectors, those with null or non-finite components, of another length than the commonest, or
without id take no part; a row repeated as a whole counts once; equal distances go by id; with fewer than k candidates
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, materialise

SAMPLE = 8192
ROWS, QUERIES = 10_000, 2048


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind = "array<double>" if dict(df.dtypes)[vector_col] == "array<double>" else "array<float>"  # doubles keep their digits
    v = columns(df, vec_id=F.col(id_col).cast("bigint"), embedding=F.col(vector_col).cast(kind)).filter("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.filter(fine).distinct()
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.filter(F.size("embedding") == (sizes[0] if sizes else 0))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy().astype(dtype).reshape(len(column), -1)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def fit_codebooks(sample: np.ndarray, books: int, size: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """(books, size, dimension), each fitted to the residuals that the ones before leave."""
    rng, left = np.random.default_rng(seed), sample.astype(np.float32)
    size, out = min(size, len(left)), []
    for _ in range(books):
        book = left[rng.choice(len(left), size, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmin(_squares(book) - 2 * left @ book.T, 1)
            counts = np.bincount(near, minlength=size)
            sums = np.zeros_like(book)
            np.add.at(sums, near, left)
            book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        near = np.argmin(_squares(book) - 2 * left @ book.T, 1)
        left = left - book[near]
        out.append(book)
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and the squared norms of the sums of codewords, by beam search over the residuals."""
    n, d = vectors.shape
    left, codes = vectors[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
    for book in books:
        width = left.shape[1]
        score = _squares(left.reshape(-1, d)).reshape(n, width, 1) + _squares(book) - 2 * (left.reshape(-1, d) @ book.T).reshape(n, width, -1)
        score = score.reshape(n, -1)
        keep = min(beam, score.shape[1])
        best = np.argpartition(score, keep - 1, 1)[:, :keep] if keep < score.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, code = np.divmod(best, len(book))
        rows = np.arange(n)[:, None]
        left = left[rows, parent] - book[code]
        codes = np.concatenate([codes[rows, parent], code[:, :, None].astype(np.uint8)], 2)
    best = np.argmin(_squares(left.reshape(-1, d)).reshape(n, -1), 1)
    codes = codes[np.arange(n), best]
    total = sum(book[codes[:, m]] for m, book in enumerate(books))
    return codes, _squares(total)


def _encode(shared, centre: np.ndarray, beam: int, kind: str):
    schema = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("codes", pa.binary()), ("norm", pa.float32()), ("embedding", pa.list_(_element(kind)))])

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            x = (_matrix(b.column(1), np.float64) - centre).astype(np.float32)
            got = [encode(x[a : a + 512], shared.value, beam) for a in range(0, len(x), 512)]
            codes = np.concatenate([c for c, _ in got])
            near = np.argmin(_squares(shared.value[0]) - 2 * x @ shared.value[0].T, 1)
            yield batch(schema, near.astype(np.int32), b.column(0), [c.tobytes() for c in codes], np.concatenate([n for _, n in got]), b.column(1).cast(pa.list_(_element(kind))))

    return run


def _element(kind: str) -> pa.DataType:
    return pa.float64() if kind == "array<double>" else pa.float32()


def build_index(vectors: DataFrame, books: int = 16, size: int = 256, beam: int = 8) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """vectors: of valid_vectors. (index, codebooks, centre); None without vectors. What is coded is a vector's difference from the
    sample's mean, taken in double: of vectors far from 0 single precision would leave next to nothing of what tells them apart."""
    ids = vectors.select("vec_id", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(SAMPLE).select("vec_id")
    sample = vectors.join(ids, "vec_id", "left_semi").orderBy("vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return None
    known = _matrix(sample["embedding"].combine_chunks(), np.float64)
    centre = known.mean(0)
    codebooks = fit_codebooks((known - centre).astype(np.float32), books, size)
    shared, kind = vectors.sparkSession.sparkContext.broadcast(codebooks), dict(vectors.dtypes)["embedding"]
    coded = by_arrow(vectors.select("vec_id", "embedding"), _encode(shared, centre, beam, kind), f"list int, vec_id bigint, codes binary, norm float, embedding {kind}")
    return materialise(coded, "additive_index"), codebooks, centre


def _probes(shared, centre: np.ndarray, probe: int, kind: str):
    """A row for each query and each of the lists nearest to it."""
    schema = pa.schema([("list", pa.int32()), ("query_id", pa.int64()), ("query", pa.list_(_element(kind)))])

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            first = shared.value[0]
            far = _squares(first) - 2 * (_matrix(b.column(1), np.float64) - centre).astype(np.float32) @ first.T
            near = np.argsort(far, 1, kind="stable")[:, :probe]
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield batch(schema, near.ravel().astype(np.int32), b.column(0).take(rows), b.column(1).take(rows).cast(pa.list_(_element(kind))))

    return run


def _far(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = x - q
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def _search(shared, centre: np.ndarray, k: int, shortlist: int):
    """Of some vectors of a list and some of its queries: each query's k nearest."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        books, out = shared.value, []
        vectors = vectors.sort_by("vec_id")
        ids, x = vectors["vec_id"].to_numpy(), _matrix(vectors["embedding"].combine_chunks(), np.float64)
        codes = np.frombuffer(b"".join(vectors["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        norms = vectors["norm"].to_numpy()
        # how far each vector is from the sum of its codewords: by how much its approximate distance can mislead
        apart = x - centre
        for m, book in enumerate(books):
            apart -= book[codes[:, m]]
        error = np.sqrt(np.einsum("ij,ij->i", apart, apart))
        asked, exact = queries["query_id"].to_numpy(), _matrix(queries["query"].combine_chunks(), np.float64)
        for a in range(0, len(asked), 64):
            own = asked[a : a + 64]
            size = ((exact[a : a + 64] - centre) ** 2).sum(1)
            tables = np.einsum("qd,mcd->mcq", (exact[a : a + 64] - centre).astype(np.float32), books)
            score = np.repeat(norms[:, None], len(own), 1)
            for m in range(codes.shape[1]):
                score -= 2 * tables[m][codes[:, m]]
            for q, s in enumerate(score.T):
                if len(s) > shortlist + 1:
                    edge = np.partition(s, shortlist)[shortlist]
                    some = np.flatnonzero(s < edge)
                    some = np.sort(np.concatenate([some, np.flatnonzero(s == edge)[: shortlist + 1 - len(some)]]))
                else:
                    some = np.arange(len(s))
                some = some[ids[some] != own[q]]
                far = _far(x[some], exact[a + q])
                if len(some) < len(s) - 1 and len(some) >= k:  # rows whose code doesn't rule them out are measured too
                    squares = size[q] + s.astype(np.float64)
                    slack = 1e-5 * (size[q] + norms.astype(np.float64) + np.abs(squares))  # of single precision
                    least = np.sqrt(np.maximum(0, squares - slack)) - error
                    open_ = least <= np.partition(far, k - 1)[k - 1]
                    open_[some] = False
                    more = np.flatnonzero(open_)
                    more = more[ids[more] != own[q]]
                    some, far = np.concatenate([some, more]), np.concatenate([far, _far(x[more], exact[a + q])])
                near = np.lexsort((ids[some], far))[:k]
                out.append((np.full(len(near), own[q]), ids[some][near], far[near]))
        return pa.Table.from_batches([batch(schema, *map(np.concatenate, zip(*out, strict=True)))])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, shortlist: int = 300, probe: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", **index) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest found, by Euclidean distance; a vector with the query's id isn't its neighbour."""
    spark, schema = vectors.sparkSession, "query_id bigint, vec_id bigint, score double"
    every = materialise(valid_vectors(vectors, id_col, vector_col), "vectors")
    asked = columns(queries, vec_id=F.col(id_col).cast("bigint")).distinct()
    asked = every.join(asked, "vec_id", "left_semi").select("vec_id", "embedding")
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    built = build_index(every.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"), **index)
    if not built:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    table, books, centre = built
    shared, kind = spark.sparkContext.broadcast(books), dict(every.dtypes)["embedding"]
    probes = materialise(by_arrow(asked, _probes(shared, centre, probe, kind), f"list int, query_id bigint, query {kind}"), "probes")
    # a row for each list, 256 at most
    parts = table.groupBy("list").agg(F.ceil(F.count("*") / ROWS).alias("parts")).join(probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "list")
    parts = F.broadcast(materialise(parts, "lists"))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    held = table.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("block", every_one("blocks"))
    sent = probes.join(parts, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("part", every_one("parts"))
    key = ["list", "part", "block"]
    held, sent = held.select(*key, "vec_id", "codes", "norm", "embedding"), sent.select(*key, "query_id", "query")
    found = held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_search(shared, centre, k, shortlist), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
