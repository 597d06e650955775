"""N-gram Jaccard join: exact components of texts whose sets of word shingles are similar, by rare-first prefix filtering.

1. Classes: texts with the same shingle set fold into one (hash aggregate with map-side combine).
2. Which classes can link at all. A set of n shingles that links shares at least ceil(t n) of them with one other set.
   Under any fixed order, here that of hashes, the first n - ceil(t n) + l of the two sets then have at least l in
   common; with l = n/8 most texts, those that only share a passage too, drop out after one exchange of 5-byte keys.
   (Errors of the short keys only keep a class too many.)
3. Of the classes left, every shingle's frequency by an exchange of packed arrays; shingles of one class go, they
   can't be common. The others are ordered rare first (frequency class, then hash): the set's prefix is its first
   n - ceil(t n) + 1 shingles, those that nobody shares included, so that most prefixes are short.
4. Prefix rows meet on their shingle and the class of their length (lengths of a link differ by a third at most, so only
   neighbouring length classes can link), each with the least member there, which is linear; connected classes are a
   cluster, outside of which nothing can link. A cluster is compared in blocks of bounded size: by inverted lists of
   the prefixes, the length, positional and suffix filters, and one intersection for each pair that is left and not
   connected yet. The members nearest to what they share come first, so that a group of near copies costs about one
   comparison for each member; links are only emitted where they connect, never a pair for each two members.

Edge cases: null texts, texts without words: no shingle, their own component; fewer words than n: the whole sequence is
one shingle; null ids: a component is null only if all its ids are; repeated ids stay, a row each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import batch, by_arrow, columns, discard, free_name, marks_of, materialise, mix, pieces_of, shuffle_partitions, word_hashes
from .components import components
from .repeats import rolling

GROUP_BITS = 13  # of class numbers, at most, to a group
HELD = 4_000_000  # shingles to a bucket or a group, about: what a task holds at a time, whatever the corpus' size
BLOCK = 1024  # members of a cluster compared in one task
_U = np.uint64


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct 64-bit hashes of word n-grams; of fewer words, of the whole sequence."""
    texts = pc.ascii_lower(texts.fill_null(b"" if pa.types.is_binary(texts.type) else "").cast(pa.string()))
    for at, to in pieces_of(texts):
        words, starts = word_hashes(texts.slice(at, to - at))
        grams = mix(rolling(words, n, 0x9E3779B97F4A7C15) + _U(n)) if len(words) >= n else None
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if z - a >= n:
                yield np.unique(grams[a : z - n + 1])
            else:
                yield mix(rolling(words[a:z], z - a, 0x9E3779B97F4A7C15) + _U(z - a)) if z > a else np.empty(0, _U)


def _class(shingles: np.ndarray) -> bytes | None:
    """128 bits: of any number of sets that can be stored, no two different ones are expected to meet."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _classes(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.binary()), ("n", pa.int64()), ("text", pa.binary())])

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            cid, size = [], []
            for h in shingle_sets(b.column(1), n):
                size.append(len(h))
                cid.append(_class(h))
            yield batch(schema, b.column(0), cid, size, b.column(1))

    return run


def least_common(n, t100: int):
    """Of n shingles, how many a set that links has in common with the other at least: ceil(t n)."""
    return -(-n * t100 // 100)


def extra(n):
    return np.maximum(1, n // 8)


_SENT = "bucket int, gids binary, base bigint, hashes binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("gids", pa.binary()), ("base", pa.int64()), ("hashes", pa.binary())])


def _scatter(n: int, buckets: int, width: int, prefix):
    """Sends hashes of each class to buckets. prefix(n): how many of the sorted hashes go; width: bytes of each that go, the high ones."""
    def run(batches):
        for b in (x for x in batches if x.num_rows):
            gids = b.column(0).to_numpy()
            sets = [h[: prefix(len(h))] for h in shingle_sets(b.column(1), n)]
            h = np.concatenate(sets)
            g = np.repeat(gids, [len(x) for x in sets])
            bucket = (h % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            h, g, ends = h[order], g[order], np.cumsum(np.bincount(bucket, minlength=buckets))
            rows, base = [], int(gids.min())
            for k, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                if z > a:
                    steps = np.diff(g[a:z], prepend=base)
                    packed = np.ascontiguousarray(h[a:z].byteswap().view(np.uint8).reshape(-1, 8)[:, :width])
                    rows.append((k, _zip(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()), base, packed.tobytes()))
            yield batch(_SENT_ARROW, *map(list, zip(*rows, strict=True)))

    return run


def _gather(width: int, with_hashes: bool, bits: int):
    """A bucket's hashes met; those of two classes or more go to their classes' groups, with their frequency if asked."""
    schema = pa.schema([("grp", pa.int64()), ("gids", pa.binary()), ("codes", pa.binary())])
    def met(parts):
        gids, hashes = [], []
        for packed, base, raw in parts:
            steps = np.ascontiguousarray(np.frombuffer(_unzip(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()
            gids.append(base + np.cumsum(steps))
            wide = np.zeros((len(steps), 8), np.uint8)
            wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
            hashes.append(wide.view(">u8").ravel().astype(_U))
        g, h = np.concatenate(gids), np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        g, h = g[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        freq = np.repeat(counts := np.diff(np.concatenate([new, [len(h)]])), counts)
        shared = freq > 1
        g, h, freq = g[shared], h[shared], freq[shared]
        order = np.argsort(g, kind="stable")
        g = g[order]
        code = (np.minimum(np.log2(freq) * 4, 255).astype(_U) << _U(55) | h >> _U(9))[order]
        if not with_hashes:  # a count for each class is enough
            g, code = np.unique(g, return_counts=True)
        cut = np.flatnonzero(np.diff(g >> bits)) + 1
        for own, codes in zip(np.split(g, cut), np.split(code, cut), strict=True):
            if len(own):
                low = (own & ((1 << bits) - 1)).astype("<u2")
                yield int(own[0] >> bits), _zip(low.view(np.uint8).reshape(-1, 2).T.tobytes()), codes.astype("<u8").tobytes() if with_hashes else _zip(codes.astype("<u4").tobytes())

    def run(batches):
        last, parts = None, []
        for b in batches:
            for bucket, gids, base, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last and parts:
                    if out := list(met(parts)):
                        yield batch(schema, *map(list, zip(*out, strict=True)))
                    parts = []
                last = bucket
                parts.append((gids, base, hashes))
        if parts and (out := list(met(parts))):
            yield batch(schema, *map(list, zip(*out, strict=True)))

    return run


def _grouped(with_hashes: bool, bits: int):
    """Of a group of classes: (gid, shared) or (gid, codes in order)."""
    schema = pa.schema([("gid", pa.int64()), ("codes", pa.list_(pa.int64())) if with_hashes else ("shared", pa.int64())])

    def run(batches):
        def close(grp, parts):
            low = np.concatenate([np.ascontiguousarray(np.frombuffer(_unzip(g), np.uint8).reshape(2, -1).T).view("<u2").ravel() for g, _ in parts]).astype(np.int64)
            if with_hashes:
                codes = np.concatenate([np.frombuffer(c, "<u8") for _, c in parts]).view(np.int64)
                order = np.lexsort((codes, low))
                low, codes = low[order], codes[order]
                ids, at = np.unique(low, return_index=True)
                offsets = np.concatenate([at, [len(low)]]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(ids + (grp << bits)), pa.ListArray.from_arrays(offsets, codes)], schema=schema)
            counts = np.concatenate([np.frombuffer(_unzip(c), "<u4") for _, c in parts])
            total = np.bincount(low, counts).astype(np.int64)
            ids = np.flatnonzero(total)
            return batch(schema, ids + (grp << bits), total[ids])

        last, parts = None, []
        for b in batches:
            for grp, gids, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if grp != last and parts:
                    yield close(last, parts)
                    parts = []
                last = grp
                parts.append((gids, codes))
        if parts:
            yield close(last, parts)

    return run


def _exchange(texts: DataFrame, n: int, width: int, prefix, with_hashes: bool, shingles: int, classes: int) -> DataFrame:
    """texts: (gid, text), so many classes of so many shingles. Frequencies of the shingles sent, back at their classes."""
    buckets = max(4 * shuffle_partitions(texts.sparkSession), shingles // HELD)
    bits = min(GROUP_BITS, max(0, (HELD * max(1, classes) // max(1, shingles)).bit_length() - 1))
    sent = by_arrow(texts, _scatter(n, buckets, width, prefix), _SENT).repartition("bucket").sortWithinPartitions("bucket")
    back = by_arrow(sent, _gather(width, with_hashes, bits), "grp bigint, gids binary, codes binary").repartition("grp").sortWithinPartitions("grp")
    return by_arrow(back, _grouped(with_hashes, bits), "gid bigint, " + ("codes array<bigint>" if with_hashes else "shared bigint"))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at starts."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Cluster:
    """Some classes that prefixes connect. links() verifies each pair of different components at most once."""

    RANGES = 8

    def __init__(self, n: np.ndarray, codes: list[np.ndarray], t100: int):
        self.n, self.t100 = n, t100
        self.k = np.array([len(c) for c in codes])
        self.at = np.cumsum(self.k) - self.k
        self.tokens = np.unique(np.concatenate(codes), return_inverse=True)[1]
        self.first = np.maximum(0, n - least_common(n, t100) + 1 - (n - self.k))
        size = int(self.tokens.max(initial=0)) + 1
        # inverted lists of the prefixes: member and place of the token in its set
        where = _places(self.at, self.first)
        by_token = np.argsort(self.tokens[where], kind="stable")
        self.member = np.repeat(np.arange(len(n)), self.first)[by_token]
        self.place = (where - np.repeat(self.at, self.first))[by_token]
        self.list_at = np.searchsorted(self.tokens[where][by_token], np.arange(size + 1))
        # members' counts of tokens in ranges of the order, for the suffix filter
        owner = np.repeat(np.arange(len(n)), self.k)
        self.ranges = np.bincount(owner * self.RANGES + self.tokens * self.RANGES // size, minlength=len(n) * self.RANGES).reshape(len(n), -1)
        self.mark = np.zeros(size, bool)

    def partners(self, x: int, free: np.ndarray) -> np.ndarray:
        """Members, of the free ones, that are similar to x: by prefix lists, then the length, positional and suffix filters, then the intersection."""
        own = self.tokens[self.at[x] : self.at[x] + self.first[x]]
        sizes = self.list_at[own + 1] - self.list_at[own]
        hit = _places(self.list_at[own], sizes)
        mine = np.repeat(np.arange(len(own)), sizes)[free[self.member[hit]]]
        hit = hit[free[self.member[hit]]]
        y, at = np.unique(self.member[hit], return_index=True)  # at the first common token
        least = -(-(self.n[x] + self.n[y]) * self.t100 // (100 + self.t100))
        fits = (self.n[x] * 100 >= self.n[y] * self.t100) & (self.n[y] * 100 >= self.n[x] * self.t100)
        fits &= np.minimum(self.k[x] - mine[at], self.k[y] - self.place[hit[at]]) >= least
        fits &= np.abs(self.ranges[x] - self.ranges[y]).sum(1) <= self.k[x] + self.k[y] - 2 * least
        y, least = y[fits], least[fits]
        if not len(y):
            return y
        self.mark[self.tokens[self.at[x] : self.at[x] + self.k[x]]] = True
        common = np.add.reduceat(self.mark[self.tokens[_places(self.at[y], self.k[y])]].astype(np.int32), np.cumsum(self.k[y]) - self.k[y])
        self.mark[self.tokens[self.at[x] : self.at[x] + self.k[x]]] = False
        return y[common >= least]

    def links(self, side: np.ndarray | None = None, top: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what is connected. Members with the fewest shingles of their own come first: most others link to them.
        side: only pairs of members whose sides differ count; top: components already known."""
        top, out = np.arange(len(self.n)) if top is None else top.copy(), []
        order = np.lexsort((np.arange(len(self.n)), (self.n - self.k) / self.n))
        later = np.ones(len(self.n), bool)
        for x in order.tolist():
            later[x] = False
            free = later & (top != top[x])
            if side is not None:
                free &= side != side[x]
            if not free.any():
                continue
            for y in self.partners(x, free).tolist():
                if top[y] != top[x]:
                    out.append((x, y))
                    top[top == top[y]] = top[x]
        return out

    def every(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """All links, each once. side: only pairs of members whose sides differ count."""
        later, out = np.ones(len(self.n), bool), []
        for x in range(len(self.n)):
            later[x] = False
            out += [(x, y) for y in self.partners(x, later if side is None else later & (side != side[x])).tolist()]
        return out


def _linked(t100: int, whole: bool, every: bool = False):
    """Over rows (three keys, gid, n, side, component, codes) sorted by the keys: (a, b), links within each group that connect, or
    every one of them; whole: instead each member with the least of its component in the group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(parts):
        gid, n, side, component = (np.concatenate([p[i] for p in parts]) for i in range(4))
        cluster = Cluster(n, [c for p in parts for c in p[4]], t100)
        if every:
            return [(gid[x], gid[y]) for x, y in cluster.every(side if side.any() else None)]
        if not whole:
            links = cluster.links(side if side.any() else None, np.unique(component, return_inverse=True)[1])
            return [(gid[x], gid[y]) for x, y in links]
        top = np.arange(len(gid))
        for x, y in cluster.links():
            top[top == top[y]] = top[x]
        least = np.full(len(gid), np.iinfo(np.int64).max)
        np.minimum.at(least, top, gid)
        return list(zip(gid.tolist(), least[top].tolist()))

    def run(batches):
        last, parts, out = None, [], []
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cols = [b.column(i).to_numpy() for i in (3, 4, 5, 6)]
            at, values = b.column(7).offsets.to_numpy(), b.column(7).values.to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.empty(0, np.int64)
            for a, z in zip(new.tolist(), [*new[1:].tolist(), len(keys)]):
                key = tuple(keys[a].tolist())
                if key != last and parts:
                    out += close(parts)
                    parts = []
                last = key
                parts.append((*(c[a:z] for c in cols), [values[x:y] for x, y in zip(at[a:z].tolist(), at[a + 1 : z + 1].tolist())]))
            if len(out) > 5000:
                yield batch(schema, *map(list, zip(*out, strict=True)))
                out = []
        if parts:
            out += close(parts)
        if out:
            yield batch(schema, *map(list, zip(*out, strict=True)))

    return run


def _compare(members: DataFrame, sets: DataFrame, t100: int, whole: bool, every: bool = False) -> DataFrame:
    """members: (i, j, k, gid, side, component), compared within each (i, j, k)."""
    rows = members.join(sets.select("gid", "n", "codes"), "gid").select("i", "j", "k", "gid", "n", "side", "component", "codes")
    rows = rows.repartition("i", "j", "k").sortWithinPartitions("i", "j", "k", "gid")
    return materialise(by_arrow(rows, _linked(t100, whole, every), "a bigint, b bigint"), "links")


def _cluster_components(clusters: DataFrame, sets: DataFrame, t100: int, block: int, hubs: int = 8) -> DataFrame:
    """clusters: (gid, cluster). (gid, component) of all members.

    A cluster of one block is done by one comparison. Of a larger one the blocks are compared within, then their `hubs`
    members nearest to what they share; then what is still outside the cluster's largest component is compared with
    all blocks, so that work grows with the members times those outside, not with the square of a group of near copies."""
    zero = F.lit(0).cast("bigint")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = materialise(clusters.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks"))), "blocks")
    key = [F.col("cluster").alias("i"), F.col("block").alias("j")]
    found = _compare(dealt.select(*key, zero.alias("k"), "gid", zero.alias("side"), F.col("gid").alias("component")), sets, t100, True)
    found = found.select(F.col("a").alias("gid"), F.col("b").alias("component"))
    large = dealt.filter("blocks > 1")
    if large.isEmpty():
        return found
    own = large.join(sets.select("gid", ((F.col("n") - F.size("codes")) / F.col("n")).alias("own")), "gid")
    nth = F.row_number().over(Window.partitionBy("cluster", "block").orderBy("own", "gid"))
    heads = own.withColumn("nth", nth).filter(F.col("nth") <= hubs).select(F.col("cluster").alias("i"), F.floor(F.col("block") * hubs / block).alias("j"), zero.alias("k"), "gid", zero.alias("side"), F.col("gid").alias("component"))
    edges = found.join(large.select("gid"), "gid", "left_semi").select(F.col("gid").alias("a"), F.col("component").alias("b"))
    edges = edges.unionByName(_compare(heads, sets, t100, False))
    now = components(edges).select(F.col("node").alias("gid"), "component")
    now = materialise(large.join(now, "gid", "left").withColumn("component", F.coalesce("component", "gid")), "cluster_components")
    sizes = now.groupBy("cluster", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("size", "component")).alias("m")).select("cluster", F.col("m.component").alias("main"))
    outside = now.join(largest, "cluster").filter("component <> main").drop("main")
    parts = outside.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("parts"))
    if not outside.isEmpty():
        to_all = outside.join(parts, "cluster").withColumn("k", F.pmod(F.xxhash64("gid", F.lit(1)), F.col("parts"))).withColumn("j", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        to_all = to_all.select(F.col("cluster").alias("i"), "j", "k", "gid", F.lit(1).cast("bigint").alias("side"), "component")
        every = now.join(parts, "cluster").withColumn("k", F.explode(F.sequence(zero, F.col("parts") - 1)))
        every = every.select(F.col("cluster").alias("i"), F.col("block").alias("j"), "k", "gid", F.lit(2).cast("bigint").alias("side"), "component")
        edges = edges.unionByName(_compare(to_all.unionByName(every), sets, t100, False))
    last = components(edges).select(F.col("node").alias("gid"), "component")
    last = large.select("gid").join(last, "gid", "left").select("gid", F.coalesce("component", "gid").alias("component"))
    return found.join(large.select("gid"), "gid", "left_anti").unionByName(last)


def _numbered(classes: DataFrame) -> DataFrame:
    """gid from 0 without gaps: each partition's first number, a row per partition, is added to the place in the partition."""
    part = F.shiftright("gid", 33)
    sizes, starts, at = sorted((r[0], r[1]) for r in classes.groupBy(part.alias("p")).count().collect()), [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    starts = classes.sparkSession.createDataFrame(starts, "p bigint, start bigint")
    place = F.col("gid") - F.shiftleft("p", 33)
    return classes.withColumn("p", part).join(F.broadcast(starts), "p").withColumn("gid", place + F.col("start")).drop("p", "start")


def _clusters(docs: DataFrame, n: int, t100: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, cid, n, text) of every document, cid null without words; the classes; their shared shingles; (gid, cluster) of those that can link."""
    docs = columns(docs, doc_id=F.col("doc_id").cast("bigint"), text=F.col("text").cast("binary"))
    made = materialise(by_arrow(docs, _classes(n), "doc_id bigint, cid binary, n bigint, text binary"), "shingled")
    classes = made.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("text").alias("text"))
    classes = _numbered(materialise(classes.withColumn("gid", F.monotonically_increasing_id()), "shingle_classes"))
    texts, sizes = classes.select("gid", "text"), classes.select("gid", "n")
    of_all = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = _exchange(texts, n, 5, lambda size: size - least_common(size, t100) + int(extra(size)), False, *of_all)
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * t100 / 100) / 8))
    open_ = materialise(shared.join(sizes, "gid").filter(F.col("shared") >= need).select("gid"), "open_classes")
    of_open = sizes.join(open_, "gid", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    left = by_arrow(texts, marks_of(open_, "gid").filter_arrow("gid"), "gid bigint, text binary").join(open_, "gid", "left_semi")
    first = F.col("n") - F.ceil(F.col("n") * t100 / 100) + 1 - (F.col("n") - F.size("codes"))
    sets = materialise(_exchange(left, n, 8, lambda size: size, True, *of_open).join(sizes, "gid").withColumn("first", first.cast("int")).filter("first > 0"), "shared_shingles")
    # clusters: classes that common prefix shingles connect, found by an edge from each member to the shingle's least. Of a shingle whose
    # members' lengths differ too much to link all, the least of each length class, and an edge between the leasts of neighbouring
    # length classes with lengths near enough
    prefix = sets.select("gid", "n", F.explode(F.slice("codes", F.lit(1), F.col("first"))).alias("code"))
    met = prefix.groupBy("code").agg(F.min("gid").alias("b"), F.count("*").alias("members"), F.min("n").alias("short"), F.max("n").alias("long"))
    met = materialise(met.filter("members > 1").select("code", "b", (F.col("long") * t100 > F.col("short") * 100).alias("wide")), "prefix_shingles")
    own = prefix.join(met.filter("not wide"), "code").select(F.col("gid").alias("a"), "b")
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / t100)) + 1e-9) if t100 < 100 else F.col("n")
    far = prefix.join(met.filter("wide").select("code"), "code", "left_semi").withColumn("length", length)
    parts = materialise(far.groupBy("code", "length").agg(F.min("gid").alias("b"), F.min("n").alias("short"), F.max("n").alias("long")), "length_classes")
    within = far.join(parts.select("code", "length", "b"), ["code", "length"]).select(F.col("gid").alias("a"), "b")
    next_ = Window.partitionBy("code").orderBy("length")  # a row for each length class
    after = parts.select(F.col("b").alias("a"), "length", "long", *[F.lead(c).over(next_).alias(f"next_{c}") for c in ("b", "length", "short")])
    after = after.filter((F.col("next_length") <= F.col("length") + 2) & (F.col("next_short") * t100 <= F.col("long") * 100)).select("a", F.col("next_b").alias("b"))
    clusters = materialise(components(own.unionByName(within).unionByName(after)), "clusters").withColumnRenamed("node", "gid")
    discard(met, parts)
    return made, classes, sets, clusters.withColumnRenamed("component", "cluster")


def _labels(docs: DataFrame, n: int, t100: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid, n, text) of every document, and (cid, least_id, label) of every class, label by component."""
    made, classes, sets, clusters = _clusters(docs, n, t100)
    known = _cluster_components(clusters, sets, t100, block)
    return made, classes.select("cid", "gid", "least_id").join(known, "gid", "left").select("cid", "least_id", F.coalesce("component", "gid").alias("label"))


def jaccard_components(docs: DataFrame, n: int = 5, t100: int = 75, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: 100 * intersection >= t100 * union links two.

    block: members of a cluster compared in one task at most, about."""
    made, label = _labels(docs, n, t100, block)
    names = label.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_class = label.join(names, "label").select("cid", "component_id")
    # a class of very many copies is one small row: the skew join deals out the documents' side
    out = made.select("doc_id", "cid", "n").join(by_class, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_links(docs: DataFrame, n: int = 5, t100: int = 75, block: int = BLOCK // 4) -> tuple[DataFrame, DataFrame]:
    """All links: (doc_id, n_shingles, class_id, n_links) of every document and (a, b), the pairs of classes that link, each once.

    Documents of one class have the same shingles and link too; n_links counts the other rows that a document links to.
    All pairs of blocks of a cluster are compared, so that work and links grow with the square of a group of near copies."""
    made, classes, sets, clusters = _clusters(docs, n, t100)
    zero = F.lit(0).cast("bigint")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = clusters.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("bigint")
    keys = [F.col("cluster").alias("i"), F.least("own", "other").alias("j"), F.greatest("own", "other").alias("k")]
    links = _compare(met.select(*keys, "gid", side.alias("side"), F.col("gid").alias("component")), sets, t100, False, True)
    name = classes.select("gid", "cid")
    links = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = materialise(links, "all_links")
    rows = made.filter("n > 0").groupBy("cid").agg(F.count("*").alias("rows"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(rows.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("rows").alias("near"))
    count = rows.join(near, "cid", "left").select("cid", (F.col("rows") - 1 + F.coalesce("near", zero)).alias("n_links"))
    members = made.select("doc_id", "cid", "n").join(count, "cid", "left")
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.coalesce("n_links", zero).alias("n_links")), links


def _with_class(n: int, at: int, *names: str):
    """Rows with the class of their text, at column `at`, and a digest of the whole row added, under these names."""

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            cid = [_class(h) for h in shingle_sets(b.column(at), n)]
            row = [hashlib.blake2b(pickle.dumps(r, 4), digest_size=16).digest() for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cid, pa.binary()), pa.array(row, pa.binary())], names=[*b.schema.names, *names])

    return run


def keep_first(docs: DataFrame, n: int = 5, t100: int = 75) -> DataFrame:
    """The documents, all columns (of any type), one row of each component: of its classes the one with the least id (nulls
    last, then by class), of that class's rows with this id the first by text. Rows whose texts have no words all stay.

    Where an id is on one row only, it finds the row; rows with null or repeated ids are found by id and class."""
    made, label = _labels(docs, n, t100, BLOCK)
    by_id, cid, row, nth = (free_name(docs, c) for c in ("first_id", "class_id", "row_digest", "nth_row"))
    first = label.groupBy("label").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "cid")).alias("r"))
    first = materialise(first.select(F.col("r.least_id").alias(by_id), F.col("r.cid").alias("of_class")), "first_of_components")
    repeated = materialise(made.filter("doc_id is not null").groupBy(F.col("doc_id").alias(by_id)).count().filter("count > 1").select(by_id), "repeated_ids")
    own = docs["doc_id"].cast("bigint")
    ids = first.select(by_id).unionByName(made.filter("n = 0").select(F.col("doc_id").alias(by_id))).filter(F.col(by_id).isNotNull())
    found = ids.join(repeated, by_id, "left_anti")
    out = docs.join(found, own == found[by_id], "left_semi")
    unclear = None if repeated.isEmpty() else docs.join(repeated, own == repeated[by_id], "left_semi")
    if not made.filter("doc_id is null").isEmpty():
        nameless = docs.filter(own.isNull())
        unclear = nameless if unclear is None else unclear.unionByName(nameless)
    if unclear is None:
        return out
    fields = [*docs.schema.fields, StructField(cid, BinaryType()), StructField(row, BinaryType())]
    held = materialise(by_arrow(unclear, _with_class(n, docs.columns.index("text"), cid, row), StructType(fields)), "unclear_rows")
    wordless = held.filter(F.col(cid).isNull())
    met = held.join(first, (F.col(cid) == first["of_class"]) & held["doc_id"].cast("bigint").eqNullSafe(first[by_id]), "left_semi")
    order = Window.partitionBy(cid).orderBy("text", row)
    once = met.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return out.unionByName(wordless.drop(cid, row)).unionByName(once.drop(cid, row, nth))
