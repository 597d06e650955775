"""Which windows of W units (words or bytes) start at two places or more, exactly, at any size of corpus.

Every window is dealt out by the minimizer of its core (the window itself, or for the graph of debruijn its left node): of
the k-unit grams in it, the leftmost with the least hash. Equal cores have equal minimizers, so that they meet; consecutive
cores of a document with the same minimizer place form a segment, so that a text isn't sent window by window. The cores
within one segment all differ (else the minimizer would not be the leftmost), so that a minimizer of only one segment in
the corpus can't hold a repeated window.

1. Census (narrow, then a hash aggregate of 8-byte keys): minimizers with two segments or more; those with over HOT are hot.
2. Marking: a bit map of each kind, its size following their number up to a fixed bound, is broadcast. The first only saves
   work (a false hit is dropped in step 3). Cores whose minimizer is hot take their second choice, the least gram that isn't
   hot if they have one, so that of a very common passage only what lies wholly within it stays together. A false hit of the
   second map makes a minimizer hot for the whole corpus, which changes nothing but the way. Each block of documents keeps
   one copy of each distinct segment marked: the copies of a common passage leave a block as one row.
3. Resolution: segments meet by minimizer, equal contents fold, different ones go to the matcher, which compares contents.
   Hashes only decide where rows meet, never whether they are equal.
4. Spans go back to their blocks, and each document's are merged there. Texts move once, those with marked segments only,
   a compressed row per block.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, batch, bits_of, by_arrow, columns, discard, materialise, mix, pieces_of, release_memory, word_hashes

CHUNK_BITS = 20  # units in one piece of work; longer documents are cut with overlap
BLOCK_BYTES = 16 << 20
HOT = 4000  # segments of one minimizer that one task compares; a fixed number, whatever the corpus' size
_U = np.uint64


def rolling(units: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash mod 2^64 of every k consecutive units, by doubling."""
    out, done, power, length, step = None, 0, units, 1, base
    while True:
        if k & length:
            if out is None:
                out, done = power, length
            else:  # out covers `done` units from the left, power the next `length`
                n = len(units) - done - length + 1
                out = out[:n] * _U(pow(base, length, 1 << 64)) + power[done : done + n]
                done += length
        if done == k:
            return out
        n = len(power) - length
        power = power[:n] * _U(step) + power[length : length + n]
        step, length = step * step % (1 << 64), length * 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    length = 1
    while length * 2 <= w:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: len(x) - (w - length)], x[w - length :]) if w > length else x


class Bytes:
    """Units are the bytes of the text."""

    RUN = 1 << 20
    _TABLE = mix(np.arange(1, 257, dtype=_U))

    def hashed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all units of the texts, none null, and the places where each text's begin, and their end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return self._TABLE[data], offsets - offsets[0]

    def units(self, text: bytes):
        return text

    def text(self, units: bytes) -> bytes:
        return units

    def kept(self, units: bytes, keep: np.ndarray) -> bytes:
        return np.frombuffer(units, np.uint8)[keep].tobytes()


class Words:
    """Units are words between ASCII white space."""

    RUN = 2 << 20

    def hashed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(texts)

    def units(self, text: bytes):
        return text.split()

    def text(self, units: list[bytes]) -> bytes:
        return b" ".join(units)

    def kept(self, units: list[bytes], keep: np.ndarray) -> bytes:
        return b" ".join([units[i] for i in np.flatnonzero(keep).tolist()])


def _leftmost_least(keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the least of each n consecutive keys, by their high bits; of equal ones the leftmost."""
    low = _U((1 << CHUNK_BITS) - 1)
    return (sliding_min((keys & ~low) | np.arange(len(keys), dtype=_U), n) & low).astype(np.int64)


def segments(hashes: np.ndarray, ends: np.ndarray, core: int, k: int, hot: np.ndarray | None = None):
    """Of documents laid end to end: (minimizer, first core, end of cores, whether it is a second choice) of each segment."""
    n, none = len(hashes), (*(np.empty(0, np.int64),) * 3, np.empty(0, bool))
    if n < core:
        return none
    gram = mix(rolling(hashes, k, 0x9E3779B97F4A7C15))
    at = _leftmost_least(gram, core - k + 1)
    steps = np.zeros(len(at) + 1, np.int32)  # cores that lie in one document
    starts = np.concatenate([[0], ends[:-1]])
    whole = ends - starts >= core
    np.add.at(steps, starts[whole], 1)
    np.add.at(steps, ends[whole] - core + 1, -1)
    valid = np.flatnonzero(np.cumsum(steps[:-1]))
    if not len(valid):
        return none
    at = at[valid]
    second = np.zeros(len(valid), bool)
    if hot is not None:
        is_hot = Marks.has(hot, mix(gram ^ _FIRST))
        second = is_hot[at]
        if second.any():
            other = _leftmost_least(gram >> _U(1) | is_hot.astype(_U) << _U(63), core - k + 1)[valid]
            at = np.where(second, other, at)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(valid) != 1) | (np.diff(at) != 0) | (second[1:] != second[:-1])]))
    first, last = valid[new], valid[np.concatenate([new[1:] - 1, [len(valid) - 1]])]
    name = mix(gram[at[new]] ^ np.where(second[new], _SECOND, _FIRST))
    return name.view(np.int64), first, last + 1, second[new]


_FIRST, _SECOND = _U(0x5851F42D4C957F2D), _U(0x2545F4914F6CDD1D)


def pieces(by, texts: pa.Array, core: int, sizes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of several documents' units, or of a part of a very long one: (hashes, ends, documents' numbers, offsets in them). sizes: gets the numbers of units."""
    top = 1 << CHUNK_BITS
    for at, to in pieces_of(texts, by.RUN):
        hashes, starts = by.hashed(texts.slice(at, to - at))
        if sizes is not None:
            sizes[at:to] = np.diff(starts)
        if len(hashes) <= top:
            yield hashes, starts[1:], np.arange(at, to), np.zeros(to - at, np.int64)
            continue
        for d, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            for b in range(a, z - core + 1, top - core + 1):
                part = hashes[b : min(z, b + top)]
                yield part, np.array([len(part)]), np.array([at + d]), np.array([b - a])


def _census(make: Callable, core: int, k: int):
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64())])

    def run(batches):
        by = make()
        for b in batches:
            found = [segments(h, ends, core, k)[0] for h, ends, _, _ in pieces(by, b.column(0).fill_null(""), core)]
            if found:
                yield batch(schema, *np.unique(np.concatenate(found), return_counts=True))

    return run


_MARKED = "kind int, block bigint, doc_id bigint, n_units bigint, sha string, data binary, seg int, v bigint, n bigint"
_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_units", pa.int64()), ("sha", pa.string()), ("data", pa.binary()), ("seg", pa.int32()), ("v", pa.int64()), ("n", pa.int64())])
CLEAN, BLOCK, SEGMENT = 0, 1, 2


def _rows(kind: int, block: int, size: int, /, **cols) -> pa.RecordBatch:
    given = {"kind": np.full(size, kind, np.int32), "block": np.full(size, block, np.int64)} | cols
    return batch(_SCHEMA, *[given[f.name] if f.name in given else pa.nulls(size, f.type) for f in _SCHEMA])


def _mark(make: Callable, core: int, pad: int, k: int, shared, keep_text: bool):
    def run(batches):
        by, part, (bits, hot) = make(), TaskContext.get().partitionId(), shared.value
        seq = 0
        for b in (x for x in batches if x.num_rows):
            for at, to in pieces_of(b.column(1), BLOCK_BYTES):
                yield from _block(by, part << 32 | seq, b.column(0).slice(at, to - at).to_pylist(), b.column(1).slice(at, to - at), core, pad, k, bits, hot, keep_text)
                seq += 1

    return run


def piece_of(units, a: int, z: int, pad: int) -> bytes:
    """Units a to z. With pad: words, one more on each side where there is one, after a digit that says where (1: left, 2: right)."""
    if not pad:
        return units[a:z]
    left, right = a > 0, z < len(units)
    return b"%d" % (left + 2 * right) + b" ".join(units[a - left : z + right])


def _block(by, block, ids, texts, core, pad, k, bits, hot, keep_text):
    known: dict[tuple[int, bytes], int] = {}
    counts, occ, units = array("q"), {}, {}
    n_units = np.zeros(len(ids), np.int64)
    raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts]
    for hashes, ends, numbers, offsets in pieces(by, texts.fill_null(""), core, n_units):
        v, first, end, second = segments(hashes, ends, core, k, hot)
        use = np.flatnonzero(second | Marks.has(bits, v)) if len(v) else v
        if not len(use):
            continue
        v, first, end = v[use], first[use], end[use]
        own = np.searchsorted(ends, first, "right")
        first, end = (x - (ends - np.diff(ends, prepend=0))[own] + offsets[own] for x in (first, end))
        for value, a, z, number in zip(v.tolist(), first.tolist(), end.tolist(), numbers[own].tolist(), strict=True):
            if number not in units:
                units[number] = by.units(raw[number])
            seg = known.setdefault((value, piece_of(units[number], a, z + core - 1, pad)), len(known))
            if seg == len(counts):
                counts.append(0)
            counts[seg] += 1
            occ.setdefault(number, array("I")).extend((seg, a))
    clean = [i for i in range(len(ids)) if i not in occ]
    if clean:
        sha = [hashlib.sha256(by.text(by.units(raw[i]))).hexdigest() for i in clean]
        yield _rows(CLEAN, block, len(clean), doc_id=[ids[i] for i in clean], n_units=n_units[clean], sha=sha, data=[raw[i] if keep_text else None for i in clean])
    if occ:
        data = pickle.dumps([(ids[i], raw[i], x.tobytes()) for i, x in occ.items()], 4)
        yield _rows(BLOCK, block, 1, data=[zstandard.ZstdCompressor(level=1).compress(data)])
        yield _rows(SEGMENT, block, len(known), seg=np.arange(len(known), dtype=np.int32), v=[v for v, _ in known], n=np.array(counts), data=[c for _, c in known])


class Entry:
    """A distinct content of a minimizer: how often it occurs, and in which segments of which blocks."""

    __slots__ = ("blocks", "content", "n", "segs")

    def __init__(self, content: bytes):
        self.content, self.n, self.blocks, self.segs = content, 0, array("q"), array("i")


def resolve(matcher: Callable, schema: pa.Schema):
    """Rows (v, block, seg, n, content) come sorted by minimizer; matcher(groups of Entry, each of one minimizer) gives rows."""

    def run(batches):
        groups: list[dict[bytes, Entry]] = []
        last, waiting = None, 0

        def results():
            out = list(matcher([list(g.values()) for g in groups if len(g) > 1 or any(e.n > 1 for e in g.values())]))
            for a in range(0, len(out), 10_000):
                yield batch(schema, *map(list, zip(*out[a : a + 10_000], strict=True)))

        for b in batches:
            for v, block, seg, n, content in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if v != last:
                    if waiting > 1 << 20:
                        yield from results()
                        groups, waiting = [], 0
                    groups.append({})
                    last = v
                entry = groups[-1].get(content)
                if entry is None:
                    entry = groups[-1][content] = Entry(content)
                    waiting += len(content)
                entry.n += n
                entry.blocks.append(block)
                entry.segs.append(seg)
        yield from results()

    return run


SPANS = "block bigint, spans binary"


def by_block(rows: np.ndarray) -> list[tuple[int, bytes]]:
    """rows: (block, segment, first window, end of windows, ...) of integers. One packed row per block."""
    if not len(rows):
        return []
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    cut = np.flatnonzero(np.diff(rows[:, 0])) + 1
    zip_ = zstandard.ZstdCompressor(level=1)
    return [(int(x[0, 0]), zip_.compress(np.ascontiguousarray(x[:, 1:].T).tobytes())) for x in np.split(rows, cut)]


def _finish(make: Callable, window: int, width: int, keep_text: bool):
    """width: integers to a span: segment, first, end and, of compacted paths, path and place in it, by which neighbours are verified."""
    schema = pa.schema(FINAL)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        release_memory()
        by, unzip, out = make(), zstandard.ZstdDecompressor(), []
        packed = [np.frombuffer(unzip.decompress(x), np.int64).reshape(width, -1).T for x in found["spans"].to_pylist()]
        spans = np.concatenate(packed) if packed else np.empty((0, width), np.int64)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        for data in docs["data"].to_pylist():
            for doc_id, text, occ in pickle.loads(unzip.decompress(data)):
                units, occ = by.units(text), np.frombuffer(occ, np.uint32).reshape(-1, 2).astype(np.int64)
                lo, hi = (np.searchsorted(spans[:, 0], occ[:, 0], side) for side in ("left", "right"))
                which = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
                own, at = spans[which], np.repeat(occ[:, 1], hi - lo)
                if width > 3:
                    _verify(own, at)
                steps = np.zeros(len(units) + 1, np.int64)
                np.add.at(steps, own[:, 1] + at, 1)
                np.add.at(steps, own[:, 2] + at + (window - 1), -1)
                gone = np.cumsum(steps)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                kept = by.kept(units, ~gone) if len(edges) else by.text(units)
                out.append((doc_id, len(units), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.reshape(-1, 2).astype("<u4").tobytes(), kept if keep_text else None))
        return pa.Table.from_batches([batch(schema, *map(list, zip(*out, strict=True)))] if out else [], schema)

    return run


def _verify(spans: np.ndarray, at: np.ndarray) -> None:
    """A document's spans that follow each other on one path must do so in the path too."""
    begin, end, path, place = spans[:, 1] + at, spans[:, 2] + at, spans[:, 3], spans[:, 4]
    order = np.argsort(begin, kind="stable")
    begin, end, path, place = begin[order], end[order], path[order], place[order]
    next_ = (path[1:] == path[:-1]) & (begin[1:] == end[:-1]) & (place[1:] > 0)
    if (place[1:] - place[:-1] != begin[1:] - begin[:-1])[next_].any():
        raise RuntimeError("a path's places don't follow its source")


FINAL = [("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary()), ("kept", pa.binary())]
_FINAL = "doc_id bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans binary, kept binary"


def mark_repeats(docs: DataFrame, make: Callable, core: int, pad: int, k: int, keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Documents without a segment that may repeat, blocks of the others, and those segments; written."""
    docs = columns(docs, doc_id=F.col("doc_id").cast("bigint"), text=F.col("text").cast("string"))
    seen = by_arrow(docs.select("text"), _census(make, core, k), "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    repeated = materialise(seen.filter("n > 1"), "repeated_minimizers")
    maps = bits_of(repeated, "v"), bits_of(repeated.filter(F.col("n") > hot), "v")
    discard(repeated)
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    return materialise(by_arrow(docs, _mark(make, core, pad, k, shared, keep_text), _MARKED), "marked_segments")


def meet(marked: DataFrame, matcher: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """The matcher's rows of all minimizers."""
    dealt = marked.filter(F.col("kind") == SEGMENT).select("v", "block", "seg", "n", "data")
    return by_arrow(dealt.repartition("v").sortWithinPartitions("v"), resolve(matcher, schema), ddl)


def cut_repeats(marked: DataFrame, found: DataFrame, make: Callable, window: int, width: int, keep_text: bool = False) -> DataFrame:
    """found: SPANS. A row per document: doc_id, n_units, n_removed, n_spans, kept_sha256, spans (packed uint32 pairs), kept (with keep_text)."""
    blocks = marked.filter(F.col("kind") == BLOCK).select("block", "data")
    open_ = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_finish(make, window, width, keep_text), _FINAL)
    none = F.lit(0).cast("bigint")
    clean = marked.filter(F.col("kind") == CLEAN).select("doc_id", "n_units", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(b"").alias("spans"), F.col("data").alias("kept"))
    return clean.unionByName(open_)
