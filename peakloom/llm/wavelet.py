"""Token ids as wavelet matrices: one compressed file per shard with access, rank, select, counting and occurrence lookup.

The file: MAGIC, the length of the header, a JSON header, then its parts, each compressed by itself. A part is a block of a
bit plane (BLOCK bytes of it), the directory of a plane (ones before each block), or a block of the documents' table (ids,
null marks, ends). A reader takes the header and the directories, and of the planes only the blocks that a question
touches: one a plane for a token, two for a count, so that a question reads a small part of one file.

Plan: a sample of (doc_id, hash of the text), a few rows of each input partition that stand for equal shares of its bytes, gives
range bounds, so that partitions hold about the same number of bytes and rows of one id, or without id, are split too. Documents are encoded where they lie
(narrow) and only the ids, two bytes each for vocabularies up to 65,536, are shuffled, by range. A task sorts its range
(which may spill) and cuts it into shards by bytes as it goes; it holds one shard. Starts come from the manifest of shards.

Edge cases: a null text is empty and so holds the end id only; null ids come first, rows of one id are ordered by the hash
of their text, then by their token ids; an empty table writes no file and gives no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, batch, by_arrow, columns, materialise, new_path, write_shared

MAGIC = b"WVM2"
BLOCK = 16 << 10  # bytes of a plane to a block
DOCS = 4096  # documents to a block of their table
_CACHE = 600_000
PIECE = 16 << 20  # bytes of text encoded at a time
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class WaveletFile:
    """One file, read in parts. fetch(at, size) gives bytes of it; read counts those fetched.

    Planes run from the highest bit down; each level sorts stably by its bit."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self._fetch, self.read, self._held = fetch, 0, {}
        start = self._bytes(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        size = struct.unpack("<I", start[4:])[0]
        h = json.loads(self._bytes(8, size))
        self.n, self.bits, self.zeros, self.n_docs = h["n"], h["bits"], h["zeros"], h["docs"]
        sizes = np.array(h["parts"], np.int64)
        self._at = 8 + size + np.concatenate([[0], np.cumsum(sizes)])
        self._doc_parts, self._blocks = -(-self.n_docs // DOCS), -(-self.n // (8 * BLOCK))
        self._ones: dict[int, np.ndarray] = {}

    def _bytes(self, at: int, size: int) -> bytes:
        self.read += size
        return self._fetch(at, size)

    def _part(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._bytes(int(self._at[k]), int(self._at[k + 1] - self._at[k])))

    def directory(self, level: int) -> np.ndarray:
        """Ones of the level before each block, and all."""
        if level not in self._ones:
            self._ones[level] = np.frombuffer(self._part(self._doc_parts + level * (self._blocks + 1)), "<u8").astype(np.int64)
        return self._ones[level]

    def block(self, level: int, k: int) -> np.ndarray:
        """A block's bytes; the last few used stay."""
        if (level, k) not in self._held:
            if len(self._held) >= 4 * self.bits:
                self._held.pop(next(iter(self._held)))
            self._held[level, k] = np.frombuffer(self._part(self._doc_parts + level * (self._blocks + 1) + 1 + k), np.uint8)
        return self._held[level, k]

    def documents(self, k: int) -> tuple[list[int | None], np.ndarray]:
        """Ids and ends (places after their last token) of the k-th DOCS documents."""
        data = self._part(k)
        n = min(DOCS, self.n_docs - k * DOCS)
        ids, ends = np.frombuffer(data, "<i8", n).tolist(), np.frombuffer(data, "<u8", n, 8 * n).astype(np.int64)
        gone = np.frombuffer(data, np.uint8, n, 16 * n)
        return [None if g else i for i, g in zip(ids, gone.tolist(), strict=True)], ends

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        k, rest = divmod(i, 8 * BLOCK)
        got = int(self.directory(level)[k])
        if not rest:
            return got
        held, (byte, bit) = self.block(level, k), divmod(rest, 8)
        got += int(_ONES[held[:byte]].sum())
        return got + int(_ONES[held[byte] & ((1 << bit) - 1)]) if bit else got

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            k, rest = divmod(i, 8 * BLOCK)
            bit, ones = int(self.block(level, k)[rest >> 3]) >> (rest & 7) & 1, self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) of the level's bits of that kind."""
        ones = self.directory(level)
        before = ones if bit else np.minimum(np.arange(len(ones)) * 8 * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        held = np.unpackbits(self.block(level, block), bitorder="little")
        return block * BLOCK * 8 + int(np.flatnonzero(held == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each level's sort is undone."""
        now = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            plane = np.concatenate([np.frombuffer(self._part(self._doc_parts + level * (self._blocks + 1) + 1 + k), np.uint8) for k in range(self._blocks)] or [np.empty(0, np.uint8)])
            bit = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(now)
            back[~bit] = now[: self.zeros[level]]
            back[bit] = now[self.zeros[level] :] | (1 << (self.bits - 1 - level))
            now = back
        return now


def pack(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of some documents' ids, laid end to end."""
    zip_, parts = zstandard.ZstdCompressor(level=1), []
    ends = np.cumsum(np.asarray(lens, np.int64)).astype("<u8")
    for a in range(0, len(doc_ids), DOCS):
        own = doc_ids[a : a + DOCS]
        parts.append(np.array([x or 0 for x in own], "<i8").tobytes() + ends[a : a + DOCS].tobytes() + bytes(x is None for x in own))
    bits, zeros, now = max(1, int(ids.max(initial=0)).bit_length()), [], ids
    for level in reversed(range(bits)):
        bit = (now >> level & 1).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        blocks = [plane[k : k + BLOCK] for k in range(0, len(plane), BLOCK)]
        parts.append(np.cumsum([0, *(int(_ONES[x].sum()) for x in blocks)]).astype("<u8").tobytes())
        parts += [x.tobytes() for x in blocks]
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate([low, now[bit]])
    packed = [zip_.compress(x) for x in parts]
    header = json.dumps({"n": len(ids), "bits": bits, "docs": len(doc_ids), "zeros": zeros, "parts": [len(x) for x in packed]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *packed])


def unpack(data: bytes) -> WaveletFile:
    """The file whose bytes are at hand."""
    return WaveletFile(lambda at, size: data[at : at + size])


def open_wavelet(spark: SparkSession, path: str) -> WaveletFile:
    """A file in any store that Spark reads; each part that a question touches is fetched from there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)

    def fetch(start: int, size: int) -> bytes:
        stream.seek(start)
        return bytes(stream.readNBytes(size))

    return WaveletFile(fetch)


#: Letters (a-z, and U+00C0 to U+023F but for the two signs among them and the I with a dot, whose small letter is two characters), then marks that part words.
_LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+)([.,;:!?]*)")


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct white-space-free chunk once while it is remembered.

    Chunks are remembered in two generations, so that frequent ones stay and memory is bounded. Right only for
    tokenizers whose pieces never hold white space (it is dropped); others encode text by text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        told = json.loads(self.tokenizer.to_str())
        self.by_chunk = self._plain(" a  b\n") == self._plain("a b")
        self.lower = "Lowercase" in str(told["normalizer"])
        added = [x["content"].encode() for x in told["added_tokens"]]
        #: With these in a text, capitals must stay: a special string, or a mark (U+0300 to U+037F) that may compose with the small letter only.
        self.guards = [x[:2] for x in added] + [b"\xcc", b"\xcd"]
        #: Words end with a suffix of their last piece, if the vocabulary has one; then words of letters can go through the library many at a time.
        suffix = told["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, k in vocabulary.items():
            self.ends[k] = bool(suffix) and piece.endswith(suffix)
        self.joins = bool(suffix) and self.lower and self.by_chunk and self._plain("ab, c.") == self._plain("ab") + self._plain(",") + self._plain("c") + self._plain(".")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str) -> ChunkEncoder:
        """One for a worker process, which serves many tasks."""
        if path not in KEPT:
            KEPT[path] = ChunkEncoder(path)
        return KEPT[path]

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype == "<u2" else "I"
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> None:
        """Words of letters, joined by spaces: each ends with the only piece in it that has the suffix."""
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        coded = self.tokenizer.encode_batch_fast([b" ".join(own).decode() for own in groups], add_special_tokens=False)
        for own, code in zip(groups, coded, strict=True):
            ids = np.array(code.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own):
                data, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
                self.known.update(zip(own, (data[a:z] for a, z in zip([0, *ends], ends)), strict=True))
            else:
                self.known.update(zip(own, self._ids([x.decode() for x in own]), strict=True))

    def _learn(self, new: list[bytes]) -> None:
        known, rest, parts, words = self.known, [], [], []
        for x in new:
            m = _LETTERS.fullmatch(x) if self.joins else None
            if m is None:
                rest.append(x)
            elif m[2]:
                parts.append((x, m[1], m[2]))
            else:
                words.append(x)
        known.update(zip(rest, self._ids([x.decode() for x in rest]), strict=True))
        self._words([*{*words, *(w for _, w, _ in parts if w not in known)}])
        marks = {m for _, _, m in parts if m not in known}
        known.update(zip(marks, self._ids([m.decode() for m in marks]), strict=True))
        for x, w, m in parts:
            known[x] = known[w] + known[m]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), each text's followed by end, and each text's number of them."""
        texts = texts.fill_null("")
        last = np.array([end], self.dtype)
        if not self.by_chunk:
            got = [np.concatenate([np.frombuffer(x, self.dtype), last]) for x in self._ids(texts.to_pylist())]
            return np.concatenate(got), np.array([len(x) for x in got])
        if self.lower:  # ASCII capitals go first where the tokenizer lowers them anyway and nothing needs them
            free = pa.array([not any(x in t for x in self.guards) for t in (v.as_buffer().to_pybytes() for v in texts)])
            texts = pc.if_else(free, pc.ascii_lower(texts), texts)
        gc.disable()  # many small objects are made, none in cycles
        try:
            return self._by_chunk(texts, last)
        finally:
            gc.enable()

    def _by_chunk(self, texts: pa.Array, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.slice(split.offsets[0].as_py(), split.offsets[-1].as_py() - split.offsets[0].as_py()).dictionary_encode()
        words = strings(coded.dictionary)
        if len(self.known) > _CACHE:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        got = list(map(known.get, words))
        missing = [i for i, x in enumerate(got) if x is None]
        for i in missing:
            x = words[i]
            if (had := older.get(x)) is None:
                new.append(x)
            else:
                known[x] = had
        self._learn(new)
        for i in missing:
            got[i] = known[words[i]]
        lens = np.fromiter(map(len, got), np.int64, len(got)) // last.itemsize
        pool = np.concatenate([np.frombuffer(b"".join(got), self.dtype), last])
        starts = np.concatenate([np.cumsum(lens) - lens, [len(pool) - 1]]).astype(np.int32)  # the last is the end id's own word
        lens = np.concatenate([lens, [1]]).astype(np.int32)
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        indices, out, sizes, a = coded.indices.to_numpy(), [], [], 0
        del texts, split, coded, words, got
        while a < len(offsets) - 1:  # some documents at a time, so that no array holds all words or ids at eight bytes each
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 18), "right")) - 1)
            ends_of = offsets[a + 1 : z + 1] - offsets[a]
            codes = np.insert(indices[offsets[a] : offsets[z]], ends_of, len(lens) - 1)
            own = lens[codes]
            ends = np.cumsum(own)
            out.append(pool[np.repeat(starts[codes] - ends + own, own) + np.arange(ends[-1])])
            sizes.append(np.diff(ends[ends_of + np.arange(z - a)], prepend=0))
            a = z
        return np.concatenate(out), np.concatenate(sizes)


def _encode(path: str, end_id: int, bounds: list[tuple]):
    """(part, doc_id, tie, ids): the number of the range that a row falls into, its place there, and its ids."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        by = ChunkEncoder.of(path)
        for b in (x for x in batches if x.num_rows):
            part = [bisect.bisect_right(bounds, (d is not None, d or 0, t)) for d, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            weight = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy().astype(np.int64))
            cut = np.unique(np.concatenate([[0], np.searchsorted(weight, np.arange(PIECE, weight[-1], PIECE)), [b.num_rows]])).tolist()
            for at, to in zip(cut, cut[1:]):
                ids, lens = by.encode(b.column(1).slice(at, to - at), end_id)
                data, ends = ids.tobytes(), (np.cumsum(lens) * ids.itemsize).tolist()
                yield batch(schema, part[at:to], b.column(0).slice(at, to - at), b.column(2).slice(at, to - at), [data[a:z] for a, z in zip([0, *ends], ends)])

    return run


def strings(words: pa.Array) -> list[bytes]:
    """The bytes of each string of an array without nulls, cut from one buffer."""
    if not len(words):
        return []
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    return [data[a:z] for a, z in zip(offsets, offsets[1:])]


def _write(folder: str, dtype: str, shard_ids: int):
    """Writes a partition's rows, in order, as shards of about so many ids."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("file_bytes", pa.int64())])
    width = np.dtype(dtype).itemsize

    def run(batches):
        part, shard, size, docs, ids = None, 0, 0, [], []

        def close():
            lens = np.array([len(x) // width for x in ids])
            data, name = pack(docs, lens, np.frombuffer(b"".join(ids), dtype)), f"part-{part:07d}-shard-{shard:05d}.wvm"
            write_shared(f"{folder}/{name}", data)
            return batch(schema, [part], [shard], [name], [len(docs)], [int(lens.sum())], [len(data)])

        for b in batches:
            for p, d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if docs and (p != part or size >= shard_ids * width):
                    yield close()
                    shard, size, docs, ids = shard + 1 if p == part else 0, 0, [], []
                part = p
                docs.append(d)
                ids.append(x.as_py())
                size += len(ids[-1])
        if docs:
            yield close()

    return run


def _sampled(points: int):
    """Of a partition's rows (doc_id, tie, size) those in which its bytes are a whole number of points-ths, each standing for as many."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("weight", pa.float64())])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            ends = np.cumsum(rows["size"].to_numpy())
            at = pa.array(np.searchsorted(ends, ends[-1] * (np.arange(points) + 0.5) / points))
            yield batch(schema, *(rows[c].take(at).combine_chunks() for c in ("doc_id", "tie")), np.full(points, ends[-1] / points))

    return run


def _bounds(rows: list, parts: int) -> list[tuple]:
    """rows: a sample of keys and their weights. parts - 1 keys (has an id, id, tie) that cut the rows into ranges of about the same bytes."""
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.tie, r.weight) for r in rows)
    ends = np.cumsum([r[3] for r in rows])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    return sorted({rows[i][:3] for i in np.minimum(at, len(rows) - 1).tolist()})


def write_wavelets(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every document, appends end_id and writes folder/part-P-shard-S.wvm; gives the manifest (part, shard, file, docs, tokens, file_bytes, start).

    shard_bytes: about so much text to a shard."""
    from tokenizers import Tokenizer

    docs = columns(docs, doc_id=F.col(id_col).cast("bigint"), text=text_col).withColumn("tie", F.coalesce(F.xxhash64("text"), F.lit(0)))
    sized = docs.select("doc_id", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    # four rows of each input partition, whose bytes are then known too
    rows = by_arrow(sized, _sampled(4), "doc_id bigint, tie bigint, weight double", keeps=True).collect()
    total = int(sum(r.weight for r in rows))
    # two shards to a partition, or more where there would be very many partitions
    parts = max(1, min(-(-total // (2 * shard_bytes)), 2048), total // (16 * shard_bytes))
    bounds = _bounds(rows, parts) if parts > 1 else []
    dtype = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    coded = by_arrow(docs.select("doc_id", "text", "tie"), _encode(tokenizer, end_id, bounds), "part int, doc_id bigint, tie bigint, ids binary", keeps=True)
    dealt = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie", "ids")
    written = by_arrow(dealt, _write(folder, dtype, max(1, shard_bytes // 4)), "part int, shard int, file string, docs bigint, tokens bigint, file_bytes bigint", keeps=True)
    manifest = materialise(written, "wavelet_manifest")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    of_parts = of_parts.select("part", before(Window.orderBy("part")).alias("of_part"))  # a row for each partition
    within = manifest.withColumn("start", before(Window.partitionBy("part").orderBy("shard")))
    return within.join(of_parts, "part").withColumn("start", F.col("start") + F.col("of_part")).drop("of_part")


def _read(batches):
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held = unpack(content.as_buffer().to_pybytes())
            tokens = memoryview(held.decode().astype("<u4")).cast("B")
            begin = 0
            for k in range(-(-held.n_docs // DOCS)):
                ids, ends = held.documents(k)
                starts = np.concatenate([[begin], ends[:-1]])
                crc = [zlib.crc32(tokens[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield batch(schema, [path] * len(ids), ids, starts, ends - starts, crc)
                begin = int(ends[-1])


def read_wavelets(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, at, n_tokens, ids_crc32) of every document, all from the files' own bytes; at: place in the file."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.wvm").select(F.substring_index("path", "/", -1).alias("file"), "content")
    return by_arrow(files, _read, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint", keeps=True)


def wavelet_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_bytes: int = 16 << 20, folder: str | None = None) -> DataFrame:
    """Writes the shards into the folder (a new one in the shared folder, which stays) and gives (doc_id, start, n_tokens,
    ids_crc32, shard, folder) as read from them: the file is folder/shard."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "wavelets", keep=True)
    manifest = write_wavelets(docs, folder, tokenizer, end_id, shard_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard string, folder string")
    got = read_wavelets(spark, folder).join(manifest.select("file", "start"), "file")
    return got.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", F.col("file").alias("shard"), F.lit(folder).alias("folder"))
