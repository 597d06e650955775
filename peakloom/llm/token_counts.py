"""Token counts: pieces are counted once per distinct pre-token, joined to pre-token frequencies and summed; ids are never made.

Plan: a narrow pass turns each Arrow batch of documents into a block: its documents' pre-token frequencies (packed
numbers) and its distinct pre-tokens, cut by hash into buckets. The buckets meet by one exchange, where each distinct
pre-token is encoded once; the counts go back, in the order in which the block sent its pre-tokens, by a second
exchange of a few bits for each. A pre-token is sent once per block, not once per document, so that a word which every
document holds is no hot key. Texts are never shuffled.

Edge cases: a null or empty text has 0 bytes and 0 tokens; null and repeated ids stay, a row each; an empty table
gives an empty result; other columns are ignored. Special strings in a text are taken as the library's default does.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, materialise, release_memory, shuffle_partitions

_BLOCKS = "block string, bucket int, ids array<bigint>, sizes array<bigint>, lens binary, words binary, freqs binary"
_ARROW = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("lens", pa.binary()), ("words", pa.binary()), ("freqs", pa.binary())])
MAX_BUCKETS = 4096
_CACHE = 300_000

# Letters, numbers and white space up to U+024F, for the byte-level pattern of public tokenizers; a test holds them against the library's.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_SIMPLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


class PreTokens:
    """Splits a text into the tokenizer's own pre-tokens; special strings are pre-tokens of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        added = sorted((x["content"] for x in told["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
            raise ValueError("token counts by pre-token need special strings that take no white space and stand anywhere")
        if told["normalizer"]:
            raise ValueError("token counts by pre-token need a tokenizer without a normalizer")
        before = told["pre_tokenizer"] or {}
        self.simple = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]

    def split(self, text: str) -> list[str]:
        if self.simple and not (self.special and self.special.search(text)) and not _BEYOND.search(text):
            return _SIMPLE.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out


def _zip(numbers: np.ndarray) -> bytes:
    """uint32s by byte planes, zstd."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unzip(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _blocks(path: str, buckets: int):
    def run(batches):
        by, part = PreTokens(path), TaskContext.get().partitionId()
        for seq, b in enumerate(x for x in batches if x.num_rows):
            place: dict[str, int] = {}
            words, freqs, lens, sizes = [], [], [], []
            for value in b.column(1):
                text = value.as_py() or ""
                found = Counter(by.split(text))
                for x in found:
                    if x not in place:
                        place[x] = len(place)
                words.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
                freqs.append(np.fromiter(found.values(), np.uint32, len(found)))
                lens.append(len(found))
                sizes.append(len(value.as_buffer()) if value.is_valid else 0)
            told = [x.encode() for x in place]
            bucket = np.fromiter(map(zlib.crc32, told), np.uint32, len(told)) % buckets
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            at = rank[np.concatenate(words)].astype(np.int64) + (np.repeat(np.arange(len(lens)), lens) << 32)
            by_place = np.argsort(at)
            steps = np.diff(at[by_place] & 0xFFFFFFFF, prepend=0) % (1 << 32)
            name = f"{part}-{seq}"
            yield batch(_ARROW, [name], [None], [b.column(0).to_pylist()], [sizes], [_zip(np.array(lens))], [_zip(steps)], [_zip(np.concatenate(freqs)[by_place])])
            ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
            pack = zstandard.ZstdCompressor(level=1).compress
            rows, start = [], 0
            for k, end in enumerate(ends):
                if end > start:
                    own = [told[i] for i in order[start:end].tolist()]
                    rows.append((k, _zip(np.fromiter(map(len, own), np.uint32, len(own))), pack(b"".join(own))))
                start = end
            if rows:
                none = [None] * len(rows)
                yield batch(_ARROW, [name] * len(rows), [r[0] for r in rows], none, none, [r[1] for r in rows], [r[2] for r in rows], none)

    return run


def _pieces(path: str):
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("pieces", pa.binary())])

    def run(batches):
        by, known, last = PreTokens(path), {}, None
        for b in batches:
            for block, bucket, lens, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last or len(known) > _CACHE:
                    known, last = {}, bucket
                sizes = _unzip(lens)
                ends = np.cumsum(sizes)
                blob = zstandard.ZstdDecompressor().decompress(words)
                own = [blob[a:z] for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                if new := [x for x in own if x not in known]:
                    got = by.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)
                    known.update(zip(new, map(len, got), strict=True))
                yield batch(schema, [block], [bucket], [_zip(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))])

    return run


def _sums(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    release_memory()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    got = dict(zip(counts["bucket"].to_pylist(), counts["pieces"].to_pylist(), strict=True))
    pieces = np.concatenate([np.empty(0, np.int64), *(_unzip(got[k]) for k in sorted(got))]).astype(np.int64)
    out = []
    for row in blocks.to_pylist():
        lens, steps, freqs = (_unzip(row[k]).astype(np.int64) for k in ("lens", "words", "freqs"))
        words = np.cumsum(steps) & 0xFFFFFFFF
        total = np.concatenate([[0], np.cumsum(pieces[words] * freqs)])
        at = np.concatenate([[0], np.cumsum(lens)])
        out.append(batch(schema, row["ids"], row["sizes"], total[at[1:]] - total[at[:-1]]))
    return pa.Table.from_batches(out, schema)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document. tokenizer: path of a tokenizers .json file that every executor has."""
    buckets = min(MAX_BUCKETS, 4 * shuffle_partitions(docs.sparkSession))
    docs = columns(docs, doc_id=F.col(id_col).cast("bigint"), text=text_col)
    blocks = materialise(by_arrow(docs, _blocks(tokenizer, buckets), _BLOCKS), "token_blocks")
    sent = blocks.filter("bucket is not null").select("block", "bucket", "lens", "words").repartition("bucket").sortWithinPartitions("bucket")
    counts = by_arrow(sent, _pieces(tokenizer), "block string, bucket int, pieces binary")
    return blocks.filter("bucket is null").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_sums, "doc_id bigint, n_bytes bigint, n_tokens bigint")
