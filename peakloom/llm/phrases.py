"""Phrase collocations by vertical positional inverted lists.

One narrow pass over the texts writes the inverted lists of shards of at most SHARD bytes of one language: each word's sorted
positions, with a gap wherever a piece (text between signs) ends, so that neighbours in a piece stand at positions that
follow each other. Level by level, within each shard, the occurrence lists of frequent phrases are merge-joined with the
postings of the next word: an occurrence at p of k words goes on where a posting stands at p + k. The lengths of a
phrase's lists, summed over shards, are its exact frequency; positions never leave their shard, so that neither a very
common word nor a hot language makes a long list anywhere.

Only phrases of frequent parts are extended (a phrase is no more frequent than its parts). What is frequent reaches the
shards as bit maps of hashes, of bounded size, which let through a little more and never less; what counts is
decided on the sums. Phrases are keyed by a 64-bit hash of each word with its language; that no two words of the
whole corpus share one is checked, and other hashes are taken if they do.

A text longer than a shard is cut at a word's end, and the shard after begins with the last words of the one before, whose own
occurrences don't count again: every text is read whole, and a shard's memory is bounded.

Defined cases: null and empty texts, and pieces without words, have none; a null language is `und`; repeated rows count
again; an empty table gives an empty result; ties go by score, frequency and the phrase's bytes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, Marks, batch, bits_of, by_arrow, columns, discard, hashes_of, materialise, mix, pieces_of, raw

SHARD = 4 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: 0 in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

_LISTS = pa.schema([("lang", pa.string()), ("fresh", pa.int32()), ("words", pa.list_(pa.string())), ("sizes", pa.binary()), ("positions", pa.binary())])
LISTS = "lang string, fresh int, words array<string>, sizes binary, positions binary"
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("k1", pa.int64()), ("f", pa.int64())])


def shards_of(data: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """Lower-cased runs of about `size` bytes that end between words, and how many words at the beginning of each were in the run before."""
    begin, back = 0, 0
    while begin < len(data):
        end = min(len(data), begin + size)
        while end < len(data) and not KIND[data[end]]:
            nearest = [at for c in b" \t.,;:!?\n\x0b\x0c\r" if (at := data.find(bytes([c]), end, end + size)) >= 0]
            end = min(nearest, default=min(len(data), end + size))
        yield data[begin - back : end], (len(_words(data[begin - back : begin])[0]) if back else 0)
        begin, back = end, _tail(data, end, carry)


def _tail(data: bytes, end: int, carry: int) -> int:
    """Bytes from the beginning of the last `carry` words before end, in steps back of twice the length."""
    if not carry or end >= len(data):
        return 0
    reach = 64
    while True:
        part = data[max(0, end - reach) : end]
        starts, _ = _words(part)
        if end <= reach:
            return end - (int(starts[-carry]) if len(starts) >= carry else 0)
        if len(starts) > carry:  # the first of the part may be a word's end
            return len(part) - int(starts[-carry])
        reach *= 2


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    inside = np.concatenate([[False], KIND[np.frombuffer(data, np.uint8)] == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def inverted(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, lengths of their lists, the lists one after the other) of one shard."""
    text = np.frombuffer(data, np.uint8)
    kinds = KIND[text]
    starts, ends = _words(data)
    breaks = np.flatnonzero(kinds == 2)
    places = (np.arange(len(starts)) + np.searchsorted(breaks, starts)).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[kinds == 0])])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    return coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32), places[np.argsort(codes, kind="stable")]


def _index(size: int, carry: int):
    def run(batches):
        for b in batches:
            langs, texts = b.column(0), b.column(1)
            for lang in langs.unique():
                own = texts.filter(pc.equal(langs, lang)).drop_null()
                for a, z in pieces_of(own, size):
                    data = b"\n".join(raw(own[a:z])).translate(LOWER)
                    for part, again in shards_of(data, size, carry):
                        words, sizes, places = inverted(part)
                        if len(words):
                            first = int(np.sort(places)[again]) if again < len(places) else 2**31 - 1
                            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                            yield batch(_LISTS, [lang.as_py()], [first], listed, [sizes.tobytes()], [places.tobytes()])

    return run


def word_keys(lang: str, words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit number for each word of a language."""
    own = mix(hashes_of(pa.array([lang, str(seed)], pa.string())))
    return mix(hashes_of(words) ^ mix(own[:1] + own[1:])).view(np.int64)


class Shard:
    """A row of the index as arrays. The words' lists, and the postings in order of position, hold frequent words only, if these are marked."""

    def __init__(self, row, seed: int, marked: np.ndarray | None):
        words = row["words"].values
        self.lang, self.fresh, self.words = row["lang"].as_py(), row["fresh"].as_py(), words
        self.keys = word_keys(self.lang, words, seed)
        codes = np.repeat(np.arange(len(words)), np.frombuffer(row["sizes"].as_buffer(), np.int32))
        places = np.frombuffer(row["positions"].as_buffer(), np.int32)
        if marked is not None:
            kept = Marks.has(marked, self.keys)[codes]
            codes, places = codes[kept], places[kept]
        self.lists = (codes, places)
        order = np.argsort(places, kind="stable")
        self.postings = (places[order], codes[order])


def _rows(b: pa.RecordBatch):
    for i in range(b.num_rows):
        yield {f.name: b.column(j)[i] for j, f in enumerate(b.schema)}


def _count_words(seed: int):
    def run(batches):
        for b in batches:
            for row in _rows(b):
                shard = Shard(row, seed, None)
                codes, places = shard.lists
                n = np.bincount(codes[places >= shard.fresh], minlength=len(shard.words))
                some = np.flatnonzero(n)
                yield batch(_COUNTS, [shard.lang] * len(some), shard.words.take(pa.array(some)), shard.keys[some], n[some].astype(np.int64))

    return run


def phrase_mark(keys: list) -> np.ndarray | Column:
    """One number from the keys of a phrase's words, alike in NumPy and Spark: each is turned further and all are XORed."""
    if isinstance(keys[0], np.ndarray):
        out = np.zeros(len(keys[0]), np.uint64)
        for i, k in enumerate(keys):
            k = k.view(np.uint64)
            out ^= k if not i else (k << np.uint64(21 * i % 64)) | (k >> np.uint64(64 - 21 * i % 64))
        return out.view(np.int64)
    out = keys[0]
    for i, k in enumerate(keys[1:], 1):
        turn = 21 * i % 64
        out = out.bitwiseXOR(F.shiftleft(k, turn).bitwiseOR(F.shiftrightunsigned(k, 64 - turn)))
    return out


def extend(lists: tuple[np.ndarray, np.ndarray], length: int, postings: tuple[np.ndarray, np.ndarray], n_codes: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Merge-joins the occurrences (phrase, start) of phrases of that length with the postings (position, word) right after them:
    the new phrases as (phrase, word), their lists, each in order of position, and the lists' lengths."""
    phrases, starts = lists
    places, codes = postings
    at = np.searchsorted(places, starts + length)
    met = at < len(places)
    met[met] = places[at[met]] == starts[met] + length
    pairs = phrases[met].astype(np.int64) * n_codes + codes[at[met]]
    order = np.argsort(pairs, kind="stable")
    pairs, starts = pairs[order], starts[met][order]
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([new, [len(pairs)]]))
    return np.stack(np.divmod(pairs[new], n_codes), 1), (np.repeat(np.arange(len(new)), sizes), starts), sizes


def _count_phrases(seed: int, marks: list, length: int):
    """marks: bit maps of the frequent phrases of 1, 2, ... words."""
    schema = pa.schema([*[(f"k{i}", pa.int64()) for i in range(1, length + 1)], ("f", pa.int64())])

    def run(batches):
        for b in batches:
            for row in _rows(b):
                shard = Shard(row, seed, marks[0].value)
                lists, keys = shard.lists, [shard.keys]
                for k in range(1, length):
                    parents, lists, _ = extend(lists, k, shard.postings, len(shard.words))
                    keys = [*[x[parents[:, 0]] for x in keys], shard.keys[parents[:, 1]]]
                    if k + 1 < length:  # what isn't frequent goes before the next level
                        fine = Marks.has(marks[k].value, phrase_mark(keys))[lists[0]]
                    else:  # only the last words' occurrences that are new count
                        fine = lists[1] + k >= shard.fresh
                    lists = (lists[0][fine], lists[1][fine])
                n = np.bincount(lists[0], minlength=len(keys[0]))
                some = np.flatnonzero(n)
                yield batch(schema, *[x[some] for x in keys], n[some].astype(np.int64))

    return run


def frequencies(docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang", size: int = SHARD) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for phrases of 1, 2, ... words, the frequent ones: (k1, ..., f), that of words with lang and word too. All written."""
    spark = docs.sparkSession
    texts = columns(docs, lang=F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), text=F.col(f"`{text_col}`").cast("string")).filter("text is not null and text <> ''")
    index = materialise(by_arrow(texts, _index(size, longest - 1), LISTS), "inverted_lists", **LARGE_ROWS)
    for seed in range(64):
        words = by_arrow(index, _count_words(seed), "lang string, word string, k1 bigint, f bigint").groupBy("lang", "word", "k1").agg(F.sum("f").alias("f"))
        words = materialise(words, "word_counts")
        if words.groupBy("k1").count().filter("count > 1").isEmpty():
            break
        discard(words)
    totals = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    levels, marks = [words.filter(F.col("f") >= least)], []
    for length in range(2, longest + 1):
        keys = [f"k{i}" for i in range(1, length + 1)]
        marks.append(spark.sparkContext.broadcast(bits_of(levels[-1].select(phrase_mark([F.col(c) for c in keys[:-1]]).alias("mark")), "mark")))
        counts = by_arrow(index, _count_phrases(seed, marks, length), ", ".join(f"{c} bigint" for c in [*keys, "f"]))
        levels.append(materialise(counts.groupBy(*keys).agg(F.sum("f").alias("f")).filter(F.col("f") >= least), f"phrases_{length}"))
    return totals, levels


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, scale: int = 1_000_000, salts: int = 32, **cols) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` best of the frequent phrases of 2 to `longest` words.

    score: floor(scale a^2 / (l r)) of the cut into two parts where it is lowest (the first such cut). A phrase that lies in a longer
    one of at least `inside` hundredths of its frequency is left out."""
    totals, levels = frequencies(docs, least, longest, **cols)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = None
    for length in range(2, longest + 1):
        keys = [f"k{i}" for i in range(1, length + 1)]
        found = levels[length - 1].withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, length):
            left, right = (levels[n - 1].select(*[F.col(f"k{i + 1}").alias(keys[at + i]) for i in range(n)], F.col("f").alias(f"{side}{k}")) for side, n, at in (("l", k, 0), ("r", length - k, k)))
            found = found.join(left, keys[:k]).join(right, keys[k:])
            score = f"CAST(CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * {scale} DIV (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0))) AS BIGINT)"
            cuts.append(F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        found = found.select(*keys, "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
        for longer in range(length + 1, longest + 1):
            parts = [levels[longer - 1].select(*[F.col(f"k{at + i}").alias(keys[i - 1]) for i in range(1, length + 1)], "f") for at in range(longer - length + 1)]
            held = parts[0]
            for p in parts[1:]:
                held = held.unionByName(p)
            held = held.groupBy(*keys).agg(F.max("f").alias("__most"))
            found = found.join(held, keys, "left").filter(F.col("__most").isNull() | (whole("__most") * 100 < whole("a") * inside)).drop("__most")
        for i, c in enumerate(keys):
            found = found.join(levels[0].select(F.col("k1").alias(c), F.col("word").alias(f"w{i}"), *([F.col("lang")] if not i else [])), c)
        found = found.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(length)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        ranked = found if ranked is None else ranked.unionByName(found)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first in parts of each language, then among their best
    ranked = ranked.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
