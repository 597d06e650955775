"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over by every document's words.

Plan: test items are cut into pieces that overlap by a window less a word, so that each window lies whole in a piece; equal pieces
of an item are taken once, and pieces are dealt out by hash to groups of about max_words words. So an automaton, which is
broadcast, is of bounded size however long an item is and however often it is repeated. The documents pass through one group's
pass after another, narrowly: no shuffle, no text leaves its partition. With several groups each pass is written before the next one's automaton is made,
so that one is held at a time. At each word the automaton holds the longest suffix of the text that some
item contains; where it is `window` words or more, those words are hit. Shorter items count whole.

Edge cases: null or empty texts have no words and no hits; items without words are ignored; with no items nothing is
hit; repeated ids stay, a row each; repeated items all count; items without id hit too, count as one item and stand in no
list of ids; other columns are ignored; very long texts are scanned whole, word by word, and very long items are met in any of their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import batch, by_arrow, columns, discard, free_name, materialise, raw

#: ASCII that isn't a letter or digit parts words; A-Z become a-z; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A word is at most this many bytes in the bound of a broadcast automaton.
MAX_WORDS = 400_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several word sequences. After finish(), owner[state] names the item sets of the windows that end in a state."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[bytes, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of p's longest string and word: q, or a clone of it."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, self.next[last][word], word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new

    def states(self, words: list[bytes], window: int) -> Iterator[int]:
        """The state of each of the item's windows."""
        size, state = min(window, len(words)), 0
        for i, word in enumerate(words):
            state = self.next[state][word]
            while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                state = self.link[state]
            if i >= size - 1:
                yield state

    def finish(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.window = window
        self.owners: list[dict[int, set[int]]] = [{} for _ in self.length]  # state: window length: items
        for item, words in items:
            for state in self.states(words, window):
                self.owners[state].setdefault(min(window, len(words)), set()).add(item)
        self.shorter = [0] * len(self.length)  # the nearest state up the links, itself included, with a short item, or -1
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            own = any(k < window for k in self.owners[s])
            self.shorter[s] = s if own else self.shorter[self.link[s]] if s else -1

    def scan(self, words: list[bytes], found: set[int]) -> list[tuple[int, int]]:
        """Adds items to found; gives the spans of words that windows of items cover, in order of their ends."""
        after, link, length, owners, shorter, window = self.next, self.link, self.length, self.owners, self.shorter, self.window
        root, state, matched, spans = after[0], 0, 0, []
        for i, word in enumerate(words):
            to = after[state].get(word)
            if to is None:
                if word not in root:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = after[state].get(word)
                matched = length[state]
            state, matched = to, matched + 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= owners[at].get(window, ())
                spans.append((i + 1 - window, i + 1))
            s = shorter[state]
            while s >= 0:
                for size, items in owners[s].items():
                    if size < window and size <= matched:
                        found |= items
                        spans.append((i + 1 - size, i + 1))
                s = shorter[link[s]] if s else -1
        return spans


def _automaton(items: list[tuple[int, bytes]], window: int) -> SuffixAutomaton:
    """Of pieces: (item, words joined by a space)."""
    told = [(k, piece.split(b" ")) for k, piece in items]
    automaton = SuffixAutomaton()
    for _, words in told:
        automaton.add(words)
    automaton.finish(told, window)
    return automaton


def _cut(window: int, size: int):
    """Pieces of size words at most (item_id, piece, weight), each next one beginning window - 1 words before the last one's end.

    weight: how many words of two bytes, a letter and its gap, the piece's bytes would hold."""
    schema = pa.schema([("item_id", pa.int64()), ("piece", pa.binary()), ("weight", pa.int64())])

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
                words = words_of(text or b"")
                starts = range(0, max(1, len(words) - window + 1), size - window + 1) if words else ()
                for some in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    pieces = [b" ".join(words[i : i + size]) for i in some]
                    yield batch(schema, [item] * len(pieces), pieces, [len(p) // 2 + 1 for p in pieces])

    return run


def _pass(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.binary()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        automaton = shared.value
        for b in batches:
            spans, items = [], []
            for text, was, had in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found: set[int] = set(had or ())
                got = automaton.scan(words_of(text.as_buffer().to_pybytes()), found) if text.is_valid else []
                spans.append((was or b"") + (np.array(got, "<u4").tobytes() if got else b""))
                items.append(sorted(found, key=lambda x: (x is None, x or 0)))
            yield batch(schema, b.column(0), b.column(1), spans, items)

    return run


def covered(spans: bytes, n: int) -> np.ndarray:
    """Marks of the words (or other units) in any of the packed (start, end) pairs."""
    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
    steps = np.bincount(pairs[:, 0], minlength=n + 1) - np.bincount(pairs[:, 1], minlength=n + 1) if len(pairs) else np.zeros(n + 1, np.int64)
    return np.cumsum(steps[: n + 1])[:n] > 0


def item_pieces(benchmark: DataFrame, window: int, max_words: int) -> DataFrame:
    """(item_id, piece, weight): the items' pieces of at most a sixteenth of max_words each, each of an item's once."""
    items = columns(benchmark, item_id=F.col("item_id").cast("bigint"), text="text").filter("text is not null")
    return by_arrow(items, _cut(window, max(2 * window, max_words // 16)), "item_id bigint, piece binary, weight bigint").distinct()


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, text, spans, items): packed (start, end) word spans and the sorted ids of the items found.

    An automaton holds items of at most about max_words words; more items make more passes, not a larger broadcast."""
    docs = columns(docs, doc_id=F.col("doc_id").cast("bigint"), text="text")
    out = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<bigint>").alias("items"))
    schema = "doc_id bigint, text string, spans binary, items array<bigint>"
    return _passes(out, benchmark, window, max_words, lambda shared, first, last: (_pass(shared), schema))


def _passes(out: DataFrame, benchmark: DataFrame, window: int, max_words: int, step) -> DataFrame:
    """out through one group of items after another: step(automaton, whether it is the first, the last) gives a pass and its schema."""
    items = materialise(item_pieces(benchmark, window, max_words), "item_pieces")
    words = items.agg(F.sum("weight")).first()[0] or 0
    groups, before = max(1, -(-int(words) // max_words)), None
    for g in range(groups):
        own = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id", "piece"), F.lit(groups)) == g)
        pieces = [(k, bytes(piece)) for k, piece in own.select("item_id", "piece").collect()]
        shared = out.sparkSession.sparkContext.broadcast(_automaton(pieces, window))
        out = by_arrow(out, *step(shared, g == 0, g == groups - 1))
        if g < groups - 1:
            out = materialise(out, "marked_texts")
            shared.destroy()
            if before:
                discard(before)
            before = out
    discard(items)
    return out


def _report(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
    for b in batches:
        n_words, n_hit, items = [], [], b.column(3).to_pylist()
        for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            n_words.append(n := len(words_of(text.as_buffer().to_pybytes())) if text.is_valid else 0)
            n_hit.append(int(covered(spans, n).sum()) if spans else 0)
        sha = [hashlib.sha256(",".join(sorted(str(i) for i in x if i is not None)).encode()).hexdigest() for x in items]
        yield batch(schema, b.column(0), n_words, n_hit, [len(x) for x in items], sha, [n > 0 for n in n_hit])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    return by_arrow(match_benchmark(docs, benchmark, window), _report, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def _clean(max_words: int, max_share: float):
    """Cuts hit spans out of the text by the words' byte places; a document over a limit goes whole."""
    import re

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_hit", pa.int64()), ("removed", pa.bool_())])
    word = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def run(batches):
        for b in batches:
            texts, hits, gone = [], [], []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                if not spans:
                    texts.append(text.as_py())
                    hits.append(0)
                    gone.append(False)
                    continue
                data = text.as_buffer().to_pybytes()
                places = [m.span() for m in word.finditer(data)]
                hit = covered(spans, len(places))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                parts, at = [], 0
                for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    parts.append(data[at : places[a][0]])
                    at = places[z - 1][1]
                texts.append(b"".join([*parts, data[at:]]).decode())
                hits.append(int(hit.sum()))
                gone.append(hits[-1] > max_words or hits[-1] > max_share * len(places))
            yield batch(schema, b.column(0), texts, hits, gone)

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 10**9, max_share: float = 0.5) -> DataFrame:
    """(doc_id, text, n_hit, removed): texts without the hit spans; removed where they exceed max_words or max_share of the words."""
    return by_arrow(match_benchmark(docs, benchmark, window), _clean(max_words, max_share), "doc_id bigint, text string, n_hit bigint, removed boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.5, max_words: int = 10**9) -> DataFrame:
    """The documents with all their columns, hit spans cut out of text; those over a limit go.

    n_chars, where there is such a column, follows the text."""
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    name = free_name(docs, "spans")
    held = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    cut = _cut_spans(at, chars, max_words, max_share)

    def step(shared, first, last):
        mark = _mark_spans(shared, at, first, name)
        return (lambda batches: cut(mark(batches)), docs.schema) if last else (mark, held)

    return _passes(docs, benchmark, window, MAX_WORDS, step)


def _mark_spans(shared, at: int, first: bool, name: str):
    """Adds to the spans in the last column, which the first pass makes."""

    def run(batches):
        for b in batches:
            spans, known = [], [None] * b.num_rows if first else b.column(b.num_columns - 1).to_pylist()
            for text, had in zip(b.column(at), known, strict=True):
                got = shared.value.scan(words_of(text.as_buffer().to_pybytes()), set()) if text.is_valid else []
                spans.append((had or b"") + np.array(got, "<u4").tobytes())
            own = b.columns if first else b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(spans, pa.binary())], names=[*b.schema.names[: len(own)], name])

    return run


def _cut_spans(at: int, chars: int | None, max_words: int, max_share: float):
    clean = _clean(max_words, max_share)
    told = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.binary()), ("items", pa.binary())])

    def run(batches):
        for b in batches:
            n, spans = b.num_rows, b.column(b.num_columns - 1)
            if not n:
                continue
            got = next(clean([batch(told, pa.nulls(n, pa.int64()), b.column(at), spans, pa.nulls(n, pa.binary()))]))
            out = pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).set_column(at, b.schema.field(at), got.column(1))
            if chars is not None:
                field, cut = b.schema.field(chars), got.column(2).to_pylist()
                sizes = [len(t.as_py()) if c else old for t, c, old in zip(got.column(1), cut, b.column(chars).to_pylist(), strict=True)]
                out = out.set_column(chars, field, pa.array(sizes, field.type))
            yield out.filter(pa.array([not x for x in got.column(3).to_pylist()]))

    return run
