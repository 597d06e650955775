"""Substring dedup of words by a compacted de Bruijn graph of the token k-mers.

Nodes are runs of window - 1 words, edges the windows of `window` words; only repeated edges belong to the graph. All
occurrences of a node meet, with the words before and after them, under the minimizer of the node (see repeats), so that
its repeated edges in and out, and their multiplicities, are exact there; words are compared, not hashes. There too edges
that follow each other over a node with one edge in and one out are compacted to a chain. An edge between nodes of
different minimizers is known on both sides: a Spark join on its digest links the chain that ends with it to the chain
that goes on where the node between has one edge in and one out, and linked chains are compacted to nonbranching paths by
pointer jumping, a join a round, as many rounds as the logarithm of the longest path's chains. Each chain carries its
source coordinates (block, segment, place); joined with its path they go back to the documents, where neighbouring spans
of one path must have neighbouring places in it, and the covered words are cut.

Edge cases: null or empty texts have no words; texts of fewer than `window` words keep all; repeated ids stay, a row
each, and copies of a row do repeat each other; cyclic paths stay as their chains; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, discard, materialise
from .repeats import HOT, SPANS, Entry, Words, by_block, cut_repeats, mark_repeats, meet

CHAIN = "chain bigint, edges bigint, head binary, tail binary, occ binary"
_CHAIN = pa.schema([("chain", pa.int64()), ("edges", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("occ", pa.binary())])
_NONE = (None, None)


def _digest(edge: bytes) -> bytes:
    return hashlib.blake2b(edge, digest_size=16).digest()


class Bucket:
    """The nodes of one minimizer, their repeated edges, and the chains of those."""

    def __init__(self, entries: list[Entry], node: int):
        self.node, self.number = node, {}  # words to a node; node's words: number
        self.names: list[bytes] = []
        self.last: list[bytes] = []  # each node's last word
        self.ins: list[dict[bytes, int]] = []
        self.outs: list[dict[bytes, int]] = []
        self.walks = [self._walk(e) for e in entries]
        self.one_in = [self._only(x) for x in self.ins]
        self.one_out = [self._only(x) for x in self.outs]

    def _walk(self, entry: Entry) -> list[tuple[int, bytes | None]]:
        """(node, next word or None) along a piece."""
        flags, words, m = entry.content[0] - 48, entry.content[1:].split(b" "), self.node
        ends = list(accumulate((len(w) + 1 for w in words), initial=1))
        first, out = flags & 1, []
        for i in range(first, len(words) - (flags >> 1) - m + 1):
            name = entry.content[ends[i] : ends[i + m] - 1]
            x = self.number.get(name)
            if x is None:
                x = self.number[name] = len(self.names)
                self.names.append(name)
                self.last.append(words[i + m - 1])
                self.ins.append({})
                self.outs.append({})
            if i:
                self.ins[x][words[i - 1]] = self.ins[x].get(words[i - 1], 0) + entry.n
            to = words[i + m] if i + m < len(words) else None
            if to is not None:
                self.outs[x][to] = self.outs[x].get(to, 0) + entry.n
            out.append((x, to))
        return out

    @staticmethod
    def _only(counts: dict[bytes, int]) -> bytes | None:
        """The word of the only repeated edge."""
        if len(counts) == 1:
            return next((w for w, n in counts.items() if n > 1), None)
        found = [w for w, n in counts.items() if n > 1]
        return found[0] if len(found) == 1 else None

    def chains(self):
        """(edges, head, tail, [(walk, first, end, place)]) of each chain: digests of the edge before it and of its last one, where
        those lead to other minimizers, and where the chain's edges from `place` on lie in the walks."""
        at: dict[tuple[int, bytes], tuple[int, int]] = {}  # edge: chain and place
        heads, lines, met = [], [], []
        for k, walk in enumerate(self.walks):
            j = 0
            while j < len(walk):
                x, to = walk[j]
                if to is None or self.outs[x][to] < 2:
                    j += 1
                    continue
                begin, (chain, place) = j, at.get((x, to)) or self._place((x, to), at, heads, lines)
                j += 1
                while j < len(walk) and walk[j][1] is not None and self.outs[walk[j][0]][walk[j][1]] > 1 and (at.get(walk[j]) or self._place(walk[j], at, heads, lines)) == (chain, place + j - begin):
                    j += 1
                met.append((chain, k, begin, j, place))
        found: list[list] = [[] for _ in lines]
        for chain, *where in met:
            found[chain].append(where)
        for head, line, where in zip(heads, lines, found, strict=True):
            x, to = line[-1]
            name = self.names[x]
            goes = name[name.index(b" ") + 1 :] + b" " + to if self.node > 1 else to
            yield len(line), head, None if goes in self.number else _digest(name + b" " + to), where

    def _place(self, edge, at, heads, lines) -> tuple[int, int]:
        """Chain and place of an edge, and of those before it on its chain."""
        back = [edge]
        seen = {edge}
        while True:
            x = back[-1][0]
            before = self.one_in[x] if self.one_out[x] is not None else None
            if before is None:
                heads.append(None)
                break
            name = self.names[x]
            z = self.number.get(before + b" " + name[: len(name) - len(self.last[x]) - 1] if self.node > 1 else before)
            if z is None:
                heads.append(_digest(before + b" " + name))
                break
            prev = (z, self.last[x])
            if prev in at:
                chain, place = at[prev]
                for i, e in enumerate(reversed(back), 1):
                    at[e] = chain, place + i
                    lines[chain].append(e)
                return at[edge]
            if prev in seen:  # a cycle is opened here
                heads.append(None)
                break
            back.append(prev)
            seen.add(prev)
        back.reverse()
        for i, e in enumerate(back):
            at[e] = len(lines), i
        lines.append(back)
        return at[edge]


def _matcher(node: int):
    """Rows of CHAIN."""

    def run(groups: list[list[Entry]]):
        part = TaskContext.get().partitionId() << 40
        for entries in groups:
            for edges, head, tail, where in Bucket(entries, node).chains():
                occ = []
                for walk, first, end, place in where:
                    e = entries[walk]
                    occ.append(np.stack([np.array(e.blocks), np.array(e.segs), *(np.full(len(e.segs), x) for x in (first, end, place))], 1))
                occ = np.concatenate(occ).astype("<i8")
                yield part | run.n, edges, head, tail, occ.tobytes()
                run.n += 1

    run.n = 0
    return run


def compact(chains: DataFrame) -> DataFrame:
    """(chain, path, place) of the chains that go on another one: path is the first chain of their nonbranching path, place
    the number of edges before them on it. Chains on a cycle are left out."""
    heads = chains.filter("head is not null").select("chain", F.col("head").alias("edge"))
    tails = chains.filter("tail is not null").select(F.col("chain").alias("path"), F.col("edges").alias("place"), F.col("tail").alias("edge"))
    at = materialise(heads.join(tails, "edge").select("chain", "path", "place"), "links")
    left, reach = at.count(), 1
    while left:
        up = at.select(F.col("chain").alias("path"), F.col("path").alias("next"), F.col("place").alias("more"))
        jumped = at.join(up, "path", "left").select("chain", F.coalesce("next", "path").alias("path"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("next").isNotNull().alias("on"))
        before, at, reach = at, materialise(jumped, "paths"), 2 * reach
        discard(before)
        on = at.filter("on").count()
        if not on or reach > 2 * left:
            break
        at = _written(at)
    return at.filter("not on").drop("on") if left else at


def _written(table: DataFrame) -> DataFrame:
    """The table without its mark, which discard still knows."""
    out = table.drop("on")
    out._written = table._written
    return out


def _spans(batches):
    schema = pa.schema([("block", pa.int64()), ("spans", pa.binary())])
    for b in (x for x in batches if x.num_rows):
        rows = [np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 5) for x in b.column(2)]
        which = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        rows = np.concatenate(rows)
        path, place = (b.column(i).to_numpy()[which] for i in (0, 1))
        yield batch(schema, *map(list, zip(*by_block(np.concatenate([rows[:, :4], path[:, None], (rows[:, 4] + place)[:, None]], 1)), strict=True)))


def _on_paths(chains: DataFrame) -> DataFrame:
    """(path, place, edges, occ) of every chain; a chain that goes on none is its own path."""
    known = compact(chains)
    return chains.join(known, "chain", "left").select(F.coalesce("path", "chain").alias("path"), F.coalesce("place", F.lit(0)).cast("bigint").alias("place"), "edges", "occ")


def _graph(docs: DataFrame, window: int, keep_text: bool, k: int | None, hot: int) -> tuple[DataFrame, DataFrame]:
    node = window - 1
    marked = mark_repeats(docs, Words, node, 1, k or max(1, node // 2), keep_text, hot)
    return marked, materialise(meet(marked, _matcher(node), _CHAIN, CHAIN), "chains")


def compacted_paths(docs: DataFrame, window: int = 35, k: int | None = None, hot: int = HOT) -> DataFrame:
    """(path, edges) of every nonbranching path of repeated edges: how many windows it has."""
    _, chains = _graph(docs, window, False, k, hot)
    return _on_paths(chains).groupBy("path").agg(F.sum("edges").alias("edges"))


def dedup_words(docs: DataFrame, window: int = 35, keep_text: bool = False, k: int | None = None, hot: int = HOT) -> DataFrame:
    """Words in any window of that many words that starts at another place too are removed. See repeats.cut_repeats for the result."""
    marked, chains = _graph(docs, window, keep_text, k, hot)
    found = by_arrow(_on_paths(chains).select("path", "place", "occ"), _spans, SPANS)
    return cut_repeats(marked, found, Words, window, 5, keep_text)
