"""Substring dedup of bytes by a multi-document Burrows-Wheeler construction that inserts one symbol per document a round.

The collection is cut first by minimizer (see repeats), because a round for each of the longest text's bytes over the
whole collection can't be dealt out: all pieces in which a repeated string could start meet in one bucket, and equal
pieces fold into one. A bucket's different pieces are then the documents of a column-wise construction: each round
puts the next symbol, from the right, of every piece at its place, which rank over the order so far gives (the LF
mapping), and updates the common prefixes beside the new suffixes by range minima over the last round's. A symbol is
`width` bytes; a piece enters once for each of the `width` phases, so that every byte starts a suffix. Buckets are
collected to about a megabyte for one construction, whose arrays each round reads and writes once from front to back;
they stay in memory, being bounded, where a construction over whole shards would keep them in external files.

Edge cases: a null text has no bytes; texts shorter than `window` stay whole; matches never cross texts; repeated ids
stay, a row each, and copies of a row do repeat each other; an empty table gives an empty result; other columns are
ignored. Results are of bytes: a cut may fall within a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import HOT, SPANS, Bytes, Entry, by_block, cut_repeats, mark_repeats, meet


class RangeMinimum:
    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        for j in range(max(0, int(longest).bit_length() - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: -(1 << j)], last[1 << j :]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo:hi], each range not empty."""
        out = np.empty(len(lo), self.levels[0].dtype)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for j in np.unique(level).tolist():
            at = np.flatnonzero(level == j)
            out[at] = np.minimum(self.levels[j][lo[at]], self.levels[j][hi[at] - (1 << j)])
        return out


def collection_bwt(symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings symbols[starts[i] : starts[i] + lens[i]], of symbols from 1: all suffixes in order, as places in
    symbols (-1: the empty ones), and the common prefix of each with the one before."""
    m = len(starts)
    key = np.arange(m, dtype=np.int64)  # first symbol << 32 | place of the suffix without it
    common, place = np.zeros(m, np.int16), np.full(m, -1, np.int64)
    at = np.arange(m)  # of each string's last suffix
    order = np.argsort(-lens, kind="stable")
    ending = np.searchsorted(-lens[order], -np.arange(1, int(lens.max(initial=0)) + 1), "right")
    for j, n_active in enumerate(ending.tolist(), 1):
        active = order[:n_active]
        source = starts[active] + lens[active] - j
        new = symbols[source] << 32 | at[active]
        by_key = np.argsort(new)
        new, source = new[by_key], source[by_key]
        slot = np.searchsorted(key, new)
        to, n = slot + np.arange(n_active), len(key) + n_active
        old = np.ones(n, bool)
        old[to] = False
        merged = np.empty(n, np.int64)
        merged[to], merged[old] = new, key
        places = np.empty(n, np.int64)
        places[to], places[old] = source, place
        prefixes = np.empty(n, np.int16)
        prefixes[old] = common
        touched = np.unique(np.concatenate([to, to + 1]))
        touched = touched[touched < n]
        prefixes[touched] = 0
        touched = touched[touched > 0]
        same = touched[merged[touched] >> 32 == merged[touched - 1] >> 32]
        if len(same):
            hi = (merged[same] & 0xFFFFFFFF) + 1
            lo = (merged[same - 1] & 0xFFFFFFFF) + 1
            prefixes[same] = RangeMinimum(common, (hi - lo).max())(lo, hi) + 1
        moved = np.cumsum(np.bincount(slot, minlength=len(key) + 1))
        key = merged + moved[merged & 0xFFFFFFFF]
        common, place = prefixes, places
        at[active[by_key]] = to
    return place, common


def repeated_windows(groups: list[list[bytes]], window: int):
    """For each group, for each of its contents: spans of windows that another content has too."""
    contents = [c for g in groups for c in g]
    width = next(w for w in (8, 7, 6, 5, 4, 3, 2, 1) if window % w == 0)
    coded, owner, phase, lens = [], [], [], []
    for k, c in enumerate(contents):
        for f in range(min(width, len(c) - window + 1)):
            n = (len(c) - f) // width
            bytes_ = np.frombuffer(c, np.uint8, n * width, f).reshape(n, width).astype(np.uint64)
            coded.append(bytes_ @ (np.uint64(256) ** np.arange(width, dtype=np.uint64)))
            owner.append(k)
            phase.append(f)
            lens.append(n)
    ranks = np.unique(np.concatenate(coded), return_inverse=True)[1].astype(np.int64) + 1
    lens = np.array(lens)
    starts = np.cumsum(lens) - lens
    place, common = collection_bwt(ranks, starts, lens)
    long_ = common >= window // width
    hit = place[long_ | np.concatenate([long_[1:], [False]])]
    string = np.searchsorted(starts, hit, "right") - 1
    offset = np.array(phase)[string] + width * (hit - starts[string])
    order = np.lexsort((offset, own := np.array(owner)[string]))
    spans: list[list[tuple[int, int]]] = [[] for _ in contents]
    for k, o in zip(own[order].tolist(), offset[order].tolist(), strict=True):
        if spans[k] and spans[k][-1][1] == o:
            spans[k][-1] = (spans[k][-1][0], o + 1)
        else:
            spans[k].append((o, o + 1))
    it = iter(spans)
    for g in groups:
        yield [next(it) for _ in g]


def _matcher(window: int):
    def run(groups: list[list[Entry]]):
        several = [g for g in groups if len(g) > 1]
        found = iter(repeated_windows([[e.content for e in g] for g in several], window) if several else ())
        rows = []
        for g in groups:
            for e, spans in zip(g, next(found) if len(g) > 1 else [()] * len(g), strict=True):
                if e.n > 1:
                    spans = [(0, len(e.content) - window + 1)]
                for a, z in spans:
                    rows.append(np.stack([np.array(e.blocks), np.array(e.segs), np.full(len(e.segs), a), np.full(len(e.segs), z)], 1))
        return by_block(np.concatenate(rows)) if rows else []

    return run


def dedup_bytes(docs: DataFrame, window: int = 400, keep_text: bool = False, k: int | None = None, hot: int = HOT) -> DataFrame:
    """Bytes in any string of that many bytes that starts at another place too are removed. See repeats.cut_repeats for the result."""
    marked = mark_repeats(docs, Bytes, window, 0, k or max(1, window // 2), keep_text, hot)
    found = meet(marked, _matcher(window), pa.schema([("block", pa.int64()), ("spans", pa.binary())]), SPANS)
    return cut_repeats(marked, found, Bytes, window, 3, keep_text)
