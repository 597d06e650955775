"""Language ID by a linear-chain conditional random field over words, labelled by forward-backward.

Features of a word: its byte n-grams of 2 to 5 within boundary marks (those that hold a mark are prefixes and
suffixes), hashed to a table, and the word itself where the fitted lexicon has it. Transitions between the labels of
neighbouring words are learned too, half of the training rows being spliced from two languages, so that a switch within
a text costs something but is possible. A text's label is the language with the largest expected share of its words,
its score that share.

The fit, on the driver, is of at most max_rows labelled texts (chosen by hash of the id), each read whole, whatever its length: its
words, as numbers, are what the driver holds of it. Prediction is a narrow pass over whole texts: long ones are cut into chunks whose transfer matrices are
multiplied, so that results are exactly those of one pass over the whole text. The model's size is fixed.

Edge cases: null texts, texts without a letter: 'und', score 0; no labelled row: 'und' for all; ties go to the first
language by name; null ids are held in; repeated ids stay, a row each; an empty table gives an empty result; other
columns are ignored, and no prediction reads lang, source or the id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, mix, release_memory

_WORD = re.compile(r"[^\W\d_]+")
TABLE_BITS = 17
CHUNK = 64
GRAMS = (2, 3, 4, 5)
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    return found if text is None or text.isascii() else [w for w in found if any(map(str.isalpha, w))]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in the table, first place of each word, hash of each word); words aren't empty."""
    coded = [b"\x02" + w.encode() + b"\x03" for w in words]
    lens = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(_U) + _U(1)
    ends = np.cumsum(lens)
    starts = ends - lens
    left = np.repeat(ends, lens) - np.arange(len(data))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(words)), lens)
    places, owners, h = [], [], data
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _U(0x100000001B3) + data[n - 1 :]
        own = np.flatnonzero(left[: len(h)] >= n)
        places.append((mix(h[own] + _U(n)) >> _U(64 - TABLE_BITS)).astype(np.int64))
        owners.append(owner[own])
    owners, places = np.concatenate(owners), np.concatenate(places)
    order = np.argsort(owners, kind="stable")
    with np.errstate(over="ignore"):
        whole = mix(np.add.reduceat(data * mix(np.arange(len(data), dtype=_U) - np.repeat(starts, lens).astype(_U) + _U(77)), starts))
    return places[order], np.searchsorted(owners[order], np.arange(len(words))), whole


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray = field(repr=False)  # float32, of n-grams
    lexicon: np.ndarray = field(repr=False)  # sorted hashes of words
    lexical: np.ndarray = field(repr=False)  # float32, of the lexicon's words
    moves: np.ndarray = field(repr=False)  # log potentials of neighbouring labels

    def emissions(self, words: list[str]) -> np.ndarray:
        places, at, whole = word_features(words)
        out = np.add.reduceat(self.table[places], at, axis=0).astype(np.float64)
        if len(self.lexicon):
            k = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            known = self.lexicon[k] == whole
            out[known] += self.lexical[k[known]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray, forward: list | None = None) -> np.ndarray:
    """Posteriors of the labels of each word, exact for sequences laid end to end, of these lengths. forward: gets the forward messages."""
    k = scores.shape[1]
    pot = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(moves - moves.max())
    n_chunks = -(-lens // CHUNK)
    owner = np.repeat(np.arange(len(lens)), n_chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    begin = np.repeat(np.cumsum(lens) - lens, n_chunks) + nth * CHUNK
    size = np.minimum(CHUNK, np.repeat(lens, n_chunks) - nth * CHUNK)
    order = np.argsort(-size, kind="stable")  # the chunks that still run are then the first ones
    begin, size, owner, nth = begin[order], size[order], owner[order], nth[order]
    runs = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right").tolist()
    # transfer of each chunk: row i, from label i before it
    way = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    for t, r in enumerate(runs):
        way[:r] = way[:r] @ move * pot[begin[:r] + t][:, None, :]
        way[:r] /= way[:r].sum((1, 2), keepdims=True)
    # messages into the chunks, from the left and from the right
    into, back = np.full((len(size), k), 1.0 / k), np.full((len(size), k), 1.0 / k)
    where = np.lexsort((nth, owner))
    starts = np.cumsum(n_chunks) - n_chunks
    first_of = where[starts[n_chunks > 0]]
    plain = np.ones(k)
    for step in range(int(n_chunks.max(initial=0)) - 1):
        own = np.flatnonzero(n_chunks > step + 1)
        a, b = where[starts[own] + step], where[starts[own] + step + 1]
        if step == 0:
            into[b] = _unit(_first(way, begin, size, pot, move, a))
        else:
            into[b] = _unit(np.einsum("ni,nij->nj", into[a], way[a]))
        z, y = where[starts[own] + n_chunks[own] - 1 - step], where[starts[own] + n_chunks[own] - 2 - step]
        back[y] = _unit(np.einsum("nij,nj->ni", way[z], back[z]))
    is_first = np.zeros(len(size), bool)
    is_first[first_of] = True
    out = np.empty_like(pot)
    now = into.copy()
    for t, r in enumerate(runs):
        step = now[:r] @ move
        if t == 0:
            step[is_first[:r]] = plain
        now[:r] = _unit(step * pot[begin[:r] + t])
        out[begin[:r] + t] = now[:r]
    if forward is not None:
        forward.append(out.copy())
    now = back.copy()
    for t in reversed(range(len(runs))):
        r = runs[t]
        at = begin[:r] + t
        out[at] = _unit(out[at] * now[:r])
        now[:r] = _unit((pot[at] * now[:r]) @ move.T)
    return out


def _first(way, begin, size, pot, move, a):
    """Forward message out of the first chunks, which no move precedes."""
    now = pot[begin[a]].copy()
    for t in range(1, CHUNK):
        now = _unit(now @ move) * pot[begin[a] + t]
    return now


def fit(texts: list[tuple[str, str]], epochs: int = 4, lexicon_size: int = 400, rate: float = 0.4, seed: int = 11) -> Model | None:
    """texts: (text, language). AdaGrad on the log likelihood of rows of CHUNK words."""
    labels = sorted({y for _, y in texts})
    if not labels:
        return None
    rnd, number, k = np.random.default_rng(seed), {}, len(labels)
    rows, row_labels, counts = [], [], [dict() for _ in labels]
    for text, y in texts:
        words, y = words_of(text), labels.index(y)
        for w in words:
            counts[y][w] = counts[y].get(w, 0) + 1
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        for a in range(0, len(ids), CHUNK):
            rows.append(ids[a : a + CHUNK])
            row_labels.append(np.full(len(rows[-1]), y))
    model = Model(labels, np.zeros((1 << TABLE_BITS, k), np.float32), np.empty(0, _U), np.empty((0, k), np.float32), np.zeros((k, k)))
    if not rows:
        return model
    for i in rnd.permutation(len(rows))[: len(rows) // 2].tolist():  # splices of two languages
        j = int(rnd.integers(len(rows)))
        cut = int(rnd.integers(1, CHUNK))
        if row_labels[i][0] != row_labels[j][0]:
            rows[i], row_labels[i] = (np.concatenate([x[i][:cut], x[j][: CHUNK - cut]]) for x in (rows, row_labels))
    vocabulary = list(number)
    places, at, whole = word_features(vocabulary)
    sizes = np.diff(np.concatenate([at, [len(places)]]))
    top = sorted({w for c in counts for w in sorted(c, key=lambda w: (-c[w], w))[:lexicon_size]}, key=lambda w: whole[number[w]])
    model.lexicon = whole[[number[w] for w in top]]
    model.lexical = np.zeros((len(top), k), np.float32)
    lex = np.full(len(vocabulary), -1)
    lex[[number[w] for w in top]] = np.arange(len(top))
    state = [np.full(x.shape, 1e-2) for x in (model.table, model.lexical, model.moves)]
    for _ in range(epochs):
        order = rnd.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 128)):
            own = [rows[i] for i in part]
            lens = np.array([len(x) for x in own])
            ids, y = np.concatenate(own), np.concatenate([row_labels[i] for i in part])
            distinct, back = np.unique(ids, return_inverse=True)
            spot = np.concatenate([places[at[w] : at[w] + sizes[w]] for w in distinct.tolist()])
            owner = np.repeat(np.arange(len(distinct)), sizes[distinct])
            score = np.add.reduceat(model.table[spot], np.cumsum(sizes[distinct]) - sizes[distinct], axis=0).astype(np.float64)
            known = np.flatnonzero(lex[distinct] >= 0)
            score[known] += model.lexical[lex[distinct[known]]]
            post = marginals(score[back], lens, model.moves, messages := [])
            wrong = post.copy()
            wrong[np.arange(len(y)), y] -= 1
            by_word = np.stack([np.bincount(back, wrong[:, c], len(distinct)) for c in range(k)], 1)
            # posteriors of neighbours: forward message, move, and what the next word's posterior adds to its prediction
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(lens) - 1] = False
            a = np.flatnonzero(inner)
            move = np.exp(model.moves)
            joint = messages[0][a][:, :, None] * move[None] * (post[a + 1] / (messages[0][a] @ move))[:, None, :]
            seen = np.zeros((k, k))
            np.add.at(seen, (y[a], y[a + 1]), 1)
            grads = [np.stack([np.bincount(spot, by_word[owner, c], 1 << TABLE_BITS) for c in range(k)], 1), np.zeros(model.lexical.shape), joint.sum(0) - seen + 1e-3 * model.moves]
            grads[1][lex[distinct[known]]] = by_word[known]
            for x, g, s in zip((model.table, model.lexical, model.moves), grads, state, strict=True):
                g = g / len(part)
                s += g * g
                x -= (rate * g / np.sqrt(s)).astype(x.dtype)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, max_rows: int = 600) -> Model | None:
    """Fits on at most max_rows labelled texts that aren't held out, each of them whole."""
    rows = columns(docs, doc_id="doc_id", lang="lang", text="text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ids = [r[0] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(max_rows).collect()]
    chosen = rows.filter(F.col("doc_id").isin([i for i in ids if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in ids)))
    chosen = chosen.withColumn("h", F.xxhash64("text", "lang")).orderBy("doc_id", "h").limit(max_rows).drop("h")  # ids may be repeated
    got = chosen.toArrow() if ids else None
    texts = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "lang", "text")), strict=True), key=str) if got else []
    model = fit([(t, y) for _, y, t in texts])
    release_memory()
    return model


def _labelled(model: Model | None, texts: list[str | None]):
    """Words and posteriors of each text, some texts at a time."""
    at = 0
    while at < len(texts):
        held, size = [], 0
        while at < len(texts) and (not held or size < 200_000):
            held.append(words_of(texts[at]) if model else [])
            size, at = size + len(held[-1]), at + 1
        number: dict[str, int] = {}
        ids = [[number.setdefault(w, len(number)) for w in x] for x in held]
        lens = np.array([len(x) for x in held])
        post = marginals(model.emissions(list(number))[np.concatenate([np.array(x, np.int64) for x in ids])], lens, model.moves) if number else np.empty((0, 1))
        yield from zip(held, np.split(post, np.cumsum(lens)[:-1]), strict=True)


def _predict(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for b in batches:
            labels, scores = [], []
            for words, post in _labelled(model, b.column(2).to_pylist()):
                share = post.mean(0) if words else None
                labels.append(model.labels[int(share.argmax())] if words else "und")
                scores.append(float(min(1.0, share.max())) if words else 0.0)
            yield batch(schema, b.column(0), b.column(1), labels, scores)

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = columns(docs, doc_id=F.col("doc_id").cast("bigint"), held_out=held_out(), text="text")
    return by_arrow(read, _predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _words(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string()))])

    def run(batches):
        model = shared.value
        for b in batches:
            words, langs = [], []
            for own, post in _labelled(model, b.column(1).to_pylist()):
                words.append(own)
                langs.append([model.labels[i] for i in post.argmax(1).tolist()] if own else [])
            yield batch(schema, b.column(0), words, langs)

    return run


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, words, langs): the label with the largest posterior for each word of a code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return by_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")), _words(shared), "doc_id bigint, words array<string>, langs array<string>")


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, fit_on(docs))


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose words are told with at least that confidence: the mean of each word's
    largest posterior, so that texts in several languages stay. Texts without words go; without a fitted model all stay."""
    if model is None or not len(model.lexicon):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            found = [bool(words) and post.max(1).mean() >= least for words, post in _labelled(shared.value, b.column(at).to_pylist())]
            yield b.filter(pa.array(found))

    return by_arrow(docs, run, docs.schema)
