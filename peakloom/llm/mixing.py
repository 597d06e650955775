"""Soft-membership mixing: document rates whose expected domain token totals match targets.

1. A softmax classifier of word presence, fitted on the driver on a bounded sample of the labels table (whole texts, as the
   hashes of their distinct words), gives every document a posterior over the domains (narrow; the model's size is fixed).
2. Distributed projected gradient least squares: with n the tokens, p the posteriors, T the targets and S all tokens,
   minimise sum_k w_k (sum n p_k r - T_k)^2 / (2 S^2) + mu sum n (r - 1)^2 / (2 S) over rates r >= 0, each rate's step
   scaled by its document's tokens, with Nesterov momentum. w_k is 1, but for domains under SMALL of all tokens SMALL
   divided by their share, so that mu holds a rare domain no more than one of that share. Rounds end when the projected
   gradient moves no domain by more than the tolerance of its own tokens. A round is one narrow pass over (tokens, posteriors) that sums a few
   numbers per batch and a native aggregate over those; only the domains' totals reach the driver. Rates aren't stored
   between rounds: each is a function of its document's posteriors and the rounds' totals so far, so that nothing grows
   and a lost executor costs one task of one round.

Edge cases: null or empty texts have no tokens, the prior as posterior and rate 1; without labels all posteriors are
equal; null and repeated ids stay, a row each; repeated labels: the largest counts; labels of unknown documents are
ignored; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, by_arrow, columns, discard, materialise, pieces_of, release_memory, word_hashes
from .decontaminate import _FOLD

DOMAINS = ("high", "low", "toxic")
PIECE = 4 << 20  # bytes of text taken at a time
LEAST_DOCS = 8
LEAST_Z = 5.0
#: Share of the tokens, or of the sampled labels, as which a rarer domain counts.
SMALL = 0.1
#: ASCII signs stay, all else parts them: runs of signs tell of tables, mark-up and noise.
_SIGNS = bytes(c if 33 <= c <= 126 and not chr(c).isalnum() else 32 for c in range(256))


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct words and runs of signs, by document, and each document's number of words."""
    raw = [b.as_buffer().to_pybytes() if b.is_valid else b"" for b in texts]
    words, at = word_hashes(pa.array([b.translate(_FOLD) for b in raw], pa.binary()).cast(pa.string()))
    signs, of_signs = word_hashes(pa.array([b.translate(_SIGNS) for b in raw], pa.binary()).cast(pa.string()))
    doc = np.concatenate([np.repeat(np.arange(len(raw)), np.diff(x)) for x in (at, of_signs)])
    both = np.concatenate([words, signs])
    order = np.lexsort((both, doc))
    doc, both = doc[order], both[order]
    new = np.concatenate([[True], (both[1:] != both[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[new], both[new], np.diff(at)


@dataclass
class Classifier:
    """Logistic regression of presences in the vocabulary (sorted hashes)."""

    vocabulary: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)  # (vocabulary, domains)
    bias: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of the domains and numbers of words, of texts some megabytes at a time."""
        parts = [self._posteriors(texts.slice(a, z - a)) for a, z in pieces_of(texts, PIECE)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])

    def _posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        doc, hashes, words = presence(texts)
        score = np.repeat(self.bias[None], len(texts), 0)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == hashes
            doc, at = doc[known], at[known]
            score += np.stack([np.bincount(doc, self.weights[at, k], len(texts)) for k in range(len(self.bias))], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), words


def fit(features: list[np.ndarray], domains: list[int], n_domains: int, rounds: int = 300, l2: float = 0.1) -> Classifier:
    """features: each text's distinct hashes, as of presence(). Full-batch gradient ascent with momentum on the penalised
    likelihood. Features are words in LEAST_DOCS texts or more, whose number in some domain is LEAST_Z deviations above what
    chance gives: labels may be noisy, and thousands of words that say nothing would learn the noise."""
    counts = np.bincount(np.array(domains, np.int64), minlength=n_domains)
    bias = np.log((counts + 1) / (counts.sum() + n_domains))
    if not features:
        return Classifier(np.empty(0, np.uint64), np.zeros((0, n_domains)), np.zeros(n_domains))
    doc, hashes = np.repeat(np.arange(len(features)), [len(x) for x in features]), np.concatenate(features)
    vocabulary, at, docs_with = np.unique(hashes, return_inverse=True, return_counts=True)
    y = np.eye(n_domains)[domains]
    seen = np.stack([np.bincount(at, y[doc, k], len(vocabulary)) for k in range(n_domains)], 1)
    share = y.mean(0)
    z = (seen - docs_with[:, None] * share) / np.sqrt(docs_with[:, None] * share * (1 - share) + 1e-9)
    often = (docs_with >= LEAST_DOCS) & (z.max(1) >= LEAST_Z)
    doc, at = doc[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    vocabulary, docs_with = vocabulary[often], docs_with[often]
    weights, moved = np.zeros((len(vocabulary), n_domains)), np.zeros((len(vocabulary), n_domains))
    step = 1.0 / (docs_with[:, None] * 0.25 + l2)  # a bound of each weight's own curvature
    for _ in range(rounds):
        score = np.stack([np.bincount(doc, weights[at, k], len(features)) for k in range(n_domains)], 1) + bias
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = np.stack([np.bincount(at, (p - y)[doc, k], len(vocabulary)) for k in range(n_domains)], 1) + l2 * weights
        moved = 0.8 * moved - 0.02 * step * slope
        weights += moved
        bias = bias - 0.5 * (p - y).mean(0)
    return Classifier(vocabulary, weights, bias)


def domain_of(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Number of the label's domain in DOMAINS."""
    return F.when(F.col(toxic) > 0, 2).when(F.col(quality) > 0, 0).when(F.col(quality).isNotNull() | F.col(toxic).isNotNull(), 1)


def _sample(told: DataFrame, max_rows: int) -> list:
    """The first rows by hash; where a domain has under SMALL of them, its own first ones instead of the others' last."""
    least = int(max_rows * SMALL)
    first = told.orderBy("h", "doc_id").limit(max_rows).collect()
    held = {k: [r for r in first if r.domain == k] for k in range(len(DOMAINS))}
    if len(first) < max_rows or all(len(rows) >= least for rows in held.values()):
        return first
    for k in (k for k, rows in held.items() if len(rows) < least):
        held[k] = told.filter(F.col("domain") == k).orderBy("h", "doc_id").limit(least).collect()
    for _ in range(sum(map(len, held.values())) - max_rows):
        max(held.values(), key=len).pop()
    return [r for rows in held.values() for r in rows]


def _present(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("domain", pa.int32()), ("hashes", pa.binary())])
    for b in (x for x in batches if x.num_rows):
        for a, z in pieces_of(b.column(2), PIECE):
            doc, hashes, _ = presence(b.column(2).slice(a, z - a))
            own = np.split(hashes, np.searchsorted(doc, np.arange(1, z - a)))
            yield batch(schema, b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), [x.tobytes() for x in own])


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Classifier:
    """Fits on at most max_rows labelled texts (chosen by hash of the id), whole ones. Of a domain that would have under
    SMALL of them, up to that many are taken; the bias then says the domains' shares of all labels."""
    told = columns(labels, doc_id=F.col("doc_id").cast("bigint"), domain=domain_of()).filter("doc_id is not null and domain is not null")
    told = told.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    docs = columns(docs, doc_id=F.col("doc_id").cast("bigint"), text="text").filter("text is not null")
    told = told.join(docs.select("doc_id"), "doc_id", "left_semi")
    told = materialise(told.select("doc_id", "domain", F.xxhash64("doc_id").alias("h")), "told")
    chosen = _sample(told, max_rows)
    if not chosen:
        return fit([], [], len(DOMAINS))
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.domain) for r in chosen], "doc_id bigint, domain int")
    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "domain", "text")
    rows = by_arrow(rows, _present, "doc_id bigint, domain int, hashes binary").orderBy("doc_id", "hashes").limit(max_rows)  # ids may be repeated
    got = sorted(rows.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["hashes"]))
    model = fit([np.frombuffer(r["hashes"], np.uint64) for r in got], [r["domain"] for r in got], len(DOMAINS))
    of_all = {r["domain"]: r["count"] for r in told.groupBy("domain").count().collect()}
    discard(told)
    shares = [(np.array(c) + 1) / (sum(c) + len(DOMAINS)) for c in ([of_all.get(k, 0) for k in range(len(DOMAINS))], np.bincount([r["domain"] for r in got], minlength=len(DOMAINS)))]
    model.bias = model.bias + np.log(shares[0] / shares[1])
    release_memory()
    return model


def _posteriors(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("posteriors", pa.list_(pa.float64()))])

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            p, words = shared.value.posteriors(b.column(1))
            yield batch(schema, b.column(0), words, pa.FixedSizeListArray.from_arrays(p.ravel(), p.shape[1]).cast(pa.list_(pa.float64())))

    return run


def domain_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posteriors) of every document; tokens are words of letters and digits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return by_arrow(columns(docs, doc_id=F.col("doc_id").cast("bigint"), text="text"), _posteriors(shared), "doc_id bigint, n_tokens bigint, posteriors array<double>")


@dataclass(frozen=True)
class Descent:
    """The rounds' gradients of the domains, from which any document's rate follows."""

    mu: float
    step: float
    slopes: tuple = ()

    def _play(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rates, the point where the next gradient is taken, what the last projected step moved) of documents with posteriors p."""
        rate, ahead, moved, t = np.ones(len(p)), np.ones(len(p)), np.zeros(len(p)), 1.0
        for slope in self.slopes:
            new = np.maximum(0.0, ahead - self.step * (p @ np.array(slope) + self.mu * (ahead - 1)))
            moved = np.abs(new - np.maximum(0.0, ahead))
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, rate, t = new + (t - 1) / t_new * (new - rate), new, t_new
        return rate, ahead, moved

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self._play(p)[0]

    def ahead(self, p: np.ndarray) -> np.ndarray:
        return self._play(p)[1]


def _p(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _totals(descent: Descent):
    schema = pa.schema([("domain", pa.int32()), ("ahead", pa.float64()), ("now", pa.float64()), ("moved", pa.float64())])

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            p, n = _p(b.column(1)), b.column(0).to_numpy()
            rate, ahead, moved = descent._play(p)
            yield batch(schema, np.arange(p.shape[1], dtype=np.int32), (n * ahead) @ p, (n * rate) @ p, (n * moved) @ p)

    return run


def _sums(table: DataFrame, descent: Descent) -> np.ndarray:
    """Rows of the domains: expected tokens at the next point, at the rates, and moved by the last step."""
    sums = by_arrow(table, _totals(descent), "domain int, ahead double, now double, moved double").groupBy("domain").agg(*[F.sum(c).alias(c) for c in ("ahead", "now", "moved")])
    return np.array([(r.ahead, r.now, r.moved) for r in sorted(sums.collect(), key=lambda r: r.domain)])


def fit_rates(table: DataFrame, weights: dict[int, float] | None, mu: float = 0.01, rounds: int = 60, tolerance: float = 1e-4) -> Descent:
    """table: (n_tokens, posteriors). weights: target shares by domain number; None: the present totals, without toxic ones."""
    first = _sums(table, Descent(mu, 1.0))
    if not len(first) or not first[:, 1].sum():
        return Descent(mu, 1.0)
    have = first[:, 1]
    total, k = have.sum(), len(have)
    clean = have * (np.arange(k) != DOMAINS.index("toxic"))
    if weights is None:
        targets = clean
    else:
        targets = np.array([weights.get(i, 0.0) for i in range(k)])
        targets = targets / targets.sum() * clean.sum()
    own = np.maximum(np.maximum(have, targets), 1e-12 * total)  # a domain's gap counts beside its own tokens
    scale = np.maximum(1.0, SMALL * total / own)
    descent = Descent(mu, 1 / ((scale * have).sum() / total + mu))  # the trace bounds the curvature
    for i in range(rounds):
        ahead, _, moved = _sums(table, descent).T
        if i and (moved < tolerance * own).all():
            break
        descent = Descent(mu, descent.step, (*descent.slopes, tuple((scale * (ahead - targets) / total).tolist())))
    return descent


def _rated(descent: Descent):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("posteriors", pa.list_(pa.float64())), ("rate", pa.float64())])

    def run(batches):
        for b in (x for x in batches if x.num_rows):
            rate = descent.rates(_p(b.column(2)))
            rate[b.column(1).to_numpy() == 0] = 1.0
            yield batch(schema, b.column(0), b.column(1), b.column(2).cast(pa.list_(pa.float64())), rate)

    return run


def mix_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, model: Classifier | None = None) -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, copies) of every document; copies is the rate rounded, halves up."""
    table = materialise(domain_posteriors(docs, model or fit_on(docs, labels)), "posteriors")
    descent = fit_rates(table.filter("n_tokens > 0").select("n_tokens", "posteriors"), weights and {DOMAINS.index(k): w for k, w in weights.items()})
    rated = by_arrow(table, _rated(descent), "doc_id bigint, n_tokens bigint, posteriors array<double>, rate double")
    return rated.withColumn("copies", F.floor(F.col("rate") + 0.5).cast("int"))


def keep_mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents, each as often as its rounded rate says, with all their columns. The rate is found again from the
    document itself, so that texts are neither shuffled nor joined by an id that may be repeated or null."""
    model = fit_on(docs, labels)
    table = materialise(domain_posteriors(docs, model), "posteriors")
    descent = fit_rates(table.filter("n_tokens > 0").select("n_tokens", "posteriors"), weights and {DOMAINS.index(k): w for k, w in weights.items()})
    shared = docs.sparkSession.sparkContext.broadcast((model, descent))
    at = docs.columns.index("text")

    def run(batches):
        model, descent = shared.value
        for b in (x for x in batches if x.num_rows):
            p, words = model.posteriors(b.column(at))
            copies = np.where(words == 0, 1, np.floor(descent.rates(p) + 0.5)).astype(np.int64)
            yield b.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    return by_arrow(docs, run, docs.schema)
