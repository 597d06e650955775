"""Factorisation of sparse non-negative matrices (long tables of row, column, value), and what is derived from the factors.

The rows' factor W stays distributed: a round's only exchange is the sum, per batch, of two small products (k x columns and
k x k). H is of fixed size, as are the seeds' collections of it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def _start(n_columns: int, k: int, scale: float, seed: int) -> np.ndarray:
    return scale * np.random.default_rng(seed).random((k, n_columns)) + EPS


def update_rows(x: np.ndarray, h: np.ndarray, w: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Multiplicative updates of the rows' factor for a fixed H."""
    xh, hh = x @ h.T, h @ h.T
    w = np.full((len(x), len(h)), max(EPS, np.sqrt(x.mean() / max(1, len(h))))) if w is None else w
    for _ in range(rounds):
        w = w * xh / (w @ hh + EPS)
    return w


def nmf(x: np.ndarray, k: int, seed: int = 0, rounds: int = 300, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Frobenius NMF by multiplicative updates from a random start; (W, H, error)."""
    rng = np.random.default_rng(seed)
    scale = np.sqrt(x.mean() / k)
    w, h = scale * rng.random((len(x), k)) + EPS, scale * rng.random((k, x.shape[1])) + EPS
    first = last = np.linalg.norm(x - w @ h)
    for i in range(1, rounds + 1):
        w *= x @ h.T / (w @ (h @ h.T) + EPS)
        h *= w.T @ x / (w.T @ w @ h + EPS)
        if i % 10 == 0:
            error = np.linalg.norm(x - w @ h)
            if (last - error) / first < tolerance:
                break
            last = error
    return w, h, float(np.linalg.norm(x - w @ h))


def collapsed(w: np.ndarray, error: float) -> bool:
    """Whether the error isn't finite, or some component is no row's largest."""
    return not np.isfinite(error) or len(np.unique(w.argmax(1))) < w.shape[1]


def guarded_nmf(x: np.ndarray, k: int, seed: int = 0, extra: int = 5, **settings) -> tuple[np.ndarray, np.ndarray, float]:
    """A fit that isn't collapsed; else from other seeds, and an error at the end. Components by rows won, the most first."""
    for s in [seed, *(100_000 + seed * extra + i for i in range(extra))]:
        w, h, error = nmf(x, k, s, **settings)
        if not collapsed(w, error):
            order = np.argsort(-np.bincount(w.argmax(1), minlength=k), kind="stable")
            return w[:, order], h[order], error
    raise RuntimeError(f"every fit at rank {k} collapsed")


def vectors(entries: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """(row, x): each row's values over the given columns, 0 where none. One exchange by row, with partial sums."""
    place = F.create_map(*[e for i, c in enumerate(columns) for e in (F.lit(c), F.lit(i))])
    cells = entries.withColumn("__i", place[F.col(column)]).filter("__i is not null").groupBy(row, "__i").agg(F.sum(value).cast("double").alias("__v"))
    got = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("__m"))
    return got.select(row, F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.coalesce(F.col("__m")[i], F.lit(0.0))).alias("x"))


def spread_rows(rows: DataFrame, fits: list[tuple[int, int, int | None]]) -> list[np.ndarray]:
    """A start for each (k, seed, part): k rows' directions far apart, of keyed rows (key, x, part). The first is the farthest from a row that
    the seed picks, each next one the farthest from all before; ties go by key. A pass for each of them gathers one row a fit."""
    picked: list[list[np.ndarray]] = [[] for _ in fits]
    for nth in range(max(k for k, _, _ in fits) + 1):

        def far(frames: Iterable[pd.DataFrame], nth=nth):
            for f in frames:
                if not len(f):
                    continue
                x, keys, parts = np.stack(f["x"].to_numpy()).astype(float), f["key"].to_numpy(), f["part"].to_numpy()
                size = np.linalg.norm(x, axis=1)
                for n, (k, seed, part) in enumerate(fits):
                    own = np.flatnonzero((size > 0) & (True if part is None else parts == part))
                    if nth > k or not len(own):
                        continue
                    u = x[own] / size[own, None]
                    # the row by which the first is found isn't one of the start
                    apart = np.min([((u - c) ** 2).sum(1) for c in (picked[n] if nth < 2 else picked[n][1:])], 0) if nth else np.random.default_rng(seed).random() - (keys[own] / 2.0**63 + 1) / 2
                    best = np.lexsort((keys[own], -np.abs(apart)))[0]
                    yield pd.DataFrame({"fit": [n], "d": [float(abs(apart[best]))], "key": [-int(keys[own][best])], "u": [u[best]]})

        got = rows.mapInPandas(far, "fit int, d double, key bigint, u array<double>").groupBy("fit").agg(F.max(F.struct("d", "key", "u")).alias("m")).collect()
        for r in got:
            picked[r["fit"]].append(np.array(r["m"]["u"]))
    # a little of everything, for a product with zero stays zero
    return [np.array(p[1:]) + 0.01 * np.mean(p[1:]) if len(p) == k + 1 else np.zeros((0, 0)) for p, (k, _, _) in zip(picked, fits, strict=True)]


def block_nmf(rows: DataFrame, row: str, k: int, n_columns: int, seed: int = 0, rounds: int = 30, extra: int = 5) -> tuple[np.ndarray, list[float]]:
    """H and the errors by round, for rows (row, x) of any number, from a fit that isn't collapsed; else from other seeds, then from rows
    far apart, half as many rounds each time while one is, down to none, and an error at the end. Components come by the rows that they win, the most first."""
    for s, most in [*((s, rounds) for s in [seed, *(100_000 + seed * extra + i for i in range(extra))]), *((None, rounds >> i) for i in range(rounds.bit_length() + 1))]:
        start = spread_rows(rows.select(F.xxhash64(row).alias("key"), "x", F.lit(None).cast("int").alias("part")), [(k, seed, None)])[0] if s is None else None
        h, errors = _block_fit(rows, k, n_columns, s or 0, most, start)
        if not errors:
            return h, errors
        won = dict(map(tuple, transform(rows, row, h).groupBy("dominant").count().collect()))
        if np.isfinite(errors[-1]) and all(won.get(c + 1) for c in range(k)):
            return h[np.argsort([-won[c + 1] for c in range(k)], kind="stable")], errors
    raise RuntimeError(f"every fit at rank {k} collapsed")


def _block_fit(rows: DataFrame, k: int, n_columns: int, seed: int, rounds: int, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Each round fits the rows' weights to H where they lie and sums W'X and W'W over batches; only those sums are gathered."""
    mean = rows.select(F.avg(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)) / n_columns).first()[0] or 0.0
    h, errors = _start(n_columns, k, float(np.sqrt(mean / k)), seed) if start is None or not len(start) else start, []
    rows = rows.select("x").persist()  # read each round; what a lost executor held is made again from its source
    schema = "wx array<double>, ww array<double>, e double"
    for _ in range(max(1, rounds)):

        def sums(frames: Iterable[pd.DataFrame], h=h):
            for f in frames:
                if len(f):
                    x = np.stack(f["x"].to_numpy())
                    w = update_rows(x, h)
                    yield pd.DataFrame({"wx": [(w.T @ x).ravel()], "ww": [(w.T @ w).ravel()], "e": [float(((x - w @ h) ** 2).sum())]})

        parts = rows.mapInPandas(sums, schema)
        both = parts.select(F.posexplode(F.concat("wx", "ww", F.array("e"))).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        if not both:
            return h, errors
        flat = np.array([v for _, v in sorted(map(tuple, both))])
        wx, ww = flat[: k * n_columns].reshape(k, n_columns), flat[k * n_columns : -1].reshape(k, k)
        errors.append(float(np.sqrt(flat[-1])))
        if not rounds:  # the start as it is
            break
        h = h * wx / (ww @ h + EPS)
        if len(errors) > 1 and errors[-2] - errors[-1] < 1e-5 * errors[0]:
            break
    rows.unpersist()
    return h, errors


def transform(rows: DataFrame, row: str, h: np.ndarray) -> DataFrame:
    """(row, weights, dominant from 1, dominant_weight) of rows (row, x): weights scaled to sum 1; a row of zeros has none."""
    kind = dict(rows.dtypes)[row]

    def fit(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({row: f[row], "w": list(update_rows(np.stack(f["x"].to_numpy()), h, rounds=100))})

    w = rows.select(row, "x").mapInPandas(fit, f"`{row}` {kind}, w array<double>")
    total = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    scaled = w.select(row, F.transform("w", lambda v: F.coalesce(F.try_divide(v, total), F.lit(0.0))).alias("weights"))
    return scaled.withColumn("dominant", F.array_position("weights", F.array_max("weights")).cast("int")).withColumn("dominant_weight", F.array_max("weights"))


def top_columns(h: np.ndarray, columns: list, n: int) -> list[tuple[int, int, object, float]]:
    """(component from 1, rank from 1, column, loading), the largest first, ties by column order."""
    return [(c + 1, r + 1, columns[i], float(row[i])) for c, row in enumerate(h) for r, i in enumerate(np.argsort(-row, kind="stable")[:n])]


def best_match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each component of a the cosine with the most similar of b."""
    from .cluster import cosine

    return cosine(a, b).max(1)


def medoid(fits: list[np.ndarray], method: str = "best") -> int:
    """The fit most like all others: by mean best-match cosine, or (method 'assignment') by one-to-one matching."""
    from .cluster import assign, cosine

    def alike(a, b):
        if method == "best":
            return best_match(a, b).mean()
        c = cosine(a, b)
        return float(np.mean([c[i, j] for i, j in assign(1 - c)]))

    return int(np.argmax([np.mean([alike(a, b) for j, b in enumerate(fits) if j != i] or [1.0]) for i, a in enumerate(fits)]))


def stability(fits: list[np.ndarray], at: int) -> list[dict]:
    """For each component of the fit chosen: median and least best-match cosine over the other fits, and how often it reaches .9 and .8."""
    s = np.stack([best_match(fits[at], f) for i, f in enumerate(fits) if i != at])
    return [{"component": c + 1, "median": float(np.median(s[:, c])), "least": float(s[:, c].min()), "at_90": float((s[:, c] >= 0.9).mean()), "at_80": float((s[:, c] >= 0.8).mean())} for c in range(s.shape[1])]


def masked_nmf(x: np.ndarray, seen: np.ndarray, k: int, seed: int = 0, rounds: int = 200, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """NMF of the entries seen. W's columns are scaled to 1 each round; a fit worse than zero, or that exceeds ten times the data, is refused."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((len(x), k)) + EPS, rng.random((k, x.shape[1])) + EPS
    held = x * seen
    for _ in range(rounds):
        w *= (held @ h.T + EPS) / ((seen * (w @ h)) @ h.T + l2 * w + EPS)
        h *= (w.T @ held + EPS) / (w.T @ (seen * (w @ h)) + l2 * h + EPS)
        size = np.maximum(np.linalg.norm(w, axis=0), EPS)
        w, h = w / size, h * size[:, None]
    if np.linalg.norm(seen * (x - w @ h)) >= np.linalg.norm(held) or (w @ h).max() > 10 * x.max():
        raise RuntimeError("the masked fit diverged")
    return w, h


def rank_auc(score: np.ndarray, positive: np.ndarray) -> float:
    """Ties count half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    first, last = np.searchsorted(s, s, "left"), np.searchsorted(s, s, "right")
    rank = np.empty(len(s))
    rank[order] = (first + last + 1) / 2
    n = positive.sum()
    return float((rank[positive].sum() - n * (n + 1) / 2) / (n * (len(s) - n)))


def held_out_scores(x: np.ndarray, ranks: list[int], folds: int = 3, share: float = 0.1, seed: int = 0, l2: float = 0.0) -> list[dict]:
    """Mean and deviation of AUC and RMSE on held-out entries for each rank; fewer than 3 ranks are refused, for no optimum could show."""
    if len(ranks) < 3:
        raise ValueError("three ranks at least")
    out = []
    for k in ranks:
        auc, rmse = [], []
        for f in range(folds):
            hidden = np.random.default_rng(seed * 1000 + f).random(x.shape) < share
            try:
                w, h = masked_nmf(x, (~hidden).astype(float), k, f, l2=l2)
            except RuntimeError:  # this fold has no fit at this rank; the others count
                continue
            got, true = (w @ h)[hidden], x[hidden]
            rmse.append(float(np.sqrt(((got - true) ** 2).mean())))
            if 0 < (true > 0).sum() < len(true):
                auc.append(rank_auc(got, true > 0))
        out.append({"k": k, "auc": float(np.mean(auc or [np.nan])), "auc_sd": float(np.std(auc or [np.nan])), "rmse": float(np.mean(rmse or [np.nan])), "rmse_sd": float(np.std(rmse or [np.nan])), "folds": len(rmse)})
    return out


def program_summary(dominant: DataFrame, component: str, weight: str, *medians: str) -> DataFrame:
    """By component: rows, truncated medians of the columns named, mean weight to four digits."""
    return dominant.groupBy(component).agg(F.count("*").alias("n"), *[F.median(m).cast("int").alias(f"median_{m}") for m in medians], F.bround(F.avg(weight), 4).alias("mean_weight"))


def matched_enrichment(df: DataFrame, stratum: str, complexity: str, foreground: str, bins: int = 8) -> DataFrame:
    """log2 enrichment of the foreground in each stratum, within bins of complexity at its quantiles, weighted by the bins' foreground."""
    from .stats import quantiles

    names = {f"q{i}": i / bins for i in range(1, bins)}
    edges = quantiles(df, [], complexity, **names).select(F.array(*names).alias("__e"))
    bin_ = F.size(F.filter("__e", lambda e: F.col(complexity) > e))
    one = F.sum(F.col(foreground).cast("bigint"))
    cells = df.crossJoin(edges).groupBy(stratum, bin_.alias("__bin")).agg(one.alias("f"), F.count("*").alias("a"))
    by_bin = Window.partitionBy("__bin")
    cells = cells.withColumn("of_f", F.sum("f").over(by_bin)).withColumn("of_a", F.sum("a").over(by_bin))
    ratio = F.log2((F.try_divide("f", "of_f") + 1e-9) / (F.try_divide("a", "of_a") + 1e-9))
    return cells.filter("of_f > 0").groupBy(stratum).agg((F.sum(F.col("of_f") * ratio) / F.sum("of_f")).alias("log2fe"))


def class_coherence(top: DataFrame, classes: DataFrame, group: str, item: str, kind: str, weight: str) -> DataFrame:
    """For each group the loading-weighted mean cosine of its items' class counts, over pairs of items.

    top: (group, item, weight), a few items each; classes: (item, kind) rows to count."""
    counts = classes.groupBy(item, kind).agg(F.count("*").cast("double").alias("c"))
    norm = counts.groupBy(item).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    unit = counts.join(norm, item).select(item, kind, (F.col("c") / F.col("norm")).alias("u"))
    dots = unit.withColumnsRenamed({item: "a", "u": "ua"}).join(unit.withColumnsRenamed({item: "b", "u": "ub"}), kind).groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cos"))
    l, r = (top.select(group, F.col(item).alias(n), F.col(weight).alias(f"w{n}")) for n in ("a", "b"))
    pairs = l.join(r, group).filter("a < b").join(dots, ["a", "b"], "left")
    w = F.col("wa") * F.col("wb")
    return pairs.groupBy(group).agg(F.try_divide(F.sum(w * F.coalesce("cos", F.lit(0.0))), F.sum(w)).alias("coherence"))


def class_entropy(classes: DataFrame, item: str, kind: str) -> DataFrame:
    """(item, n, entropy): natural-log entropy of each item's class counts."""
    counts = classes.groupBy(item, kind).agg(F.count("*").cast("double").alias("c"))
    total = counts.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return total.select(item, F.col("n").cast("bigint").alias("n"), (F.log("n") - F.col("s") / F.col("n")).alias("entropy"))


def raw_enrichment(df: DataFrame, stratum: str, foreground: str) -> DataFrame:
    """log2 enrichment of the foreground in each stratum, without regard to complexity: its share of the foreground over its share of all."""
    one = F.sum(F.col(foreground).cast("bigint"))
    both = df.agg(one.alias("of_f"), F.count("*").alias("of_a"))
    cells = df.groupBy(stratum).agg(one.alias("f"), F.count("*").alias("a")).crossJoin(both)  # one row
    return cells.select(stratum, F.log2((F.try_divide("f", "of_f") + 1e-9) / (F.try_divide("a", "of_a") + 1e-9)).alias("log2fe"))


def _hidden(keys: np.ndarray, n_columns: int, share: float, fold: int) -> np.ndarray:
    """Marks of the entries held out in a fold, by a hash of it, the row's key and the column (splitmix64's finaliser, whose shifts and
    factors are fixed values), so that every pass and every machine hides the same ones."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(n_columns, dtype=np.uint64) + np.uint64(1 + 1_000_003 * fold)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64 < share


def _masked_rows(x: np.ndarray, seen: np.ndarray, h: np.ndarray, l2: float, rounds: int = 60) -> np.ndarray:
    """Rows' factor for a fixed H, of the entries seen."""
    w, held = np.full((len(x), len(h)), max(EPS, float(np.sqrt(x.mean() / len(h))))), (x * seen) @ h.T + EPS
    for _ in range(rounds):
        w = w * held / ((seen * (w @ h)) @ h.T + l2 * w + EPS)
    return w


def block_masked_nmf(rows: DataFrame, row: str, k: int, n_columns: int, fold: int, share: float = 0.1, seed: int = 0, rounds: int = 30, l2: float = 0.0) -> np.ndarray:
    """H of the entries that a fold doesn't hide, for rows (row, x) of any number: as block_nmf, a round gathers two sums of k by columns.
    A fit that is no better than zero, or that exceeds ten times the data, is refused."""
    keyed = rows.select(F.xxhash64(row).alias("key"), "x")
    mean, top = keyed.select(F.avg(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)) / n_columns, F.max(F.array_max("x"))).first()
    h, last = _start(n_columns, k, float(np.sqrt((mean or 0.0) / k)), seed), None
    for _ in range(rounds):

        def sums(frames: Iterable[pd.DataFrame], h=h):
            for f in frames:
                if len(f):
                    x = np.stack(f["x"].to_numpy())
                    seen = ~_hidden(f["key"].to_numpy(), n_columns, share, fold)
                    w = _masked_rows(x, seen, h, l2)
                    fit = w @ h
                    yield pd.DataFrame({"s": [np.concatenate([(w.T @ (seen * x)).ravel(), (w.T @ (seen * fit)).ravel(), [(seen * (x - fit) ** 2).sum(), (seen * x**2).sum()]])], "most": [float(fit.max())]})

        parts = keyed.mapInPandas(sums, "s array<double>, most double")
        got = parts.select(F.posexplode("s").alias("i", "v"), "most").groupBy("i").agg(F.sum("v").alias("v"), F.max("most").alias("most")).collect()
        if not got:
            return h
        flat, most = np.array([r.v for r in sorted(got, key=lambda r: r.i)]), max(r.most for r in got)
        over, under = flat[: k * n_columns].reshape(k, -1), flat[k * n_columns : -2].reshape(k, -1)
        error, zero = flat[-2:]
        if last is not None and (error >= zero or most > 10 * top):
            raise RuntimeError("the masked fit diverged")
        if last is not None and last - error < 1e-5 * zero:
            break
        h, last = h * (over + EPS) / (under + l2 * h + EPS), error
    return h


def held_out_entries(rows: DataFrame, row: str, h: np.ndarray, fold: int, share: float = 0.1, l2: float = 0.0) -> DataFrame:
    """(score, value) of every entry that the fold hides: what the fit foretells, and what is there."""
    n_columns = h.shape[1]

    def score(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy())
                hidden = _hidden(f["key"].to_numpy(), n_columns, share, fold)
                fit = _masked_rows(x, ~hidden, h, l2) @ h
                yield pd.DataFrame({"score": fit[hidden], "value": x[hidden].astype(float)})

    return rows.select(F.xxhash64(row).alias("key"), "x").mapInPandas(score, "score double, value double")
