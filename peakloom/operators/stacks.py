"""Many factorisations of the same rows at once: seeds, ranks, halves and held-out folds side by side.

A round is one pass over the rows for all fits that aren't finished: each batch updates its rows' weights for every fit and gives the
fit's two sums of k by columns; one aggregate adds them up, and only those sums (fits x k x columns, whatever the rows) are gathered.
Finished fits leave the pass. Rows are (key, x), and (key, x, part) where fits are of parts of the rows. Where asked for, rows of few
cells go whole to a task for each fit, which runs all its rounds there.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .factor import EPS, _hidden, _masked_rows, _start, spread_rows, update_rows
from .stats import auc


@dataclass(frozen=True)
class Fit:
    """One fit of a stack: its rank, the seed of its start, the fold of entries that it doesn't see, the part of the rows that it is of."""

    k: int
    seed: int = 0
    fold: int | None = None
    part: int | None = None


@dataclass
class Fitted:
    """H, the errors by round, why the fit is no use, where it isn't ('diverged', 'collapsed', or 'empty' of no rows), and whether it starts from rows far
    apart, for no random start was sound."""

    h: np.ndarray
    errors: list[float]
    fault: str | None = None
    apart: bool = False


#: Cells of rows that one task may hold.
AT_ONCE = 100_000


def _own(f: pd.DataFrame, x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """A fit's rows of a batch, and their keys."""
    keys = f["key"].to_numpy()
    if fit.part is None:
        return x, keys
    mine = f["part"].to_numpy() == fit.part
    return x[mine], keys[mine]


def _sums(fit: Fit, h: np.ndarray, own: np.ndarray, keys: np.ndarray, share: float, l2: float) -> tuple[np.ndarray, float]:
    """A fit's sums over some of its rows, flat, its error and that of zero at the end; and the largest value that a fold's fit foretells."""
    if fit.fold is None:
        w = update_rows(own, h)
        sums, error, zero, most = (w.T @ own, w.T @ w), ((own - w @ h) ** 2).sum(), 0.0, 0.0
    else:
        seen = ~_hidden(keys, own.shape[1], share, fit.fold)
        w = _masked_rows(own, seen, h, l2)
        fitted = w @ h
        sums = w.T @ (seen * own), w.T @ (seen * fitted)
        error, zero, most = (seen * (own - fitted) ** 2).sum(), (seen * own**2).sum(), fitted.max()
    return np.concatenate([*(s.ravel() for s in sums), [error, zero]]), float(most)


def _round_sums(live: dict[int, tuple[Fit, np.ndarray]], share: float, l2: float):
    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["x"].to_numpy())
            for n, (fit, h) in live.items():
                own, keys = _own(f, x, fit)
                if not len(own):
                    continue
                s, most = _sums(fit, h, own, keys, share, l2)
                yield pd.DataFrame({"fit": [n], "s": [s], "most": [most]})

    return run


def _fit_at_once(rows: DataFrame, begun: dict[Fit, np.ndarray], top: dict[Fit, float], n_columns: int, rounds: int, share: float, l2: float) -> dict[Fit, Fitted]:
    """All rounds of each fit in one task, which holds all rows."""
    fits = list(begun)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        n = int(f["fit"].iloc[0])
        f, fit, now = f.sort_values("key"), fits[n], Fitted(begun[fits[n]], [])
        own, keys = _own(f, np.stack(f["x"].to_numpy()), fit)
        for _ in range(rounds if len(own) else 0):
            s, most = _sums(fit, now.h, own, keys, share, l2)
            if _step(fit, now, s, most, top[fit], n_columns, l2):
                break
        return pd.DataFrame({"fit": [n], "h": [now.h.ravel()], "errors": [now.errors], "fault": [now.fault]})

    each = rows.select("key", "x", "part", F.explode(F.sequence(F.lit(0), F.lit(len(fits) - 1))).alias("fit")).repartition(min(len(fits), 64), "fit")
    got = each.groupBy("fit").applyInPandas(run, "fit int, h array<double>, errors array<double>, fault string").collect()
    return {fits[r["fit"]]: Fitted(np.array(r["h"]).reshape(fits[r["fit"]].k, n_columns), list(r["errors"]), r["fault"]) for r in got}


def _fit_once(rows: DataFrame, fits: Sequence[Fit], n_columns: int, rounds: int, share: float, l2: float, starts: dict[Fit, np.ndarray] | None = None, at_once: bool = False) -> dict[Fit, Fitted]:
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    of = {r["part"]: (r["n"], r["s"], r["top"]) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(total).alias("s"), F.max(F.array_max("x")).alias("top")).collect()}
    out, top = {}, {}
    for fit in fits:
        mine = [v for p, v in of.items() if fit.part is None or p == fit.part]
        n, s = sum(v[0] for v in mine), sum(v[1] for v in mine)
        top[fit] = max((v[2] for v in mine), default=0.0)
        given = (starts or {}).get(fit)
        out[fit] = Fitted(_start(n_columns, fit.k, float(np.sqrt((s / n / n_columns if n else 0.0) / fit.k)), fit.seed) if given is None else given, [])
    live, begun = list(fits), {fit: now.h for fit, now in out.items()}
    if at_once:
        out |= _fit_at_once(rows, begun, top, n_columns, max(1, rounds), share, l2)
        live = []
    for _ in range(max(1, rounds)):
        if not live:
            break
        run = _round_sums({i: (fit, out[fit].h) for i, fit in enumerate(live)}, share, l2)
        parts = rows.mapInPandas(run, "fit int, s array<double>, most double")
        got = parts.select("fit", "most", F.posexplode("s").alias("i", "v")).groupBy("fit", "i").agg(F.sum("v").alias("v"), F.max("most").alias("most")).toPandas()
        by, going = dict(list(got.sort_values("i").groupby("fit"))), []
        for i, fit in enumerate(live):
            if i not in by:  # no rows
                continue
            if not _step(fit, out[fit], by[i]["v"].to_numpy(), float(by[i]["most"].max()), top[fit], n_columns, l2):
                going.append(fit)
        live = going
    if not rounds:  # the starts as they are, with their errors
        for fit, h in begun.items():
            out[fit].h = h
    return out


def _step(fit: Fit, now: Fitted, flat: np.ndarray, most: float, top: float, n_columns: int, l2: float) -> bool:
    """One round's sums into H; whether the fit is finished."""
    a, rest = flat[: fit.k * n_columns].reshape(fit.k, n_columns), flat[fit.k * n_columns : -2]
    error, zero = flat[-2:]
    if fit.fold is None:
        now.errors.append(float(np.sqrt(error)))
        now.h = now.h * a / (rest.reshape(fit.k, fit.k) @ now.h + EPS)
        return len(now.errors) > 1 and now.errors[-2] - now.errors[-1] < 1e-5 * now.errors[0]
    last = now.errors[-1] if now.errors else None
    if last is not None and (error >= zero or most > 10 * top):
        now.fault = "diverged"
        return True
    if last is not None and last - error < 1e-5 * zero:
        return True
    now.errors.append(float(error))
    now.h = now.h * (a + EPS) / (rest.reshape(fit.k, n_columns) + l2 * now.h + EPS)
    return False


def labels(rows: DataFrame, fitted: dict[Fit, np.ndarray], rounds: int = 100) -> DataFrame:
    """(fit, key, label): the component from 1 with the largest weight (weights scaled to sum 1) of each row in each fit of it; one pass. fit: the place
    in the order of the fits; a row of zeros is of component 1."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["x"].to_numpy())
            for n, (fit, h) in enumerate(fitted.items()):
                own, keys = _own(f, x, fit)
                if len(own):
                    yield pd.DataFrame({"fit": n, "key": keys, "label": update_rows(own, h, rounds=rounds).argmax(1) + 1})

    return rows.mapInPandas(run, "fit int, key bigint, label int")


def keyed(rows: DataFrame, row: str, part: str | None = None) -> DataFrame:
    """(key, x, part) of rows (row, x): what the passes read. key: a hash of the row's name, by which entries are hidden."""
    return rows.select(F.xxhash64(row).alias("key"), "x", (F.col(part).cast("int") if part else F.lit(None).cast("int")).alias("part"))


def stacked_nmf(rows: DataFrame, fits: Sequence[Fit], n_columns: int, rounds: int = 30, extra: int = 5, share: float = 0.1, l2: float = 0.0, tries: int = 1, apart: bool = True, at_once: int = 0) -> dict[Fit, Fitted]:
    """All fits of keyed rows, a pass a round, or (rows of up to `at_once` cells) each in one task. Those of all entries that collapse (an error that isn't
    finite, or a component that is no row's largest), and those of a fold that diverge (no better than zero, or over ten times the data), start again from
    `extra` other seeds, all of them side by side, of which the first sound one counts; `tries` times, other seeds each time.
    Rows that are nearly alike (many counts behind each) let many random starts collapse. With `apart`, fits of all entries that collapse from each then
    start from rows far apart (a fold's don't, for these rows hold what it hides), and end earlier, after half as many rounds each time, while a
    component still loses its rows on the way; where it loses them in the first round, those rows are the fit. Such a fit is marked `apart`: it says little of how
    independent starts agree, for starts from rows far apart are much alike. Without `apart` no such fit is given.
    What isn't mended then stays in the result with its fault. Components of fits of all entries come by the rows that they win.

    Without rows a fit keeps its start, without errors, and is 'empty'. Each fit is what block_nmf and block_masked_nmf give for its rank, seed and fold."""
    rows = written(rows, "stacked")  # read each round: files of few rows go to few tasks
    out: dict[Fit, Fitted] = {}
    todo = list(fits)
    few = bool(at_once) and rows.count() * n_columns <= at_once
    for again in range(1 + tries + (rounds.bit_length() + 1 if apart else 0)):
        starts: dict[Fit, np.ndarray] = {}
        tried = {fit: [fit] for fit in todo}
        if 1 <= again <= tries:
            tried = {fit: [replace(fit, seed=100_000 * again + fit.seed * extra + i) for i in range(extra)] for fit in todo}
        elif again:
            tried = {fit: [fit] for fit in todo if fit.fold is None}
            starts = {fit: h for fit, h in zip(tried, spread_rows(rows, [(fit.k, fit.seed, fit.part) for fit in tried]), strict=True) if len(h)} if tried else {}
        every = [now for some in tried.values() for now in some]
        if not every:
            continue
        got = _fit_once(rows, every, n_columns, rounds >> max(0, again - tries - 1), share, l2, starts, few)
        whole = {now: got[now].h for now in every if now.fold is None and got[now].errors}
        won = np.zeros((len(whole), max((f.k for f in whole), default=0)), np.int64)
        for r in labels(rows, whole).groupBy("fit", "label").count().collect() if whole else ():
            won[r["fit"], r["label"] - 1] = r["count"]
        for n, now in enumerate(whole):
            one, wins = got[now], won[n, : now.k]
            if not np.isfinite(one.errors[-1]) or not wins.all():
                one.fault = "collapsed"
            else:
                one.h = one.h[np.argsort(-wins, kind="stable")]
        for now in every:
            got[now].apart = now in starts
            if not got[now].errors and not got[now].fault:
                got[now].fault = "empty"
        for fit, some in tried.items():
            out[fit] = next((got[now] for now in some if not got[now].fault), got[some[-1]])
        todo = [fit for fit in todo if out[fit].fault not in (None, "empty")]
        if not todo:
            break
    return out


def sound(fitted: dict[Fit, Fitted]) -> dict[Fit, np.ndarray]:
    """The H of each fit; a fit that no seed could mend, or of no rows, is an error."""
    for fit, one in fitted.items():
        if one.fault == "empty":
            raise RuntimeError(f"{fit} has no rows")
        if one.fault:
            raise RuntimeError(f"{fit} {one.fault} from every seed")
    return {fit: one.h for fit, one in fitted.items()}


def held_out(rows: DataFrame, fitted: dict[Fit, np.ndarray], share: float = 0.1, l2: float = 0.0) -> DataFrame:
    """(k, fold, score, value) of all entries that the fits' folds hide, in one pass: what each fit foretells, and what is there."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["x"].to_numpy())
            for fit, h in fitted.items():
                own, keys = _own(f, x, fit)
                hidden = _hidden(keys, own.shape[1], share, fit.fold)
                if hidden.any():
                    yield pd.DataFrame({"k": fit.k, "fold": fit.fold, "score": (_masked_rows(own, ~hidden, h, l2) @ h)[hidden], "value": own[hidden].astype(float)})

    return rows.mapInPandas(run, "k int, fold int, score double, value double")


def held_out_scores(rows: DataFrame, ranks: Sequence[int], n_columns: int, folds: int = 3, rounds: int = 60, share: float = 0.1, l2: float = 0.0) -> DataFrame:
    """(k, auc, auc_sd, rmse, rmse_sd, folds): mean and deviation over folds of the area under the curve (entries over 0 against the others)
    and of the root mean square error, on entries that the fits haven't seen, of keyed rows. A fold without a fit at a rank doesn't count there;
    one whose hidden entries are all over 0, or none, has no area, and auc is null where no fold has one. Fewer than 3 ranks are refused, for no optimum could show."""
    if len(ranks) < 3:
        raise ValueError("three ranks at least")
    fits = [Fit(k, f, fold=f) for k in ranks for f in range(folds)]
    good = {fit: one.h for fit, one in stacked_nmf(rows, fits, n_columns, rounds, share=share, l2=l2).items() if not one.fault}
    entries = written(held_out(rows, good, share, l2).withColumn("y", (F.col("value") > 0).cast("int")), "held_out")
    error = F.sqrt(F.avg((F.col("score") - F.col("value")) ** 2))
    by_fold = entries.groupBy("k", "fold").agg(error.alias("rmse")).join(auc(entries, "score", "y", ["k", "fold"]), ["k", "fold"])
    spread = [f(c).alias(n) for c in ("auc", "rmse") for f, n in ((F.avg, c), (F.stddev_pop, f"{c}_sd"))]
    return by_fold.groupBy("k").agg(*spread, F.count("*").cast("int").alias("folds"))
