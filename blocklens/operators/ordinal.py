"""Threshold models for ordered classes by Newton steps: all thresholds (AT), immediate (IT), squared error (SE)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, checkpointed, summed
from . import rowwise

MODELS = ("AT", "IT", "SE")


def threshold_weights(model: str, k: int) -> np.ndarray:
    """Weight of threshold t for class y: ``w[y, t]``."""
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    y, t = np.arange(k)[:, None], np.arange(k - 1)[None, :]
    if model == "AT":
        return np.ones((k, k - 1))
    if model == "IT":
        return ((t == y) | (t == y - 1)).astype(float)
    return np.where(t >= y, 2 * (t - y) + 1, 2 * (y - t) - 1).astype(float)


def _start(p: int, k: int) -> np.ndarray:
    return np.concatenate([np.zeros(p), np.linspace(-1, 1, k - 1) if k > 2 else np.zeros(k - 1)])


def _losses(z: np.ndarray, rank: np.ndarray, omega: np.ndarray, vs: list[np.ndarray]) -> np.ndarray:
    """The rows' weighted logistic loss at each of some points (coefficients, then thresholds)."""
    p, k = z.shape[1], omega.shape[1] + 1
    sign, weight, out = np.where(np.arange(k - 1)[None, :] >= rank[:, None], 1.0, -1.0), omega[rank], []
    for v in vs:
        out.append(float((weight * np.logaddexp(0, -sign * (v[p:][None, :] - (z @ v[:p])[:, None]))).sum()))
    return np.array(out)


def _slopes(z: np.ndarray, rank: np.ndarray, omega: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The rows' part of the Hessian, with the gradient as its last column."""
    p, k = z.shape[1], omega.shape[1] + 1
    g, h = _residuals(z, rank, omega, v)
    out = np.zeros((p + k - 1, p + k))
    out[:, -1] = np.concatenate([-z.T @ g.sum(1), g.sum(0)])
    out[:p, :p] = (z * h.sum(1)[:, None]).T @ z
    out[:p, p:-1] = -z.T @ h
    out[p:, :p] = out[:p, p:-1].T
    out[p:, p:-1] = np.diag(h.sum(0))
    return out


def _gradient(z: np.ndarray, rank: np.ndarray, omega: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The rows' part of the gradient, and of the Hessian's diagonal."""
    g, h = _residuals(z, rank, omega, v)
    return np.stack([np.concatenate([-z.T @ g.sum(1), g.sum(0)]), np.concatenate([(z * z).T @ h.sum(1), h.sum(0)])])


def _product(z: np.ndarray, rank: np.ndarray, omega: np.ndarray, point: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rows' part of the Hessian at a point times a direction, without the Hessian."""
    v, d = point
    p = z.shape[1]
    u = _residuals(z, rank, omega, v)[1] * (d[p:][None, :] - (z @ d[:p])[:, None])
    return np.concatenate([-z.T @ u.sum(1), u.sum(0)])


def _residuals(z: np.ndarray, rank: np.ndarray, omega: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of each row's loss at each threshold."""
    p, k = z.shape[1], omega.shape[1] + 1
    sign = np.where(np.arange(k - 1)[None, :] >= rank[:, None], 1.0, -1.0)
    m = sign * (v[p:][None, :] - (z @ v[:p])[:, None])
    e = 1 / (1 + np.exp(np.clip(m, -500, 500)))
    return -omega[rank] * e * sign, omega[rank] * e * (1 - e)


#: Parts of a Newton step that are tried, all of them in one pass.
PARTS = 0.5 ** np.arange(0, 34, 3)
#: Features up to which Hessians are summed; more take conjugate gradients, whose memory is linear in the features, to
#: this part of the gradient, in so many products at most.
MAX_DENSE, CG_TOLERANCE, CG_ROUNDS = 500, 1e-10, 500


def _keep(v: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """The ridge's part of the Hessian's diagonal; thresholds have next to none."""
    return np.concatenate([np.full(p, alpha), np.full(len(v) - p, 1e-12)])


def _dense_steps(vs: list, p: int, alpha: float, slopes: Callable) -> list:
    """Newton steps from summed Hessians; None for points of None."""
    out = []
    for v, t in zip(vs, slopes(vs)):
        out.append(None if v is None else np.linalg.solve(t[:, :-1] + np.diag(_keep(v, p, alpha)), t[:, -1] + np.concatenate([alpha * v[:p], np.zeros(len(v) - p)])))
    return out


def _conjugate_steps(vs: list, p: int, alpha: float, gradients: Callable, products: Callable) -> list:
    """The same steps by conjugate gradients, scaled by the diagonal: each round takes one product of every open problem."""
    state: list = []
    for v, t in zip(vs, gradients(vs)):
        if v is None:
            state.append(None)
            continue
        keep, r = _keep(v, p, alpha), t[0] + np.concatenate([alpha * v[:p], np.zeros(len(v) - p)])
        by = t[1] + keep
        d = r / by
        state.append({"x": np.zeros(len(v)), "r": r, "d": d, "by": by, "keep": keep, "rz": float(r @ d), "least": CG_TOLERANCE * np.linalg.norm(r), "open": bool(r.any())})
    for _ in range(CG_ROUNDS):
        asked = [(v, s["d"]) if s is not None and s["open"] else None for v, s in zip(vs, state)]
        if not any(a is not None for a in asked):
            break
        for s, a, hd in zip(state, asked, products(asked)):
            if a is None:
                continue
            hd = np.ravel(hd) + s["keep"] * s["d"]
            size = s["rz"] / float(s["d"] @ hd)
            s["x"], s["r"] = s["x"] + size * s["d"], s["r"] - size * hd
            z = s["r"] / s["by"]
            rz = float(s["r"] @ z)
            s["d"], s["rz"] = z + rz / s["rz"] * s["d"], rz
            s["open"] = bool(np.linalg.norm(s["r"]) > s["least"])
    return [None if s is None else s["x"] for s in state]


def _newton(starts: list[np.ndarray], p: int, alpha: float, steps_of: Callable, losses: Callable, rounds: int = 200) -> list[np.ndarray]:
    """Minimise several problems side by side: ``steps_of(points)`` and ``losses(lists of points)`` go over each one's rows;
    a point of None is done."""
    vs, open_ = [v.copy() for v in starts], [len(v) > p for v in starts]

    def ridge(v: np.ndarray) -> float:
        return alpha / 2 * float(v[:p] @ v[:p])

    for _ in range(rounds):
        if not any(open_):
            break
        steps = steps_of([v if o else None for v, o in zip(vs, open_)])
        tries = [[v, *[v - c * step for c in PARTS]] if o else None for v, o, step in zip(vs, open_, steps)]
        for i, (own, loss) in enumerate(zip(tries, losses(tries))):
            if own is None:
                continue
            total = loss + np.array([ridge(v) for v in own])
            better = np.flatnonzero(total[1:] <= total[0])
            k = int(better[0]) if len(better) else len(PARTS) - 1
            vs[i] = own[k + 1] if len(better) else own[0]
            open_[i] = bool(len(better)) and float(np.abs(PARTS[k] * steps[i]).max()) >= 1e-10
    return vs


class Ordinal:
    """``w``: a coefficient for each feature, brought to [0, 1]; ``theta``: the sorted thresholds between ``classes``."""

    def __init__(self, model: str = "AT", alpha: float = 1.0):
        self.model, self.alpha = model, alpha
        threshold_weights(model, 2)

    def _set(self, low: np.ndarray, high: np.ndarray, classes: np.ndarray, v: np.ndarray) -> Ordinal:
        p = len(low)
        self.low, self.span, self.classes = low, np.where(high > low, high - low, 1.0), classes
        self.w, self.theta = v[:p], np.sort(v[p:])
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ordinal:
        """Features are first brought to [0, 1] by these rows; a constant one has range 1."""
        low, high, classes = x.min(axis=0), x.max(axis=0), np.unique(y)
        z, rank, p, k = (x - low) / np.where(high > low, high - low, 1.0), np.searchsorted(classes, y), x.shape[1], len(classes)
        omega, basis = threshold_weights(self.model, k), None
        if p > len(z):  # the coefficients are a sum of the rows: look for them along an orthonormal basis of these
            basis = np.linalg.qr(z.T)[0]
            z = z @ basis
        own = z.shape[1]
        found = _newton([_start(own, k)], own, self.alpha, lambda vs: _dense_steps(vs, own, self.alpha, lambda at: [_slopes(z, rank, omega, at[0])]), lambda tries: [_losses(z, rank, omega, tries[0])])[0]
        return self._set(low, high, classes, found if basis is None else np.concatenate([basis @ found[:own], found[own:]]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = ((x - self.low) / self.span) @ self.w
        return self.classes[(self.theta[None, :] < f[:, None]).sum(axis=1)]

    def table(self, names: list[str]) -> list[tuple]:
        """``feature, coefficient, absolute coefficient``, largest first."""
        return sorted(((n, float(c), abs(float(c))) for n, c in zip(names, self.w)), key=lambda r: (-r[2], r[0]))


@dataclass
class Problem:
    """One fit over rows of ``number, y, x, fold``: without the fold ``out``, features brought to [0, 1] by ``low`` and
    ``high``, ranks of the rows by ``rank(y, number)``."""

    out: int
    low: np.ndarray
    high: np.ndarray
    omega: np.ndarray
    rank: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / np.where(self.high > self.low, self.high - self.low, 1.0)


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    number, y, x, fold = batch.columns
    return number.to_numpy(), y.to_numpy(), np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1), fold.to_numpy()


def _over_rows(data: DataFrame, points: list, problems: list[Problem], kernel: Callable) -> list:
    """``kernel`` at each problem's point (those of None are done), summed over its rows in one pass."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            number, y, x, fold = _batch(batch)
            for k, (point, job) in enumerate(zip(points, problems)):
                own = fold != job.out if job.out >= 0 else np.ones(len(y), bool)
                if point is not None and own.any():
                    totals[k] = totals.get(k, 0.0) + kernel(job.scaled(x[own]), job.rank(y[own], number[own]), job.omega, point)
        for k, t in totals.items():
            t = np.atleast_2d(t)
            yield array_rows({"k": np.array([k]), "rows": np.array([len(t)])}, [t.ravel()])

    found = summed(data.mapInArrow(sums, "k long, rows long, v array<double>"), "k", "rows").toArrow().combine_chunks()  # by features, not rows
    out: list = [None] * len(points)
    for k, rows, v in zip(found.column("k").to_pylist(), found.column("rows").to_pylist(), found.column("v")):
        out[k] = v.values.to_numpy(zero_copy_only=False).reshape(rows, -1)
    return out


def _ranges(data: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Each fold's least and largest value of each feature: two arrays leave a task for each fold that it meets."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                _, _, x, fold = _batch(batch)
                for k in np.unique(fold).tolist():
                    own = np.stack([x[fold == k].min(axis=0), -x[fold == k].max(axis=0)])
                    found[k] = np.minimum(found[k], own) if k in found else own
        for k, own in found.items():
            yield array_rows({"fold": np.full(2, k), "i": np.arange(2)}, list(own))

    low, high = {}, {}
    for r in summed(data.mapInArrow(ends, "fold long, i long, v array<double>"), "fold", "i", by=np.minimum).collect():  # a few times the features
        (high if r.i else low)[r.fold] = -np.array(r.v) if r.i else np.array(r.v)
    return low, high


def _minimise(data: DataFrame, problems: list[Problem], p: int, alpha: float) -> list[np.ndarray]:
    def of(kernel: Callable) -> Callable:
        return lambda points: _over_rows(data, points, problems, kernel)

    def steps_of(points: list) -> list:
        if p <= MAX_DENSE:
            return _dense_steps(points, p, alpha, of(_slopes))
        return _conjugate_steps(points, p, alpha, of(_gradient), of(_product))

    return _newton([_start(p, job.omega.shape[0]) for job in problems], p, alpha, steps_of, lambda tries: [None if t is None else t[0] for t in of(_losses)(tries)])


def fit_rows(rows: DataFrame, models: tuple[str, ...] = MODELS, alpha: float = 1.0, cv: int = 0) -> dict[tuple[str, int], Ordinal]:
    """Fits on rows of ``y, x`` (and ``fold``) where they are: ``(model, fold left out) -> Ordinal``; fold -1 leaves out none.

    Two passes a Newton step serve all models and folds: one sums gradients and Hessians in tasks, one the losses of all
    parts of the step. Beyond MAX_DENSE features no Hessian is summed: the step comes from its products with directions,
    one pass each, so tasks and driver hold vectors. Only these sums come to the driver; the rows are checkpointed first.
    """
    data = checkpointed(rows.select(F.lit(0).cast("long").alias("number"), F.col("y").cast("long").alias("y"), F.col("x").cast("array<double>").alias("x"), (F.col("fold") if cv else F.lit(-1)).cast("long").alias("fold")))
    labels = data.groupBy("fold").agg(F.collect_set("y").alias("ys")).collect()
    low, high = _ranges(data)
    p, every, jobs = len(next(iter(low.values()))), sorted(low), []
    for model in models:
        for out in range(cv) if cv else (-1,):
            seen = [f for f in every if not cv or f != out]
            classes = np.array(sorted({y for r in labels if r.fold in seen for y in r.ys}))
            a, b = np.min([low[f] for f in seen], axis=0), np.max([high[f] for f in seen], axis=0)
            jobs.append((model, out, classes, Problem(out, a, b, threshold_weights(model, len(classes)), lambda y, _, classes=classes: np.searchsorted(classes, y))))
    found = _minimise(data, [job[3] for job in jobs], p, alpha)
    return {(model, out): Ordinal(model, alpha)._set(job.low, job.high, classes, v) for (model, out, classes, job), v in zip(jobs, found)}


def permutation_test(rows: DataFrame, model: str = "AT", alpha: float = 1.0, n_permutations: int = 1000, seed: int = 42, min_perms: int = 50, check_every: int = 25, cv: int = 5) -> dict:
    """Cross-validated accuracy of rows of ``sample_id, y, x`` against labels in random order, where the rows are.

    As for components (see ``rowwise``), permuted labels follow from the rows' numbers, and folds are those of the true
    labels. All permutations and folds of a round are minimised side by side, so a Newton step takes two passes in all.
    """
    known = rowwise.number_rows(rows.withColumn("grp", F.col("y").cast("long")))
    edges, classes, n = known.edges, np.array(known.classes), known.n
    data = checkpointed(known.rows.select("number", F.col("grp").alias("y"), "x", rowwise.fold_of(known, cv).cast("long").alias("fold")))
    low, high = _ranges(data)
    p, keys, omega = len(next(iter(low.values()))), np.random.RandomState(seed).randint(0, 1 << 31, max(1, n_permutations)), threshold_weights(model, len(classes))

    def ranks(which: int) -> Callable:
        return lambda y, number: rowwise.permuted(edges, number, None if which < 0 else int(keys[which]))

    def accuracies(which: list[int]) -> list[float]:
        jobs = []
        for w in which:
            for out in range(cv):
                seen = [f for f in low if f != out]
                jobs.append(Problem(out, np.min([low[f] for f in seen], axis=0), np.max([high[f] for f in seen], axis=0), omega, ranks(w)))
        found = [(job, v[:p], np.sort(v[p:])) for job, v in zip(jobs, _minimise(data, jobs, p, alpha))]

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = np.zeros(len(which), "int64")
            for batch in batches:
                if batch.num_rows:
                    number, y, x, fold = _batch(batch)
                    for k, (job, w, theta) in enumerate(found):
                        own = fold == job.out
                        hits[k // cv] += int(((theta[None, :] < (job.scaled(x[own]) @ w)[:, None]).sum(axis=1) == job.rank(y[own], number[own])).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(which))), pa.array(hits)], names=["b", "hits"])

        got = {r.b: r.hits for r in data.mapInArrow(compare, "b long, hits long").groupBy("b").agg(F.sum("hits").alias("hits")).collect()}  # a number each
        return [got[b] / n for b in range(len(which))]

    most = max(1, rowwise.PASS_CELLS // (cv * (min(p, MAX_DENSE) + 1) * (p + len(classes))))
    return rowwise.rounds(lambda which: [a for k in range(0, len(which), most) for a in accuracies(which[k : k + most])], n_permutations, min_perms, check_every)


def predict_rows(rows: DataFrame, model: Ordinal, out: str = "predicted") -> DataFrame:
    """``rows`` with the class predicted from ``x``, by expressions where the rows are."""
    scale = model.w / model.span
    products = F.zip_with("x", F.lit([float(v) for v in scale]), lambda a, b: a * b)
    score = F.aggregate(products, F.lit(-float(scale @ model.low)), lambda s, v: s + v)
    below = sum((F.when(F.lit(float(t)) < score, 1).otherwise(0) for t in model.theta), F.lit(0))
    return rows.withColumn(out, F.element_at(F.lit([int(c) for c in model.classes]), below + 1))


def mean_coefficients(fitted: dict[tuple[str, int], Ordinal]) -> list[tuple]:
    """``model, f, coefficient``: the mean over the folds' fits of ``fit_rows``."""
    return [(m, f, float(w)) for m in MODELS if any(k[0] == m for k in fitted) for f, w in enumerate(np.mean([o.w for k, o in fitted.items() if k[0] == m], axis=0))]


def cross_validate(rows: DataFrame, models: tuple[str, ...] = MODELS, alpha: float = 1.0, cv: int = 5) -> DataFrame:
    """``model, sample_id, y, fold, predicted``: folds by the hashed sample id, each predicted by a fit without it."""
    dealt = with_folds(rows, cv)
    return predict_folds(dealt, fit_rows(dealt, models, alpha, cv))


def with_folds(rows: DataFrame, cv: int = 5) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64("sample_id"), F.lit(cv)).cast("int"))


def predict_folds(dealt: DataFrame, fits: dict[tuple[str, int], Ordinal]) -> DataFrame:
    result = None
    for (model, fold), fitted in fits.items():
        one = predict_rows(dealt.where(F.col("fold") == fold), fitted).select(F.lit(model).alias("model"), "sample_id", "y", "fold", "predicted")
        result = one if result is None else result.unionByName(one)
    return result
