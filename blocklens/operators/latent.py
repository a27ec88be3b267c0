"""Sparse discriminant latent components of one block (SPLSDA) and of several (DIABLO) from sufficient statistics.

Every vector of the iteration is a linear image of X or Y, so centred ``C = X'X``, ``S = X'Y`` and ``G = Y'Y`` are all
that a fit needs; they are gathered in one distributed pass whose shuffle is bounded by the square of the features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, summed

#: Features of all blocks together, and cells of all folds' matrices, at most: C is held on the driver.
MAX_FEATURES, MAX_CELLS = 4_000, 64_000_000


def keep_largest(w: np.ndarray, k: int | None) -> np.ndarray:
    """The ``k`` largest by size, rescaled to length 1; of equal ones those that come first."""
    if k is None or k >= len(w):
        return w
    out = np.zeros_like(w)
    top = np.argsort(-np.abs(w), kind="stable")[:k]
    out[top] = w[top]
    n = np.linalg.norm(out)
    return out / n if n > 0 else out


@dataclass
class Moments:
    """Raw sums over samples; ``y`` is one column for each class in sorted order."""

    n: float
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    x: np.ndarray
    y: np.ndarray
    classes: list

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, classes: list | None = None) -> Moments:
        classes = sorted(set(y)) if classes is None else classes
        hot = (np.asarray(y)[:, None] == np.array(classes, dtype=object)[None, :]).astype(float)
        return cls(len(x), x.T @ x, x.T @ hot, hot.T @ hot, x.sum(0), hot.sum(0), classes)

    def without(self, x: np.ndarray, y: np.ndarray) -> Moments:
        """The sums without some rows, given as their features and one-hot labels."""
        return Moments(self.n - len(x), self.xx - x.T @ x, self.xy - x.T @ y, self.yy - y.T @ y, self.x - x.sum(0), self.y - y.sum(0), self.classes)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.x + other.x, self.y + other.y, self.classes)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy, self.x - other.x, self.y - other.y, self.classes)

    def zero(self) -> Moments:
        return Moments(0.0, *(np.zeros_like(v) for v in (self.xx, self.xy, self.yy, self.x, self.y)), self.classes)

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = max(self.n, 1)
        return self.xx - np.outer(self.x, self.x) / m, self.xy - np.outer(self.x, self.y) / m, self.yy - np.outer(self.y, self.y) / m


def block_rows(obs: DataFrame) -> DataFrame:
    """``sample_id, grp, x``: each sample's values in the order of (layer, f_ord)."""
    cells = F.array_sort(F.collect_list(F.struct("layer", "f_ord", "value")))
    return obs.groupBy("sample_id", "grp").agg(F.transform(cells, lambda c: c["value"]).alias("x"))


def gather_moments(rows: DataFrame, max_features: int = MAX_FEATURES) -> Moments:
    """One pass over ``grp, x``: each task sums its own rows, the sums are added up by matrix row."""
    return gather_fold_moments(rows.withColumn("fold", F.lit(0)), max_features)[0]


def gather_fold_moments(rows: DataFrame, max_features: int = MAX_FEATURES) -> dict[int, Moments]:
    """The moments of each ``fold`` (a few numbers), all in one pass; a task holds one matrix for each fold it meets."""
    classes = [r[0] for r in rows.select("grp").distinct().orderBy("grp").collect()]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, fold = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1), batch.column(2).to_numpy()
            if x.shape[1] > max_features:
                raise ValueError(f"more than {max_features} features")
            hot = (np.array(batch.column(0).to_pylist(), object)[:, None] == np.array(classes, object)[None, :]).astype(float)
            z = np.hstack([x, hot, np.ones((len(x), 1))])
            for k in np.unique(fold):
                own = z[fold == k]
                totals[int(k)] = totals.get(int(k), 0.0) + own.T @ own
        for k, total in totals.items():
            for a in range(0, len(total), 64):
                own = range(a, min(a + 64, len(total)))
                yield array_rows({"fold": np.full(len(own), k), "i": np.array(own)}, [total[i, i:] for i in own])

    cells = rows.select("grp", "x", F.col("fold").cast("int").alias("fold")).mapInArrow(partial, "fold long, i long, v array<double>")
    parts: dict[int, dict[int, np.ndarray]] = {}
    for r in summed(cells, "fold", "i").toLocalIterator():  # half a matrix for each fold, at most MAX_CELLS in all
        parts.setdefault(r.fold, {})[r.i] = np.array(r.v)
        if len(parts) * len(parts[r.fold][min(parts[r.fold])]) ** 2 > MAX_CELLS:
            raise ValueError(f"more than {MAX_CELLS} cells in the folds' matrices")
    if not parts:
        raise ValueError("no samples")
    q, out = len(classes), {}
    for k, own in sorted(parts.items()):
        p = len(own)
        z = np.zeros((p, p))
        for i, v in own.items():
            z[i, i:] = z[i:, i] = v
        f = p - 1 - q
        out[int(k)] = Moments(z[-1, -1], z[:f, :f], z[:f, f : f + q], z[f : f + q, f : f + q], z[-1, :f], z[-1, f : f + q], classes)
    return out


def project(x: Column, directions: np.ndarray, mean: np.ndarray) -> Column:
    """``array<double>``: the centred ``x`` along each column of ``directions``, as one expression."""

    def along(d: np.ndarray) -> Column:
        products = F.zip_with(x, F.lit([float(v) for v in d]), lambda a, b: a * b)
        return F.aggregate(products, F.lit(-float(mean @ d)), lambda s, v: s + v)

    return F.array(*[along(d) for d in directions.T])


def predict_rows(rows: DataFrame, model: SPLSDA | DIABLO) -> DataFrame:
    """``rows`` with ``scores`` and ``predicted`` (the first class with the largest response), on the executors' JVMs."""
    scored = rows.withColumn("scores", project(F.col("x"), model.rotation, model.mean))
    response = F.array(*[F.aggregate(F.zip_with("scores", F.lit([float(v) for v in q]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for q in model.q])
    best = F.transform(F.array(response), lambda r: F.array_position(r, F.array_max(r)))[0]
    return scored.withColumn("predicted", F.element_at(F.lit(list(model.classes)), best.cast("int")))


def score_rows(rows: DataFrame, model: SPLSDA | DIABLO) -> DataFrame:
    """``accuracy, n``: the share of samples whose class is predicted, in one row."""
    return predict_rows(rows, model).agg(F.avg((F.col("grp") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def cross_validate(rows: DataFrame, fit: Callable[[Moments], SPLSDA | DIABLO], cv: int = 5) -> DataFrame:
    """``sample_id, grp, fold, predicted``: folds by the hashed sample id; each is predicted by a fit without it.

    Two passes, whatever the number of folds: one gathers all folds' moments, from whose total each fit leaves out its
    own; the other predicts. Nothing but the moments comes to the driver.
    """
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64("sample_id"), F.lit(cv)).cast("int"))
    parts = gather_fold_moments(dealt)
    out = None
    for k, own in parts.items():
        rest = sum((m for j, m in parts.items() if j != k), own.zero())
        one = predict_rows(dealt.where(F.col("fold") == k), fit(rest)).select("sample_id", "grp", "fold", "predicted")
        out = one if out is None else out.unionByName(one)
    return out


def _times(c: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.matmul(c, v[:, :, None])[:, :, 0]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` by the numbers ``b``; zeros where those aren't above 0."""
    return a * np.divide(1.0, b, out=np.zeros_like(b), where=b > 0)[:, None]


def _unit_largest(w: np.ndarray, k: int | None) -> np.ndarray:
    """``keep_largest`` of each row, scaled to length 1."""
    w = _over(w, np.linalg.norm(w, axis=1))
    if k is None or k >= w.shape[1]:
        return w
    out, top = np.zeros_like(w), np.argsort(-np.abs(w), axis=1, kind="stable")[:, :k]
    np.put_along_axis(out, top, np.take_along_axis(w, top, axis=1), axis=1)
    return _over(out, np.linalg.norm(out, axis=1))


def _settle(step: Callable, held: list[np.ndarray], state: list[np.ndarray], max_iter: int) -> list[np.ndarray]:
    """Each row's state by the step that ended it: ``step(held, state)`` gives the next states and which rows are done."""
    out, own = [v.copy() for v in state], np.arange(len(state[0]))
    live = np.ones(len(own), bool)
    for _ in range(max_iter):
        state, done = step(held, state)
        for o, v in zip(out, state):
            o[own[live]] = v[live]
        live &= ~done
        if not live.any():
            break
        if 2 * live.sum() <= len(live):
            held, state, own, live = [v[live] for v in held], [v[live] for v in state], own[live], live[live]
    return out


def _centred_without(m: Moments, x: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``centred`` of all but one row, for each of some rows, and the means."""
    n, mx, my = m.n - 1, m.x - x, m.y - hot
    outer = lambda a, b: a[:, :, None] * b[:, None, :]
    return m.xx - outer(x, x) - outer(mx, mx) / n, m.xy - outer(x, hot) - outer(mx, my) / n, m.yy - outer(hot, hot) - outer(my, my) / n, mx / n


def vip(w: np.ndarray, ss: np.ndarray) -> np.ndarray:
    """Importance of each feature; all 1 when nothing is explained."""
    return np.sqrt(len(w) * (w**2 @ ss) / ss.sum()) if ss.sum() > 0 else np.ones(len(w))


@dataclass
class SPLSDA:
    n_components: int = 2
    keep: int | list[int] | None = None
    max_iter: int = 500
    tol: float = 1e-6
    classes: list = field(default_factory=list)

    def _keep(self, n: int) -> list:
        if self.keep is None or isinstance(self.keep, int):
            return [self.keep] * n
        return [*self.keep, *[self.keep[-1]] * n][:n]

    def fit(self, m: Moments) -> SPLSDA:
        c, s, g = m.centred()
        self.classes, self.mean = m.classes, m.x / max(m.n, 1)
        h = int(min(self.n_components, m.n - 1, len(c)))
        keep, w_all, p_all, q_all, ss = self._keep(h), [], [], [], []
        for k in range(h):
            u, w, q = np.zeros(len(g)), np.zeros(len(c)), np.zeros(len(g))
            u[0] = 1.0
            tt = 0.0
            for _ in range(self.max_iter):
                w = s @ u
                n = np.linalg.norm(w)
                w = keep_largest(w / n if n > 0 else w, keep[k])
                tt = float(w @ c @ w)
                q = s.T @ w / tt if tt > 0 else np.zeros(len(g))
                qq = float(q @ q)
                new = q / qq if qq > 0 else u
                moved = new - u
                u = new
                if np.sqrt(max(0.0, float(moved @ g @ moved))) < self.tol:
                    break
            p = c @ w / tt if tt > 0 else np.zeros(len(c))
            c, s, g = c - tt * np.outer(p, p), s - tt * np.outer(p, q), g - tt * np.outer(q, q)
            w_all.append(w), p_all.append(p), q_all.append(q), ss.append(tt * float(q @ q))
        self.w, self.p, self.q = np.array(w_all).T, np.array(p_all).T, np.array(q_all).T
        self.vip = vip(self.w, np.array(ss))
        return self

    def coefficients_without(self, m: Moments, x: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of some rows, features x classes and the means of a fit on all other rows; all fits go on together."""
        c, s, g, mean = _centred_without(m, x, hot)
        h = int(min(self.n_components, m.n - 2, len(m.x)))
        keep, parts = self._keep(h), []

        def step(held, state):
            (c, s, g), u = held, state[0]
            w = _unit_largest(_times(s, u), keep[k])
            cw = _times(c, w)
            tt = _dot(w, cw)
            q = _over(_times(s.transpose(0, 2, 1), w), tt)
            qq = _dot(q, q)
            new = np.where(qq[:, None] > 0, _over(q, qq), u)
            moved = new - u
            return [new, w, cw, tt[:, None], q], np.sqrt(np.maximum(0.0, _dot(moved, _times(g, moved)))) < self.tol

        for k in range(h):
            u = np.zeros(hot.shape)
            u[:, 0] = 1.0
            _, w, cw, tt, q = _settle(step, [c, s, g], [u, np.zeros(x.shape), np.zeros(x.shape), np.zeros((len(x), 1)), np.zeros(hot.shape)], self.max_iter)
            p, by = _over(cw, tt[:, 0]), tt[:, :, None]
            c, s, g = c - by * p[:, :, None] * p[:, None, :], s - by * p[:, :, None] * q[:, None, :], g - by * q[:, :, None] * q[:, None, :]
            parts.append((w, p, q))
        w, p, q = (np.stack(v, axis=2) for v in zip(*parts))
        return w @ np.linalg.pinv(p.transpose(0, 2, 1) @ w) @ q.transpose(0, 2, 1), mean

    @property
    def rotation(self) -> np.ndarray:
        return self.w @ np.linalg.pinv(self.p.T @ self.w)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.rotation

    def predict(self, x: np.ndarray) -> list:
        """The class with the largest response; class means aren't added back, so small classes lose ties."""
        return [self.classes[i] for i in (self.scores(x) @ self.q.T).argmax(axis=1)]


def loadings(model: SPLSDA | DIABLO, names: list[str]) -> list[tuple]:
    """``feature, component, weight, loading`` for each feature and component, numbered from 1."""
    return [(n, h + 1, float(model.w[i, h]), float(model.p[i, h])) for i, n in enumerate(names) for h in range(model.w.shape[1])]


@dataclass
class DIABLO:
    """``sizes``: features of each block, in order; ``design``: weight between blocks, or the whole matrix with Y last."""

    sizes: list[int]
    n_components: int = 2
    keep: list | None = None
    design: float | np.ndarray = 0.1
    max_iter: int = 500
    tol: float = 1e-6

    def design_matrix(self) -> np.ndarray:
        """The given matrix, or the given weight between blocks and 1 with Y."""
        if not np.isscalar(self.design):
            return np.asarray(self.design, float)
        d = np.full((len(self.sizes) + 1, len(self.sizes) + 1), float(self.design))
        d[-1], d[:, -1] = 1.0, 1.0
        np.fill_diagonal(d, 0.0)
        return d

    def fit(self, m: Moments) -> DIABLO:
        c, s, g = m.centred()
        self.classes, self.mean = m.classes, m.x / max(m.n, 1)
        k_blocks, edges = len(self.sizes), np.cumsum([0, *self.sizes])
        part = [slice(edges[k], edges[k + 1]) for k in range(k_blocks)]
        d = self.design_matrix()
        h = int(min(self.n_components, m.n - 1))
        self.w, self.p, self.q = np.zeros((len(c), h)), np.zeros((len(c), h)), np.zeros((len(g), h))
        self.tt, self.block_corr = np.zeros((k_blocks, h)), np.eye(k_blocks)
        for comp in range(h):
            a, w = np.linalg.eigh(c)[1][:, -1], np.zeros(len(c))
            for _ in range(self.max_iter):
                at = [a] * k_blocks
                y = s.T @ a / max(float(a @ c @ a), 1e-10)
                for k in range(k_blocks):
                    v = sum((d[k, j] * at[j] for j in range(k_blocks) if j != k), np.zeros(len(c)))
                    u = d[k, -1] * y
                    if np.sqrt(max(0.0, float(v @ c @ v + 2 * v @ s @ u + u @ g @ u))) < 1e-10:
                        v, u = a, np.zeros(len(g))
                    x = c[part[k]] @ v + s[part[k]] @ u
                    n = np.linalg.norm(x)
                    x = keep_largest(x / n if n > 0 else x, self.keep[k][comp] if self.keep else None)
                    w[part[k]] = x
                    at[k] = np.zeros(len(c))
                    at[k][part[k]] = x
                new = sum(at) / k_blocks
                moved, size = new - a, np.sqrt(max(0.0, float(a @ c @ a)))
                a = new
                if np.sqrt(max(0.0, float(moved @ c @ moved))) < self.tol * size:
                    break
            each = np.zeros((len(c), k_blocks))
            loads = np.zeros((len(c), k_blocks))
            for k in range(k_blocks):
                each[part[k], k] = w[part[k]]
                tt = float(w[part[k]] @ c[part[k], part[k]] @ w[part[k]])
                self.tt[k, comp] = tt
                loads[part[k], k] = c[part[k], part[k]] @ w[part[k]] / tt if tt > 0 else 0.0
            if comp == 0:
                cross = each.T @ c @ each
                sd = np.sqrt(np.maximum(np.diag(cross), 1e-300))
                self.block_corr = cross / np.outer(sd, sd)
            ss = float(a @ c @ a)
            q, x, ce = s.T @ a / ss if ss > 0 else np.zeros(len(g)), c @ a, c @ each
            s = s - loads @ (each.T @ s) - np.outer(x, q) + loads @ np.outer(each.T @ x, q)
            c = c - loads @ ce.T - ce @ loads.T + loads @ (each.T @ ce) @ loads.T
            g = g - ss * np.outer(q, q)
            self.w[:, comp], self.p[:, comp], self.q[:, comp] = w, loads.sum(axis=1), q
        self.part = part
        return self

    def coefficients_without(self, m: Moments, x: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of some rows, features x classes and the means of a fit on all other rows; all fits go on together."""
        c, s, g, mean = _centred_without(m, x, hot)
        k_blocks, edges = len(self.sizes), np.cumsum([0, *self.sizes])
        part, d = [slice(edges[k], edges[k + 1]) for k in range(k_blocks)], self.design_matrix()
        h = int(min(self.n_components, m.n - 2))
        w_all, p_all, q_all = np.zeros((*x.shape, h)), np.zeros((*x.shape, h)), np.zeros((*hot.shape, h))

        def step(held, state):
            (c, s, g), (a, ca, _) = held, state
            at, size = [a] * k_blocks, _dot(a, ca)
            y = _times(s.transpose(0, 2, 1), a) / np.maximum(size, 1e-10)[:, None]
            for k in range(k_blocks):
                v = sum((d[k, j] * at[j] for j in range(k_blocks) if j != k), np.zeros(a.shape))
                u = d[k, -1] * y
                cv, su = _times(c, v), _times(s, u)
                none = np.sqrt(np.maximum(0.0, _dot(v, cv) + 2 * _dot(v, su) + _dot(u, _times(g, u)))) < 1e-10
                own = np.where(none[:, None], ca, cv + su)[:, part[k]]
                at[k] = np.zeros(a.shape)
                at[k][:, part[k]] = _unit_largest(own, self.keep[k][comp] if self.keep else None)
            w = sum(at)
            new = w / k_blocks
            cn, moved = _times(c, new), new - a
            return [new, cn, w], np.sqrt(np.maximum(0.0, _dot(moved, cn - ca))) < self.tol * np.sqrt(np.maximum(0.0, size))

        for comp in range(h):
            a = np.linalg.eigh(c)[1][:, :, -1]
            a, ca, w = _settle(step, [c, s, g], [a, _times(c, a), np.zeros(x.shape)], self.max_iter)
            each, loads = np.zeros((*x.shape, k_blocks)), np.zeros((*x.shape, k_blocks))
            for k, own in enumerate(part):
                each[:, own, k] = w[:, own]
                cw = _times(c[:, own, own], w[:, own])
                loads[:, own, k] = _over(cw, _dot(w[:, own], cw))
            ss, ce, turned = _dot(a, ca), c @ each, each.transpose(0, 2, 1)
            q = _over(_times(s.transpose(0, 2, 1), a), ss)
            s = s - loads @ (turned @ s) - ca[:, :, None] * q[:, None, :] + _times(loads, _times(turned, ca))[:, :, None] * q[:, None, :]
            back = loads.transpose(0, 2, 1)
            c = c - loads @ ce.transpose(0, 2, 1) - ce @ back + loads @ (turned @ ce) @ back
            g = g - ss[:, None, None] * q[:, :, None] * q[:, None, :]
            w_all[:, :, comp], p_all[:, :, comp], q_all[:, :, comp] = w, loads.sum(axis=2), q
        turns = [w_all[:, b] @ np.linalg.pinv(p_all[:, b].transpose(0, 2, 1) @ w_all[:, b]) for b in part]
        return np.concatenate(turns, axis=1) / k_blocks @ q_all.transpose(0, 2, 1), mean

    def vips(self) -> list[np.ndarray]:
        qq = (self.q**2).sum(axis=0)
        return [vip(self.w[b], self.tt[k] * qq) for k, b in enumerate(self.part)]

    def selected(self, block: int, comp: int) -> list[tuple[int, float]]:
        """Features of the block (by place) with a weight, largest first."""
        w = self.w[self.part[block], comp]
        return [(int(i), float(w[i])) for i in np.argsort(-np.abs(w), kind="stable") if w[i] != 0]

    @property
    def rotation(self) -> np.ndarray:
        """Directions of the blocks' mean scores, over all features."""
        return np.vstack([self.w[b] @ np.linalg.pinv(self.p[b].T @ self.w[b]) for b in self.part]) / len(self.part)

    def predict(self, x: np.ndarray) -> list:
        t = (x - self.mean) @ self.rotation
        return [self.classes[i] for i in (t @ self.q.T).argmax(axis=1)]
