"""Components of blocks with more features than fit a matrix of their squares: SPLSDA and DIABLO through products with X.

A fit needs ``S = X'Y`` and ``G = Y'Y``, which are narrow, and of ``C = X'X`` only products ``C v``. ``Rows`` makes them from
few samples on one machine (n x p values, nothing p x p); ``Passes`` makes each in one pass over any number of samples,
whose shuffle is linear in the features. Deflating X means multiplying it from the right, so it is never written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, summed
from .latent import DIABLO, MAX_FEATURES, SPLSDA, Moments, gather_moments, keep_largest, vip

#: Values of few samples that a fit on one machine takes (32 MB), at most.
ROWS_CELLS = 4_000_000
#: Features in one row of a shuffle.
PIECE = 4096
#: Passes that look for a block's first direction, at most, directions that they carry, and their relative tolerance.
MAX_PASSES, CARRIED, TOLERANCE = 60, 4, 1e-9


class Rows:
    """Products from centred samples on this machine. ``y``: one-hot labels."""

    exact = True

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: list):
        self.n, self.classes, self.mean = len(x), classes, x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.x, hot = x - self.mean, y - (y.mean(axis=0) if len(y) else 0.0)
        self.s, self.g = self.x.T @ hot, hot.T @ hot

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, classes: list | None = None) -> Rows:
        classes = sorted(set(y)) if classes is None else classes
        return cls(np.asarray(x, float), (np.asarray(y, object)[:, None] == np.array(classes, object)[None, :]).astype(float), classes)

    def image(self, v: np.ndarray) -> np.ndarray:
        return self.x.T @ (self.x @ v)

    def deflate(self, w: np.ndarray, p: np.ndarray, parts: list[slice]) -> None:
        for b in parts:
            self.x[:, b] -= np.outer(self.x[:, b] @ w[b], p[b])

    def top(self) -> np.ndarray:
        """The direction of the largest spread, through the n x n products of samples."""
        if not self.n:
            return np.zeros(self.x.shape[1])
        values, vectors = np.linalg.eigh(self.x @ self.x.T)
        v = self.x.T @ vectors[:, -1]
        size = np.linalg.norm(v)
        return v / size if size > 0 else v


class Passes:
    """Products from ``rows`` (``grp, x``), each in one pass; what comes to the driver is a few times the features."""

    exact = False

    def __init__(self, rows: DataFrame):
        self.rows, self.right = rows.select("grp", "x"), []
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no samples")
        self.p = first[0]
        counts = {r.grp: r.n for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect()}
        self.classes = sorted(counts)
        of = np.array([counts[c] for c in self.classes], float)
        self.n, self.mean = int(of.sum()), np.zeros(self.p)
        self.mean = self._by_class().sum(axis=1) / self.n
        self.s = self._by_class()  # centred sums of each class; the rest of centring Y adds nothing to them
        self.g = np.diag(of) - np.outer(of, of) / self.n

    def _sum(self, kernel, columns: int) -> np.ndarray:
        """Adds up ``kernel(x, labels)``, features x columns, over all tasks; sums are dealt by column and range of features."""
        mean, out = self.rows.sparkSession.sparkContext.broadcast(self.mean), np.zeros((self.p, columns))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | None = None
            for batch in batches:
                if batch.num_rows:
                    own = kernel(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean.value, batch.column(0))
                    total = own if total is None else total + own
            if total is not None:
                for k in range(columns):
                    starts = range(0, len(total), PIECE)
                    yield array_rows({"k": np.full(len(starts), k), "a": np.array(starts)}, [total[a : a + PIECE, k] for a in starts])

        for r in summed(self.rows.mapInArrow(partial, "k long, a long, v array<double>"), "k", "a").toLocalIterator():
            out[r.a : r.a + len(r.v), r.k] = r.v
        return out

    def _by_class(self) -> np.ndarray:
        classes = np.array(self.classes, object)
        return self._sum(lambda x, grp: x.T @ (np.array(grp.to_pylist(), object)[:, None] == classes[None, :]).astype(float), len(classes))

    def image(self, v: np.ndarray) -> np.ndarray:
        many = v.reshape(self.p, -1)
        for w, p, parts in reversed(self.right):
            many = many.copy()
            for b in parts:
                many[b] -= np.outer(w[b], p[b] @ many[b])
        held = self.rows.sparkSession.sparkContext.broadcast(many)
        out = self._sum(lambda x, grp: x.T @ (x @ held.value), many.shape[1])
        for w, p, parts in self.right:
            for b in parts:
                out[b] -= np.outer(p[b], w[b] @ out[b])
        return out.reshape(v.shape)

    def deflate(self, w: np.ndarray, p: np.ndarray, parts: list[slice]) -> None:
        self.right.append((w, p, parts))

    def top(self) -> np.ndarray:
        """The direction of the largest spread, by a few directions carried through passes until the first one stays."""
        rng = np.random.RandomState(0)
        v, last = np.linalg.qr(rng.normal(size=(self.p, min(CARRIED, self.p))))[0], None
        for _ in range(MAX_PASSES):
            image = self.image(v)
            turn = np.linalg.eigh(v.T @ image)[1][:, ::-1]
            first = v @ turn[:, 0]
            if last is not None and min(np.linalg.norm(first - last), np.linalg.norm(first + last)) < TOLERANCE:
                break
            last = first
            v = np.linalg.qr(image @ turn)[0]
        return first


def fit_splsda(model: SPLSDA, data: Rows | Passes) -> SPLSDA:
    """``model`` fitted through products alone. With ``Passes`` an iteration costs none: the weights' directions need S
    only, and they are followed until they stay, whereas exact products stop where a change of Y's scores is below ``tol``."""
    s, g, p_all = data.s.copy(), data.g.copy(), len(data.s)
    whole = [slice(0, p_all)]
    model.classes, model.mean = data.classes, data.mean
    h = int(min(model.n_components, data.n - 1, p_all))
    keep, w_all, l_all, q_all, ss = model._keep(h), [], [], [], []
    for k in range(h):
        u = np.zeros(len(g))
        u[0] = 1.0
        w, tt, image = np.zeros(p_all), 0.0, None
        for _ in range(model.max_iter):
            w = s @ u
            size = np.linalg.norm(w)
            w = keep_largest(w / size if size > 0 else w, keep[k])
            if data.exact:
                image = data.image(w)
                tt = float(w @ image)
                q = s.T @ w / tt if tt > 0 else np.zeros(len(g))
                qq = float(q @ q)
                new = q / qq if qq > 0 else u
                moved, least = new - u, model.tol
            else:
                new = s.T @ w
                size = np.linalg.norm(new)
                new = new / size if size > 0 else u
                moved, least = new - u / np.linalg.norm(u), TOLERANCE * 1e-3
            u = new
            if np.sqrt(max(0.0, float(moved @ g @ moved))) < least:
                break
        if not data.exact:
            image = data.image(w)
            tt = float(w @ image)
        q = s.T @ w / tt if tt > 0 else np.zeros(len(g))
        load = image / tt if tt > 0 else np.zeros(p_all)
        s, g = s - tt * np.outer(load, q), g - tt * np.outer(q, q)
        data.deflate(w, load, whole)
        w_all.append(w), l_all.append(load), q_all.append(q), ss.append(tt * float(q @ q))
    shape = (0, p_all), (0, len(g))
    model.w, model.p, model.q = np.reshape(w_all, (-1, p_all)).T, np.reshape(l_all, (-1, p_all)).T, np.reshape(q_all, (-1, shape[1][1])).T
    model.vip = vip(model.w, np.array(ss))
    return model


def fit_diablo(model: DIABLO, data: Rows | Passes) -> DIABLO:
    """``model`` fitted through products alone: the blocks' mean score is X a, a block's weights are products of X a and
    of the labels, so a sweep takes a product for each block."""
    s, g, n_all = data.s.copy(), data.g.copy(), len(data.s)
    model.classes, model.mean = data.classes, data.mean
    blocks, edges = len(model.sizes), np.cumsum([0, *model.sizes])
    part, d = [slice(edges[k], edges[k + 1]) for k in range(blocks)], model.design_matrix()
    h = int(min(model.n_components, data.n - 1))
    model.w, model.p, model.q = np.zeros((n_all, h)), np.zeros((n_all, h)), np.zeros((len(g), h))
    model.tt, model.block_corr = np.zeros((blocks, h)), np.eye(blocks)
    for comp in range(h):
        a, w = data.top(), np.zeros(n_all)
        image = data.image(a)
        for _ in range(model.max_iter):
            at = [a] * blocks
            y = s.T @ a / max(float(a @ image), 1e-10)
            for k in range(blocks):
                v = sum((d[k, j] * at[j] for j in range(blocks) if j != k), np.zeros(n_all))
                u, to = d[k, -1] * y, data.image(v) if v.any() else np.zeros(n_all)
                if np.sqrt(max(0.0, float(v @ to + 2 * v @ s @ u + u @ g @ u))) < 1e-10:
                    to, u = image, np.zeros(len(g))
                x = to[part[k]] + s[part[k]] @ u
                size = np.linalg.norm(x)
                x = keep_largest(x / size if size > 0 else x, model.keep[k][comp] if model.keep else None)
                w[part[k]] = x
                at[k] = np.zeros(n_all)
                at[k][part[k]] = x
            new = sum(at) / blocks
            before, moved = np.sqrt(max(0.0, float(a @ image))), new - a
            now = data.image(new)
            far = np.sqrt(max(0.0, float(moved @ (now - image))))
            a, image = new, now
            if far < model.tol * before:
                break
        each = np.zeros((n_all, blocks))
        for k in range(blocks):
            each[part[k], k] = w[part[k]]
        ce = data.image(each)
        cross, load = each.T @ ce, np.zeros(n_all)
        model.tt[:, comp] = np.diag(cross)
        for k in range(blocks):
            load[part[k]] = ce[part[k], k] / cross[k, k] if cross[k, k] > 0 else 0.0
        if comp == 0:
            sd = np.sqrt(np.maximum(np.diag(cross), 1e-300))
            model.block_corr = cross / np.outer(sd, sd)
        ss = float(a @ image)
        q = s.T @ a / ss if ss > 0 else np.zeros(len(g))
        s = s - np.outer(image, q)
        for b in part:
            s[b] -= np.outer(load[b], w[b] @ s[b])
        g = g - ss * np.outer(q, q)
        data.deflate(w.copy(), load, part)
        model.w[:, comp], model.p[:, comp], model.q[:, comp] = w, load, q
    model.part = part
    return model


def fit_data(model: SPLSDA | DIABLO, data: Rows | Passes) -> SPLSDA | DIABLO:
    return fit_splsda(model, data) if isinstance(model, SPLSDA) else fit_diablo(model, data)


def fit_matrix(model: SPLSDA | DIABLO, x: np.ndarray, y: np.ndarray, classes: list | None = None) -> SPLSDA | DIABLO:
    """Fit on samples of this machine: through them where they are fewer than the features, else through X'X."""
    return fit_data(model, Rows.of(x, y, classes)) if len(x) <= x.shape[1] else model.fit(Moments.of(x, y, classes))


def fit(rows: DataFrame, model: SPLSDA | DIABLO) -> SPLSDA | DIABLO:
    """Fit on ``grp, x`` by the shape of the table: few samples of many features on this machine (up to ROWS_CELLS
    values), up to MAX_FEATURES features through X'X of one pass, and all others through passes."""
    first = rows.select(F.size("x").alias("p")).first()
    if first is None:
        raise ValueError("no samples")
    if first.p > MAX_FEATURES or rows.limit(first.p + 1).count() <= first.p:
        most = min(first.p, ROWS_CELLS // max(first.p, 1))
        few = rows.select("grp", F.col("x").cast("array<double>").alias("x")).limit(most + 1).toArrow()  # most * p is ROWS_CELLS at most
        if few.num_rows <= most:
            x = few.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return fit_data(model, Rows.of(x.reshape(few.num_rows, -1), few.column("grp").to_pylist()))
    return model.fit(gather_moments(rows)) if first.p <= MAX_FEATURES else fit_data(model, Passes(rows))
