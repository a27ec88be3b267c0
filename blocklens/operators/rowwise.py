"""Cross-validation, permutation tests and stability selection of components on any number of samples, where they are.

Samples are numbered in order of class and hashed id, so a number's class follows from the classes' sizes: permuted labels
and bootstrap draws need no table of labels or draws, only a keyed function of the number. Sums of all permutations (or
draws) of a round are gathered in one pass, fits run in tasks, and predictions in another pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, checkpointed, summed
from ..functions.stats import settled
from .latent import DIABLO, MAX_FEATURES, SPLSDA, Moments, gather_fold_moments, gather_moments

#: Values that a task adds up for one pass's permutations or draws (32 MB), at most; more of them take more passes.
PASS_CELLS = 4_000_000
#: Values of the matrices of fits that go on together (16 MB), at most.
TOGETHER_CELLS = 2_000_000
#: Draws that a leaf of the tree of draws deals at once.
LEAF = 1024

Model = SPLSDA | DIABLO
Fit = Callable[[Moments], Model]


@dataclass
class Numbered:
    """``rows``: ``sample_id, grp, x, number``; ``edges``: where each class's numbers begin, and the number of samples."""

    rows: DataFrame
    classes: list
    edges: np.ndarray

    @property
    def n(self) -> int:
        return int(self.edges[-1])


def number_rows(rows: DataFrame, parts: int | None = None) -> Numbered:
    """Number the samples from 0 by class and then by hashed id, ranges of them by themselves (``parts`` of them, where much
    work is done on few bytes); samples without a class are left out. The numbered rows are checkpointed, as several passes
    read them."""
    order = ["grp", F.xxhash64(F.col("sample_id").cast("string")), "sample_id"]
    ranged = rows.where("grp is not null").select("sample_id", "grp", F.col("x").cast("array<double>").alias("x")).repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("m", 33)))
    counts, sizes = {}, {}
    for r in ranged.groupBy("part", "grp").agg(F.count("*").alias("n")).collect():  # a row for each range and class in it
        counts[r.grp], sizes[r.part] = counts.get(r.grp, 0) + r.n, sizes.get(r.part, 0) + r.n
    if not counts:
        raise ValueError("no samples")
    parts = sorted(sizes)
    starts = rows.sparkSession.createDataFrame([(k, int(s)) for k, s in zip(parts, np.cumsum([0, *(sizes[k] for k in parts[:-1])]))], "part long, start long")
    number = F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    classes = sorted(counts)
    return Numbered(ranged.join(F.broadcast(starts), "part").select("sample_id", "grp", "x", number.alias("number")), classes, np.cumsum([0, *(counts[c] for c in classes)]))


def shuffled(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 to n - 1, chosen by ``key``, takes each of ``i``: a keyed network of exchanged halves,
    gone through again by what it takes beyond n."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.RandomState(key % (1 << 32)).randint(0, 1 << 62, 8).astype("u8")

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            h = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    out = once(np.asarray(i).astype("u8"))
    far = np.flatnonzero(out >= n)
    while len(far):
        out[far] = once(out[far])
        far = far[out[far] >= n]
    return out.astype("int64")


def multiplicities(numbers: np.ndarray, edges: np.ndarray, key: int, draws: int | None = None) -> np.ndarray:
    """How often each number is drawn when every class draws as many of its own as it has (or ``draws``), with replacement.

    The draws are split between halves of the class again and again, each split by its own keyed generator, down to
    leaves; so any task finds its numbers' draws by itself, and a class's draws add up to its size.
    """
    out, splits = np.zeros(len(numbers), "int64"), {}

    def generator(*of: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([key, *of])))

    def leaf(c: int, at: int) -> tuple[int, np.ndarray]:
        lo, size = 0, int(edges[c + 1] - edges[c])
        rest = size if draws is None else draws
        while size > LEAF:
            left = size // 2
            known = splits.get((c, lo, size))
            if known is None:
                known = splits[c, lo, size] = int(generator(c, lo, size).binomial(rest, left / size))
            if at < lo + left:
                size, rest = left, known
            else:
                lo, size, rest = lo + left, size - left, rest - known
        return lo, generator(c, lo).multinomial(rest, np.full(size, 1 / size)) if size else np.zeros(0, "int64")

    owner = np.searchsorted(edges, numbers, "right") - 1
    order, k = np.argsort(numbers, kind="stable"), 0
    while k < len(order):
        c = int(owner[order[k]])
        lo, own = leaf(c, int(numbers[order[k]] - edges[c]))
        upto = int(np.searchsorted(numbers[order], edges[c] + lo + len(own)))
        out[order[k:upto]] = own[numbers[order[k:upto]] - edges[c] - lo]
        k = upto
    return out


def present(m: Moments) -> Moments:
    """Without the classes that no sample is of."""
    own = np.flatnonzero(m.y > 0.5)
    return Moments(m.n, m.xx, m.xy[:, own], m.yy[np.ix_(own, own)], m.x, m.y[own], [m.classes[i] for i in own])


def _response(m: Moments, fit: Fit) -> np.ndarray:
    """Features and a constant x classes: what a fit on ``m`` gives each class; no class without samples wins."""
    own = present(m)
    model = fit(own)
    out = np.full((len(m.x) + 1, len(m.classes)), 0.0)
    out[-1] = -np.inf
    at = [m.classes.index(c) for c in own.classes]
    coef = model.rotation @ model.q.T
    out[:-1, at], out[-1, at] = coef, -model.mean @ coef
    return out


def _responses(m: Moments, x: np.ndarray, hot: np.ndarray, model: Model) -> np.ndarray:
    """``_response`` of the fits without each of some rows, TOGETHER_CELLS values of their matrices at a time."""
    out, some = np.zeros((len(x), len(m.x) + 1, len(m.classes))), max(1, TOGETHER_CELLS // len(m.x) ** 2)
    last = (m.y - hot <= 0.5).any(axis=1) | (m.n < 3)  # a class ends with the row
    for i in np.flatnonzero(last):
        out[i] = _response(m.without(x[i : i + 1], hot[i : i + 1]), model.fit)
    rest = np.flatnonzero(~last)
    for a in range(0, len(rest), some):
        own = rest[a : a + some]
        coef, mean = model.coefficients_without(m, x[own], hot[own])
        out[own, :-1], out[own, -1] = coef, -np.einsum("ip,ipq->iq", mean, coef)
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.hstack([column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1), np.ones((rows, 1))])


def cross_validate(rows: DataFrame, fit: Fit, cv: int | None = None) -> DataFrame:
    """``sample_id, grp, fold, predicted``: each sample predicted by a fit without its fold.

    By default each sample is its own fold: the sums of all samples are broadcast and each task takes its own samples
    out of them, one at a time. Else ``cv`` folds with classes spread evenly: a sample's place in its class, by hashed
    id, modulo ``cv``, exactly. Up to MAX_FEATURES features.
    """
    if cv is None:
        total = gather_moments(rows)
        held = rows.sparkSession.sparkContext.broadcast(total)
        model = getattr(fit, "__self__", None)  # a model's own fit: those of a batch's samples go on together
        model = model if isinstance(model, (SPLSDA, DIABLO)) else None

        def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = held.value
                x = _matrix(batch.column(2), batch.num_rows)
                hot = (np.array(batch.column(1).to_pylist(), object)[:, None] == np.array(m.classes, object)[None, :]).astype(float)
                if model is None:
                    best = [int((x[i] @ _response(m.without(x[i : i + 1, :-1], hot[i : i + 1]), fit)).argmax()) for i in range(len(x))]
                else:
                    best = [int(k) for a in range(0, len(x), 256) for k in np.einsum("ip,ipq->iq", x[a : a + 256], _responses(m, x[a : a + 256, :-1], hot[a : a + 256], model)).argmax(axis=1)]
                out = [m.classes[k] for k in best]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(0), pa.array(out, batch.column(1).type)], names=["sample_id", "grp", "fold", "predicted"])

        kind = dict(rows.dtypes)
        return rows.select("sample_id", "grp", F.col("x").cast("array<double>").alias("x")).mapInArrow(leave_out, f"sample_id {kind['sample_id']}, grp {kind['grp']}, fold {kind['sample_id']}, predicted {kind['grp']}")
    known = number_rows(rows)
    dealt = known.rows.withColumn("fold", fold_of(known, cv))
    coefs = [_response(m, fit) for m in _without_each(gather_fold_moments(dealt), cv)]
    held = rows.sparkSession.sparkContext.broadcast((coefs, known.classes))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch.column(3), batch.num_rows), batch.column(2).to_numpy()
            best = np.zeros(batch.num_rows, int)
            for f in np.unique(fold):
                best[fold == f] = (x[fold == f] @ held.value[0][f]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([held.value[1][i] for i in best], batch.column(1).type)], names=["sample_id", "grp", "fold", "predicted"])

    kind = dict(rows.dtypes)
    return dealt.select("sample_id", "grp", "fold", "x").mapInArrow(predict, f"sample_id {kind['sample_id']}, grp {kind['grp']}, fold int, predicted {kind['grp']}")


def fold_of(known: Numbered, cv: int) -> Column:
    """A sample's place in its class modulo ``cv``."""
    starts = F.create_map(*[c for k, name in enumerate(known.classes) for c in (F.lit(name), F.lit(int(known.edges[k])))])
    return F.pmod(F.col("number") - F.element_at(starts, F.col("grp")), F.lit(cv)).cast("int")


def _without_each(parts: dict[int, Moments], cv: int) -> list[Moments]:
    none = next(iter(parts.values())).zero()
    total = sum(parts.values(), none)
    return [total - parts.get(k, none) for k in range(cv)]


def permutation_test(rows: DataFrame, fit: Fit, n_permutations: int = 1000, seed: int = 42, min_perms: int = 50, check_every: int = 25, cv: int = 5) -> dict:
    """Cross-validated accuracy against labels in random order, in rounds that end where the early stop may.

    Folds are those of the true labels throughout, so X'X is gathered once; a round takes one pass for X'Y of all its
    permutations, one task each for their fits, and one pass for the predictions. Up to MAX_FEATURES features.
    """
    known = number_rows(rows)
    spark, n, q, edges = known.rows.sparkSession, known.n, len(known.classes), known.edges
    dealt = known.rows.withColumn("fold", fold_of(known, cv)).select("number", "fold", "x")
    parts = gather_fold_moments(known.rows.withColumn("fold", fold_of(known, cv)))
    p = len(next(iter(parts.values())).x)
    without = spark.sparkContext.broadcast(_without_each(parts, cv))  # MAX_CELLS values at most
    keys = np.random.RandomState(seed).randint(0, 1 << 31, max(1, n_permutations))

    def labels(number: np.ndarray, which: int) -> np.ndarray:
        return permuted(edges, number, None if which < 0 else int(keys[which]))

    def accuracies(which: list[int]) -> list[float]:
        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(which), cv * q, p + 1))
            for batch in batches:
                number, fold, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), batch.num_rows)
                for b, w in enumerate(which):
                    hot = np.zeros((batch.num_rows, cv * q))
                    hot[np.arange(batch.num_rows), fold * q + labels(number, w)] = 1.0
                    total[b] += hot.T @ x
            yield array_rows({"b": np.arange(len(which))}, [t.ravel() for t in total])

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                    each = v.values.to_numpy(zero_copy_only=False).reshape(cv, q, p + 1)
                    out = []
                    for f in range(cv):
                        m, own = without.value[f], each.sum(axis=0) - each[f]
                        out.append(_response(Moments(m.n, m.xx, own[:, :-1].T, np.diag(own[:, -1]), m.x, own[:, -1], m.classes), fit))
                    yield array_rows({"b": np.array([b])}, [np.array(out).ravel()])

        sums = summed(dealt.mapInArrow(gather, "b long, v array<double>"), "b")
        coefs = np.zeros((len(which), cv, p + 1, q))
        for r in sums.mapInArrow(train, "b long, v array<double>").toLocalIterator():  # PASS_CELLS values at most
            coefs[r.b] = np.reshape(r.v, (cv, p + 1, q))
        held = spark.sparkContext.broadcast(coefs)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = np.zeros(len(which), "int64")
            for batch in batches:
                number, fold, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), batch.num_rows)
                for f in np.unique(fold):
                    own = fold == f
                    for b, w in enumerate(which):
                        hits[b] += int(((x[own] @ held.value[b, f]).argmax(axis=1) == labels(number[own], w)).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(which))), pa.array(hits)], names=["b", "hits"])

        got = {r.b: r.hits for r in dealt.mapInArrow(compare, "b long, hits long").groupBy("b").agg(F.sum("hits").alias("hits")).collect()}  # a number each
        return [got[b] / n for b in range(len(which))]

    most = max(1, PASS_CELLS // (cv * q * (p + 1)))

    return rounds(lambda which: [a for k in range(0, len(which), most) for a in accuracies(which[k : k + most])], n_permutations, min_perms, check_every)


def permuted(edges: np.ndarray, number: np.ndarray, key: int | None) -> np.ndarray:
    """The class of each sample (by its place among the classes) when ``key`` shuffles the labels; None leaves them."""
    place = number if key is None else shuffled(number, int(edges[-1]), key)
    return np.searchsorted(edges, place, "right") - 1


def rounds(accuracies: Callable[[list[int]], list[float]], n_permutations: int, min_perms: int, check_every: int) -> dict:
    """A permutation test in rounds: ``accuracies`` of the permutations of some numbers, -1 being the true labels."""
    true, null, stopped = None, [], False
    while true is None or (len(null) < n_permutations and not stopped):
        size = min(min_perms if not null else check_every, n_permutations - len(null))
        got = accuracies(([] if true is not None else [-1]) + list(range(len(null), len(null) + size)))
        true, got = (got[0], got[1:]) if true is None else (true, got)
        null += got
        stopped = len(null) >= min_perms and len(null) % check_every == 0 and settled(sum(v >= true for v in null), len(null))
    return {
        "true_accuracy": true, "p_value": (sum(v >= true for v in null) + 1) / (len(null) + 1), "mean_null": float(np.mean(null)) if null else None,
        "std_null": float(np.std(null)) if null else None, "n_permutations_run": len(null), "stopped_early": stopped, "null": null,
    }


def stability_selection(rows: DataFrame, fit: Fit, n_bootstrap: int = 100, seed: int = 42) -> DataFrame:
    """``f, selection_frequency, mean_vip, std_vip, stable`` over bootstraps within classes, of any number of samples.

    One pass weighs each sample by how often a bootstrap draws it (see ``multiplicities``) and adds up the weighted sums
    of as many bootstraps as PASS_CELLS allows; each one's fit runs in a task. A feature is selected by a weight where
    the model keeps some, else by an importance of at least 1. Up to MAX_FEATURES features.
    """
    known = number_rows(rows)
    edges, q, classes = known.edges, len(known.classes), known.classes
    first = known.rows.select(F.size("x").alias("p")).first()
    if first.p > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    side = first.p + q + 1
    keys = np.random.RandomState(seed).randint(0, 1 << 31, n_bootstrap)
    most = max(1, PASS_CELLS // (side * side))

    def gather(which: range) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(which), side, side))
            for batch in batches:
                number, x = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
                hot = (np.searchsorted(edges, number, "right")[:, None] - 1 == np.arange(q)[None, :]).astype(float)
                z = np.hstack([x[:, :-1], hot, x[:, -1:]])
                for k, b in enumerate(which):
                    w = multiplicities(number, edges, int(keys[b]))
                    drawn = np.flatnonzero(w)
                    total[k] += (z[drawn] * w[drawn, None]).T @ z[drawn]
            for k, b in enumerate(which):
                yield array_rows({"b": np.full(side, b), "i": np.arange(side)}, list(total[k]))

        return summed(known.rows.select("number", "x").mapInArrow(add, "b long, i long, v array<double>"), "b", "i")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, z, p = None, np.zeros((side, side)), first.p

        def one(b: int) -> pa.RecordBatch:
            model = fit(present(Moments(z[-1, -1], z[:p, :p], z[:p, p:-1], z[p:-1, p:-1], z[-1, :p], z[-1, p:-1], classes)))
            values = np.concatenate(model.vips()) if isinstance(model, DIABLO) else model.vip
            chosen = (model.w != 0).any(axis=1) if getattr(model, "keep", None) else values >= 1
            return pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(chosen.astype(float)), pa.array(values)], names=["f", "chosen", "vip"])

        for batch in batches:
            for b, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != now and now is not None:
                    yield one(now)
                now, z[i] = b, v.values.to_numpy(zero_copy_only=False)
        if now is not None:
            yield one(now)

    out = None
    for a in range(0, n_bootstrap, most):
        each = gather(range(a, min(a + most, n_bootstrap))).repartition("b").sortWithinPartitions("b", "i").mapInArrow(train, "f long, chosen double, vip double")
        out = each if out is None else out.unionByName(each)
    table = out.groupBy("f").agg(F.avg("chosen").alias("selection_frequency"), F.avg("vip").alias("mean_vip"), F.stddev_pop("vip").alias("std_vip"))
    return table.withColumn("stable", F.col("selection_frequency") >= 0.8)
