"""Cross-validation, permutation tests and stability selection: draws on the driver, fits in tasks.

Draws come from one seeded stream in order, so a run's null values don't depend on how tasks are dealt. The matrix is
broadcast: these tests are for the few samples that make them worthwhile (``MAX_CELLS`` values at most).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.stats import settled

MAX_CELLS = 50_000_000

#: Fits on rows and labels, and predicts other rows.
FitPredict = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def folds(y: np.ndarray, cv: int | None = None, seed: int = 42) -> list[np.ndarray]:
    """Test rows of each fold: one row each by default, else ``cv`` shuffled folds with classes spread evenly."""
    if cv is None:
        return [np.array([i]) for i in range(len(y))]
    rng, fold = np.random.RandomState(seed), np.zeros(len(y), int)
    for c in np.unique(y):
        own = rng.permutation(np.flatnonzero(y == c))
        fold[own] = np.arange(len(own)) % cv
    return [np.flatnonzero(fold == k) for k in range(cv)]


def cross_predict(fit_predict: FitPredict, x: np.ndarray, y: np.ndarray, cv: int | None = None) -> np.ndarray:
    out = np.empty(len(y), dtype=object)
    for test in folds(y, cv):
        train = np.setdiff1d(np.arange(len(y)), test)
        out[test] = fit_predict(x[train], y[train], x[test])
    return out


def _spread(spark: SparkSession, data: tuple, work: list, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(data, number, draw)`` gives rows, for each draw, in tasks."""
    if data[0].size > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} values")
    shared = spark.sparkContext.broadcast(data)
    kinds = [pa.int64() if f.split()[1] in ("long", "int") else pa.float64() if f.split()[1] == "double" else pa.string() for f in schema.split(", ")]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for number, draw in zip(*(c.to_pylist() for c in batch.columns)) for r in kernel(shared.value, number, np.array(draw))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    jobs = spark.createDataFrame([(n, [int(v) for v in d]) for n, d in work], "number long, draw array<long>")
    return jobs.repartition(max(1, min(len(work), spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def permutation_test(spark: SparkSession, fit_predict: FitPredict, x: np.ndarray, y: np.ndarray, n_permutations: int = 1000, seed: int = 42, min_perms: int = 50, check_every: int = 25, cv: int | None = None) -> dict:
    """Accuracy against labels in random order, in rounds that end where the early stop may. No permutations: p is 1."""
    rng = np.random.RandomState(seed)
    true = float((cross_predict(fit_predict, x, y, cv) == y).mean())
    null: list[float] = []
    stopped = False

    def kernel(data, number, order):
        rows, labels = data
        shuffled = labels[order]
        return [(number, float((cross_predict(fit_predict, rows, shuffled, cv) == shuffled).mean()))]

    while len(null) < n_permutations and not stopped:
        size = min(min_perms if not null else check_every, n_permutations - len(null))
        work = [(len(null) + k, rng.permutation(len(y))) for k in range(size)]
        got = _spread(spark, (x, y), work, kernel, "number long, accuracy double").collect()  # one round's numbers
        null += [r.accuracy for r in sorted(got)]
        stopped = len(null) >= min_perms and len(null) % check_every == 0 and settled(sum(v >= true for v in null), len(null))
    return {
        "true_accuracy": true, "p_value": (sum(v >= true for v in null) + 1) / (len(null) + 1), "mean_null": float(np.mean(null)) if null else None,
        "std_null": float(np.std(null)) if null else None, "n_permutations_run": len(null), "stopped_early": stopped, "null": null,
    }


def stability_selection(spark: SparkSession, fit: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, n_bootstrap: int = 100, seed: int = 42) -> DataFrame:
    """``f, selection_frequency, mean_vip, std_vip, stable`` over bootstraps within classes. ``fit`` gives what is
    selected and the importances."""
    from pyspark.sql import functions as F

    rng = np.random.RandomState(seed)
    own = [np.flatnonzero(y == c) for c in np.unique(y)]
    work = [(b, np.concatenate([rng.choice(i, size=len(i), replace=True) for i in own])) for b in range(n_bootstrap)]

    def kernel(data, number, draw):
        chosen, importance = fit(data[0][draw], data[1][draw])
        return [(number, f, float(c), float(v)) for f, (c, v) in enumerate(zip(chosen, importance))]

    each = _spread(spark, (x, y), work, kernel, "number long, f long, chosen double, vip double")
    out = each.groupBy("f").agg(F.avg("chosen").alias("selection_frequency"), F.avg("vip").alias("mean_vip"), F.stddev_pop("vip").alias("std_vip"))
    return out.withColumn("stable", F.col("selection_frequency") >= 0.8)


def permutation_importance(spark: SparkSession, model, x: np.ndarray, y: np.ndarray, repeats: int = 10, seed: int = 42) -> DataFrame:
    """``f, mean, std``: loss of ``model``'s accuracy when one feature is shuffled, a draw for each repeat in tasks."""
    from pyspark.sql import functions as F

    rng, base = np.random.RandomState(seed), float((model.predict(x) == y).mean())
    work = [(f, rng.permutation(len(y))) for f in range(x.shape[1]) for _ in range(repeats)]

    def kernel(data, number, draw):
        z = data[0].copy()
        z[:, number] = z[draw, number]
        return [(number, base - float((model.predict(z) == data[1]).mean()))]

    each = _spread(spark, (x, y), work, kernel, "f long, drop double")
    return each.groupBy("f").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))


def cross_validation(fit_predict: FitPredict, x: np.ndarray, y: np.ndarray, cv: int | None = None) -> dict:
    """Predictions for each row by fits without it, with accuracy, confusion (labels x labels) and a report by label:
    precision, recall, F1 and support."""
    predicted = cross_predict(fit_predict, x, y, cv)
    labels = sorted(set(y) | set(predicted))
    confusion = np.array([[int(((y == a) & (predicted == b)).sum()) for b in labels] for a in labels])
    hit, given, there = np.diag(confusion).astype(float), confusion.sum(axis=0), confusion.sum(axis=1)
    precision, recall = hit / np.maximum(given, 1), hit / np.maximum(there, 1)
    f1 = 2 * precision * recall / np.where(precision + recall > 0, precision + recall, 1)
    table = {a: (float(precision[k]), float(recall[k]), float(f1[k]), int(there[k])) for k, a in enumerate(labels)}
    return {"predicted": predicted, "accuracy": float((predicted == y).mean()), "labels": labels, "confusion": confusion, "report": table}


def ordinal_cross_validation(x: np.ndarray, y: np.ndarray, model: str = "AT", alpha: float = 1.0, cv: int | None = None) -> dict:
    """``cross_validation`` of a threshold model, with the mean absolute error and the mean of the folds' coefficients."""
    from .ordinal import Ordinal

    kept: list[np.ndarray] = []

    def fit_predict(a, b, new):
        m = Ordinal(model, alpha).fit(a, b)
        kept.append(m.w)
        return m.predict(new)

    out = cross_validation(fit_predict, x, y, cv)
    return out | {"mae": float(np.abs(out["predicted"].astype(float) - y).mean()), "coefficients": np.mean(kept, axis=0)}


def by_block(table: DataFrame, sizes: list[int]) -> DataFrame:
    """A table by feature of all blocks (``f``) with ``block`` and the feature's place in it (``place``)."""
    from pyspark.sql import functions as F

    edges = [int(v) for v in np.cumsum([0, *sizes])]
    block = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("f"))) - 1
    return table.withColumn("block", block).withColumn("place", F.col("f") - F.element_at(F.lit(edges), block + 1))


def splsda_predictor(n_components: int = 2, keep=None) -> FitPredict:
    from .latent import SPLSDA
    from .wide import fit_matrix

    return lambda x, y, new: np.array(fit_matrix(SPLSDA(n_components, keep), x, y).predict(new), dtype=object)


def splsda_selector(n_components: int = 2, keep=None):
    from .latent import SPLSDA
    from .wide import fit_matrix

    def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = fit_matrix(SPLSDA(n_components, keep), x, y)
        return ((m.w != 0).any(axis=1) if keep is not None else m.vip >= 1), m.vip

    return fit


def diablo_predictor(sizes: list[int], **options) -> FitPredict:
    from .latent import DIABLO
    from .wide import fit_matrix

    return lambda x, y, new: np.array(fit_matrix(DIABLO(sizes, **options), x, y).predict(new), dtype=object)


def diablo_selector(sizes: list[int], **options):
    from .latent import DIABLO
    from .wide import fit_matrix

    def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = fit_matrix(DIABLO(sizes, **options), x, y)
        importance = np.concatenate(m.vips())
        return ((m.w != 0).any(axis=1) if options.get("keep") else importance >= 1), importance

    return fit


def ordinal_predictor(model: str = "AT", alpha: float = 1.0) -> FitPredict:
    from .ordinal import Ordinal

    return lambda x, y, new: Ordinal(model, alpha).fit(x, y).predict(new)


def forest_predictor(trees: int = 100, depth: int = 3, seed: int = 42) -> FitPredict:
    from .forest import Forest

    return lambda x, y, new: Forest(trees, depth, seed).fit(x, y).predict(new)
