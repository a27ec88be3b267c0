"""Random forests: Spark ML on tables of any size; a small local kernel for resampling and exact Shapley values."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_forest(rows: DataFrame, trees: int = 100, depth: int = 3, seed: int = 42, balanced: bool = True) -> tuple[RandomForestClassificationModel, list]:
    """A Spark ML forest on ``grp, x`` with classes weighed evenly; and the sorted classes."""
    counts = rows.groupBy("grp").count().orderBy("grp").collect()  # a row for each class
    n, k = sum(r["count"] for r in counts), len(counts)
    index = F.create_map(*[v for i, r in enumerate(counts) for v in (F.lit(r.grp), F.lit(float(i)))])
    weight = F.create_map(*[v for r in counts for v in (F.lit(r.grp), F.lit(n / (k * r["count"]) if balanced else 1.0))])
    data = rows.select(F.element_at(index, F.col("grp")).alias("label"), array_to_vector("x").alias("features"), F.element_at(weight, F.col("grp")).alias("weight"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featureSubsetStrategy="sqrt").fit(data), [r.grp for r in counts]


class Forest:
    """Trees of at most ``depth`` on bootstrap samples with sqrt(p) features at each node, classes weighed evenly.
    A node is ``(feature, limit, left, right, shares, weight)``; a leaf has feature -1."""

    def __init__(self, trees: int = 100, depth: int = 3, seed: int = 42):
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.RandomState(self.seed)
        self.classes, label = np.unique(y, return_inverse=True)
        each = len(y) / (len(self.classes) * np.bincount(label))
        hot = np.eye(len(self.classes))[label] * each[label][:, None]
        self.importance, self.roots = np.zeros(x.shape[1]), []
        for _ in range(self.trees):
            draw = rng.randint(0, len(y), len(y))
            gain = np.zeros(x.shape[1])
            self.roots.append(self._grow(x[draw], hot[draw], self.depth, rng, gain, hot[draw].sum()))
            self.importance += gain / gain.sum() if gain.sum() > 0 else 0
        total = self.importance.sum()
        self.importance = self.importance / total if total > 0 else self.importance
        return self

    def _grow(self, x: np.ndarray, hot: np.ndarray, depth: int, rng, gain: np.ndarray, all_weight: float) -> tuple:
        sums = hot.sum(axis=0)
        weight = sums.sum()
        shares = sums / weight
        if depth == 0 or shares.max() > 1 - 1e-12:
            return (-1, 0.0, None, None, shares, weight)
        most, best, tried = int(max(1, np.sqrt(x.shape[1]))), None, 0
        for f in rng.permutation(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, left = x[order, f], np.cumsum(hot[order], axis=0)
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue  # a constant feature doesn't count as tried
            a, b = left[cuts], sums - left[cuts]
            wa, wb = a.sum(axis=1), b.sum(axis=1)
            drop = weight * (1 - (shares**2).sum()) - (wa - (a**2).sum(axis=1) / wa) - (wb - (b**2).sum(axis=1) / wb)
            k = int(drop.argmax())
            if best is None or drop[k] > best[0]:
                best = (drop[k], int(f), (v[cuts[k]] + v[cuts[k] + 1]) / 2)
            tried += 1
            if tried >= most:
                break
        if best is None:
            return (-1, 0.0, None, None, shares, weight)
        gain[best[1]] += max(best[0], 0) / all_weight
        down = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[down], hot[down], depth - 1, rng, gain, all_weight), self._grow(x[~down], hot[~down], depth - 1, rng, gain, all_weight), shares, weight)

    def proba(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes: the trees' mean shares; all rows go down a tree together."""
        out = np.zeros((len(x), len(self.classes)))

        def down(node: tuple, rows: np.ndarray) -> None:
            if node[0] < 0:
                out[rows] += node[4]
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                down(node[2], rows[left])
                down(node[3], rows[~left])

        for root in self.roots:
            down(root, np.arange(len(x)))
        return out / len(self.roots)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.proba(x).argmax(axis=1)]

    def permutation_importance(self, x: np.ndarray, y: np.ndarray, repeats: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the loss of accuracy when a feature is shuffled."""
        rng, base = np.random.RandomState(seed), (self.predict(x) == y).mean()
        drops = np.zeros((x.shape[1], repeats))
        for f in range(x.shape[1]):
            for r in range(repeats):
                z = x.copy()
                z[:, f] = rng.permutation(z[:, f])
                drops[f, r] = base - (self.predict(z) == y).mean()
        return drops.mean(axis=1), drops.std(axis=1)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Exact Shapley values (rows x features x classes) of the mean tree, unknown features averaged by weight."""

        def expect(node: tuple, row: np.ndarray, known: frozenset) -> np.ndarray:
            f, limit, left, right, shares, weight = node
            if f < 0:
                return shares
            if f in known:
                return expect(left if row[f] <= limit else right, row, known)
            return (left[5] * expect(left, row, known) + right[5] * expect(right, row, known)) / weight

        def used(node: tuple) -> set:
            return set() if node[0] < 0 else {node[0]} | used(node[2]) | used(node[3])

        out = np.zeros((len(x), x.shape[1], len(self.classes)))
        for root in self.roots:
            own = sorted(used(root))
            for i, row in enumerate(x):
                value = {s: expect(root, row, s) for n in range(len(own) + 1) for s in map(frozenset, combinations(own, n))}
                for s, v in value.items():
                    for f in own:
                        if f not in s:
                            share = factorial(len(s)) * factorial(len(own) - len(s) - 1) / factorial(len(own))
                            out[i, f] += share * (value[s | {f}] - v)
        return out / len(self.roots)


def shapley_importance(rows: DataFrame, forest: Forest) -> DataFrame:
    """``f, importance``: mean |Shapley value| over all rows and classes. Rows are explained where they are; a task
    gives one sum for each feature."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                total, n = total + np.abs(shared.value.shapley(x)).mean(axis=2).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), pa.array(total), pa.array(np.full(len(total), n, "int64"))], names=["f", "s", "n"])

    sums = rows.select("x").mapInArrow(explain, "f int, s double, n long")
    return sums.groupBy("f").agg((F.sum("s") / F.sum("n")).alias("importance"))
