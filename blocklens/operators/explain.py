"""What a forest's features do, on any number of rows: Shapley values and shuffled columns of Spark ML forests.

A leaf is a box: the range of each feature that leads to it, the share of training weight that stays in each range, and its
class shares. Rows are held against boxes a batch at a time, so depth and number of trees only add boxes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import shared_folder
from .forest import Forest, train_forest

#: Rows that are explained together, and shuffled together.
ROWS, BLOCK = 1024, 4096


@dataclass
class Box:
    """Features of a leaf's path, each once; the range (low, high] of each that leads on; the share of the weight that
    does, over all splits of the feature; and the leaf's class shares."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def inside(self, x: np.ndarray) -> np.ndarray:
        """Rows x features of the path: whether the row's value leads on."""
        own = x[:, self.features]
        return (own > self.low) & (own <= self.high)


Trees = list[list[Box]]


def _boxes(nodes: dict, root, path: dict) -> list[Box]:
    feature, limit, left, right, weight, value = nodes[root]
    if feature < 0:
        order = sorted(path)
        columns = [np.array([path[f][k] for f in order], float) for k in range(3)]
        return [Box(np.array(order, int), *columns, value)]
    out = []
    for child, goes_left in ((left, True), (right, False)):
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        low, high = (low, min(high, limit)) if goes_left else (max(low, limit), high)
        out += _boxes(nodes, child, path | {feature: (low, high, share * nodes[child][4] / weight)})
    return out


def boxes_of(model: RandomForestClassificationModel, df: DataFrame) -> Trees:
    """The leaves of a fitted Spark ML forest with continuous features, as its own writer stores them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree = "treeID" if "treeID" in data.columns else data.columns[0]
    rows = data.select(F.col(tree).alias("tree"), "nodeData.*").collect()  # nodes of the model, whatever the rows
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    trees: dict[int, dict] = {}
    for r in rows:
        stats = np.array(r.impurityStats, float)
        leaf = r.leftChild < 0
        if not leaf and r.split.numCategories >= 0:
            raise ValueError("categorical features aren't explained")
        limit = 0.0 if leaf else r.split.leftCategoriesOrThreshold[0]
        trees.setdefault(r.tree, {})[r.id] = (-1 if leaf else r.split.featureIndex, limit, r.leftChild, r.rightChild, stats.sum(), stats / stats.sum())
    return [_boxes(trees[t], 0, {}) for t in sorted(trees)]


def boxes_of_local(forest: Forest) -> Trees:
    def numbered(node: tuple, nodes: dict) -> int:
        at = len(nodes)
        nodes[at] = None
        f, limit, left, right, shares, weight = node
        nodes[at] = (f, limit, *((numbered(left, nodes), numbered(right, nodes)) if f >= 0 else (-1, -1)), weight, shares)
        return at

    out = []
    for root in forest.roots:
        nodes: dict = {}
        numbered(root, nodes)
        out.append(_boxes(nodes, 0, {}))
    return out


def probabilities(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Rows x classes: the trees' mean shares."""
    return sum(_tree(t, x) for t in trees) / len(trees)


def _tree(boxes: list[Box], x: np.ndarray) -> np.ndarray:
    return sum(b.inside(x).all(axis=1)[:, None] * b.value[None, :] for b in boxes)


def expected(trees: Trees) -> np.ndarray:
    """Class shares when no feature is known."""
    return sum(b.share.prod() * b.value for t in trees for b in t) / len(trees)


def shapley(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values, rows x features x classes, of the trees' mean shares, unknown features averaged by weight.

    For a box with m features the other features known with a row are the terms of a product of (share + inside * t), one
    factor a feature; a term of k known ones weighs k! (m - 1 - k)! / m!. All rows of a batch go through it together.
    """
    q = len(trees[0][0].value)
    out = np.zeros((len(x), x.shape[1], q))
    for boxes in trees:
        for b in boxes:
            m = len(b.features)
            inside = b.inside(x).astype(float)
            weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
            for i, f in enumerate(b.features):
                terms = np.zeros((m, len(x)))
                terms[0] = 1.0
                for n, j in enumerate(j for j in range(m) if j != i):
                    more = terms * b.share[j]
                    more[1 : n + 2] += terms[: n + 1] * inside[:, j]
                    terms = more
                out[:, f] += ((weights @ terms) * (inside[:, i] - b.share[i]))[:, None] * b.value[None, :]
    return out / len(trees)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


def shapley_importance(rows: DataFrame, trees: Trees) -> DataFrame:
    """``f, importance``: mean |Shapley value| over all rows of ``x`` and classes; rows are explained where they are."""
    held = rows.sparkSession.sparkContext.broadcast(trees)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                total, n = total + np.abs(shapley(held.value, _matrix(some.column(0), some.num_rows))).mean(axis=2).sum(axis=0), n + some.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="int32")), pa.array(total), pa.array(np.full(len(total), n, "int64"))], names=["f", "s", "n"])

    sums = rows.select("x").mapInArrow(explain, "f int, s double, n long")
    return sums.groupBy("f").agg((F.sum("s") / F.sum("n")).alias("importance"))


def permutation_importance(rows: DataFrame, trees: Trees, classes: list, repeats: int = 10, seed: int = 42) -> DataFrame:
    """``f, mean, std``: loss of accuracy when a feature's values are shuffled, over ``repeats`` shuffles.

    Rows are dealt to blocks by their hashed id, about BLOCK of them each, and a task shuffles each feature's values
    inside its block; up to that many rows it is one shuffle of all. Only trees that use the feature are gone through again.
    """
    spark, blocks = rows.sparkSession, max(1, -(-rows.count() // BLOCK))
    held = spark.sparkContext.broadcast((trees, classes))
    dealt = rows.select(F.pmod(F.xxhash64(F.col("sample_id").cast("string")), F.lit(blocks)).alias("block"), F.col("sample_id").cast("string").alias("id"), "grp", F.col("x").cast("array<double>").alias("x"))

    def shuffle(table: pa.Table) -> pa.Table:
        forest, names = held.value
        table = table.combine_chunks().sort_by("id")
        x = _matrix(table.column("x").combine_chunks(), table.num_rows)
        label = np.array([names.index(g) if g in names else -1 for g in table.column("grp").to_pylist()])
        whole = [_tree(t, x) for t in forest]
        total = sum(whole)
        using: dict[int, list[int]] = {}
        for k, t in enumerate(forest):
            for f in {int(f) for b in t for f in b.features}:
                using.setdefault(f, []).append(k)
        base, out = int((total.argmax(axis=1) == label).sum()), []
        for f in range(x.shape[1]):
            own, rest = using.get(f, []), total - sum((whole[k] for k in using.get(f, [])), np.zeros_like(total))
            z = x.copy()
            for r in range(repeats):
                if own:
                    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(table.column("block")[0].as_py()), f, r])))
                    z[:, f] = x[rng.permutation(len(x)), f]
                    hits = int(((rest + sum(_tree(forest[k], z) for k in own)).argmax(axis=1) == label).sum())
                out.append((f, r, base - (hits if own else base), len(x)))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=["f", "r", "lost", "n"])

    each = dealt.groupBy("block").applyInArrow(shuffle, "f long, r long, lost long, n long").groupBy("f", "r").agg((F.sum("lost") / F.sum("n")).alias("drop"))
    return each.groupBy("f").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))


def cross_validate(rows: DataFrame, cv: int = 5, trees: int = 100, depth: int = 3, seed: int = 42) -> DataFrame:
    """``sample_id, grp, fold, predicted``: a Spark ML forest for each fold, trained on the other rows where they are;
    folds by the hashed sample id; of equal shares the first class."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(F.col("sample_id").cast("string")), F.lit(cv)).cast("int"))
    kind, fits = dict(rows.dtypes), {}
    for k in range(cv):
        train = dealt.where(F.col("fold") != k)
        model, classes = train_forest(train, trees, depth, seed)
        fits[k] = boxes_of(model, train), classes
    held = rows.sparkSession.sparkContext.broadcast(fits)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _matrix(batch.column(3), batch.num_rows), batch.column(2).to_numpy()
            out = np.empty(batch.num_rows, object)
            for k in np.unique(fold).tolist():
                forest, classes = held.value[k]
                out[fold == k] = np.array(classes, object)[probabilities(forest, x[fold == k]).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(out), batch.column(1).type)], names=["sample_id", "grp", "fold", "predicted"])

    return dealt.select("sample_id", "grp", "fold", F.col("x").cast("array<double>").alias("x")).mapInArrow(predict, f"sample_id {kind['sample_id']}, grp {kind['grp']}, fold int, predicted {kind['grp']}")
