"""Shapley values and shuffled columns of Spark ML forests, against enumeration and against the model's own predictions."""

import numpy as np
import pytest

from blocklens.operators import explain, forest


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = np.where(x[:, 0] + x[:, 1] > 0.5, "b", np.where(x[:, 2] > 0.8, "c", "a"))
    return x, y, spark.createDataFrame([(f"s{i}", str(g), [float(c) for c in v]) for i, (v, g) in enumerate(zip(x, y))], "sample_id string, grp string, x array<double>").repartition(3).cache()


@pytest.mark.parametrize("depth", [3, 6])
def test_shapley_values_equal_enumeration(data, depth):
    x, y, _ = data
    local = forest.Forest(4, depth).fit(x[:120], y[:120])
    trees = explain.boxes_of_local(local)
    assert np.allclose(explain.probabilities(trees, x[:40]), local.proba(x[:40]))
    got = explain.shapley(trees, x[:20])
    assert np.allclose(got.sum(axis=1) + explain.expected(trees), local.proba(x[:20]))
    assert np.allclose(got, local.shapley(x[:20]))


def test_a_spark_forest_as_boxes(data):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x, y, rows = data
    model, classes = forest.train_forest(rows, 20, 4)
    trees = explain.boxes_of(model, rows)
    assert len(trees) == 20 and max(len(b.features) for t in trees for b in t) <= 4
    out = model.transform(rows.withColumn("features", array_to_vector("x"))).select("sample_id", vector_to_array("probability").alias("p"), "prediction").collect()
    own = explain.probabilities(trees, x)
    assert all(np.allclose(own[int(r.sample_id[1:])], r.p) and own[int(r.sample_id[1:])].argmax() == r.prediction for r in out)
    values = explain.shapley(trees, x)
    assert np.allclose(values.sum(axis=1) + explain.expected(trees), own)
    got = {r.f: r.importance for r in explain.shapley_importance(rows, trees).collect()}
    assert np.allclose([got[f] for f in range(6)], np.abs(values).mean(axis=(0, 2)))
    assert min(got[0], got[1], got[2]) > max(got[3], got[4], got[5])


def test_shuffled_columns(data, monkeypatch):
    x, y, rows = data
    model, classes = forest.train_forest(rows, 20, 4)
    trees = explain.boxes_of(model, rows)
    got = {r.f: (r.mean, r.std) for r in explain.permutation_importance(rows, trees, classes, 10).collect()}
    base, rng = (np.array(classes)[explain.probabilities(trees, x).argmax(axis=1)] == y).mean(), np.random.default_rng(1)
    for f in range(6):
        drops = []
        for _ in range(20):
            z = x.copy()
            z[:, f] = rng.permutation(z[:, f])
            drops.append(base - (np.array(classes)[explain.probabilities(trees, z).argmax(axis=1)] == y).mean())
        assert abs(got[f][0] - np.mean(drops)) < 5 * (np.std(drops) + 0.003) / np.sqrt(10) and got[f][1] < 0.1
    again = {r.f: (r.mean, r.std) for r in explain.permutation_importance(rows.repartition(2), trees, classes, 10).collect()}
    assert again == got
    monkeypatch.setattr(explain, "BLOCK", 50)  # several blocks
    blocks = {r.f: r.mean for r in explain.permutation_importance(rows, trees, classes, 10).collect()}
    assert all(abs(blocks[f] - got[f][0]) < 0.08 for f in range(6))


def test_cross_validation(data):
    _, _, rows = data
    got = explain.cross_validate(rows, 3, 10).collect()
    assert len(got) == 300 and {r.fold for r in got} == {0, 1, 2} and np.mean([r.grp == r.predicted for r in got]) > 0.75
