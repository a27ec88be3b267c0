"""Whole analyses of two small layers, their report, and tables of importance."""

import numpy as np
import pytest

from blocklens.operators import evidence, latent, wide
from blocklens.plans import workflow

SCHEMA = "layer string, sample_id string, s_ord long, grp string, feature string, f_ord int, value double"


@pytest.fixture(scope="module")
def layers(spark):
    rng, rows = np.random.default_rng(0), []
    for layer, p in (("first", 5), ("second", 8)):
        x = np.exp(rng.normal(size=(12, p)))
        x[:, 0] *= 1 + 5 * (np.arange(12) // 4)
        rows += [(layer, f"s{i:02d}", i, "abc"[i // 4], f"{layer}{f}", f, float(x[i, f])) for i in range(12) for f in range(p)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


def test_report_of_all_parts(spark, layers):
    mode = workflow.Mode(permutations=2, bootstraps=3, trees=3, keep=2, network_min_features=6)
    own = {k: workflow.single_layer(layers.where(f"layer = '{k}'"), mode) for k in ("first", "second")}
    joint = {"joint": workflow.multi_layer(layers, ["first", "second"], mode), "alone": workflow.multi_layer(layers, ["second"], mode)}
    small = workflow.reduced_layers(layers, mode, ["a", "b", "c"])
    text = workflow.report(own, joint, workflow.reduction(layers, small), mode)
    lines = text.splitlines()
    assert "- Permutations: 2" in lines and "| first | 5 | 5 |" in lines and any(x.startswith("| second | 8 | ") for x in lines)
    test = own["first"]["tests"]["splsda"]
    assert f"| first | splsda | {test['true_accuracy']:.4f} | {test['mean_null']:.4f} | {test['std_null']:.4f} | 2 | {test['p_value']:.6f} |" in lines
    assert any(x.startswith("| joint | joint components | ") for x in lines) and any(x.startswith("| alone | fused forest | ") for x in lines)
    stable = [x for x in lines if x.startswith("| first | ") and x.endswith(" | n/a |") and "/" in x]
    assert len(stable) == 1 and stable[0].count("/5") == 2
    assert "n/a" in workflow.report({"x": own["first"] | {"tests": {"splsda": test | {"mean_null": None, "std_null": None}}}})


def test_tables_of_importance(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("z", None)], "feature string, vip double")
    b = spark.createDataFrame([("x", 0.5), ("z", 0.25), ("w", 9.0)], "feature string, vip double")
    got = {r.feature: (r.vip_own, r.vip_other) for r in evidence.merge_importance(a, b).collect()}
    assert got == {"x": (2.0, 0.5), "z": (None, 0.25)}
    tied = spark.createDataFrame([("b", 1.0, 1), ("a", 1.0, 1), ("c", None, 1), ("d", 3.0, 2)], "feature string, score double, module int")
    assert [(r.feature, r.place) for r in evidence.ranked(tied, "score", by=("module",)).collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 1)]


def test_scores_of_rows(spark):
    rng = np.random.default_rng(1)
    y = np.repeat(["a", "b"], 10)
    x = rng.normal(size=(20, 3)) + (y == "b")[:, None] * 3
    rows = spark.createDataFrame([(f"s{i}", str(g), [float(c) for c in v]) for i, (g, v) in enumerate(zip(y, x))], "sample_id string, grp string, x array<double>")
    m = wide.fit(rows, latent.SPLSDA(1))
    r = latent.score_rows(rows, m).first()
    assert r.n == 20 and r.accuracy == np.mean(np.array(m.predict(x), object) == y) > 0.9
