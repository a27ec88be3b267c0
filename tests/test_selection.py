"""Exact medians and ranks of groups of any size, against NumPy, with passes and ranges of any number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens.functions import stats
from blocklens.operators import prep

SCHEMA = "layer string, sample_id string, s_ord long, grp string, feature string, f_ord int, value double"


@pytest.mark.parametrize("limits", [{}, {"LEFT": 3, "BUCKETS": 4}, {"LEFT": 1, "BUCKETS": 2, "RANKED": 5}])
def test_medians_and_ranks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(stats, name, value)
    rng = np.random.default_rng(0)
    columns = {"even": rng.normal(size=40), "ties": rng.integers(0, 3, 41).astype(float), "far": np.array([*rng.normal(size=30), 1e300, -1e300, 5.0]), "one": np.array([2.5]), "same": np.full(9, -1.0), "huge": np.array([1.7e308, -1.7e308, 3.0, 4.0])}
    rows = [("x", f"s{i}", i, None if i % 7 == 0 and name != "one" else "g", name, k, float(v)) for k, (name, c) in enumerate(columns.items()) for i, v in enumerate(c)]
    rows += [("x", f"n{i}", 99, "g", "even", 0, None) for i in range(3)] + [("x", "z", 99, "none", "one", 3, None)]
    obs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {}
    for layer, _, _, g, f, _, v in rows:
        want.setdefault((layer, f, g), []).append(v)
    got = {(r.layer, r.feature, r.grp): r.median for r in stats.medians(obs).collect()}
    assert got.keys() == want.keys()
    for k, vs in want.items():
        vs = np.sort([v for v in vs if v is not None])
        middle = None if not len(vs) else float(vs[(len(vs) - 1) // 2] / 2 + vs[len(vs) // 2] / 2)
        assert got[k] == middle or abs(got[k] - middle) < 1e-12 * abs(middle), k
    filled = prep.impute_group_median(obs.where("feature = 'even'")).where("sample_id like 'n%'").collect()
    assert {r.value for r in filled} == {got["x", "even", "g"]}
    ranked = {(r.feature, r.sample_id): r.value for r in stats.average_rank(obs).collect()}
    for f, c in columns.items():
        for i, v in enumerate(c):
            assert ranked[f, f"s{i}"] == (c < v).sum() + ((c == v).sum() + 1) / 2
    assert ranked["even", "n0"] is None and stats.medians(obs.where("false")).count() == 0 and stats.average_rank(obs.where("false")).count() == 0


def test_p_values_by_constant_work(spark):
    cases = [(-0.9486832980505138, 9), (0.5, 10), (0.3, 3), (0.0, 30), (1e-3, 10**7), (0.5, 10**7), (1.0, 5), (0.2, 2), (None, 9), (-0.02, 100_000)]
    got = [r.p for r in spark.createDataFrame([(k, r, n) for k, (r, n) in enumerate(cases)], "k int, r double, n long").select("k", stats.p_value(F.col("r"), F.col("n")).alias("p")).orderBy("k").collect()]
    for (r, n), p in zip(cases, got):
        if r is None or n < 3:
            assert p is None
        else:
            assert abs(p - stats.correlation_p(r, n)) <= 1e-9 * p + 1e-300
    assert abs(got[0] - 9.584590571920515e-05) < 1e-14 and abs(got[2] - (1 - 2 / np.pi * np.arcsin(0.3))) < 1e-12 and got[3] == 1.0 and got[5] == 0.0 and got[6] == 0.0
    assert abs(got[4] - 0.0015654) < 1e-6  # the normal tail at r sqrt(n)
