"""Correlations where values are missing, against the pairs taken one by one."""

import numpy as np
import pytest

from blocklens.functions import stats


def by_hand(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if both.any():
                out[i, j] = None if a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])
    return out


@pytest.mark.parametrize("cells, absent", [(None, False), (40, True)])
def test_missing_values(spark, monkeypatch, cells, absent):
    if cells:
        monkeypatch.setattr(stats, "MASKED_CELLS", cells)  # a pass for each feature
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1.0, size=(40, 7))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5] = np.where(np.isnan(x[:, 5]), np.nan, 3.0)
    x[:20, 0], x[20:, 6] = np.nan, np.nan  # no sample holds both
    whole = rng.normal(size=(12, 3))
    rows = [("x", f"s{n}", "g", f"f{f}", 2 * f, None if np.isnan(v) else float(v)) for (n, f), v in np.ndenumerate(x) if not (absent and np.isnan(v))]
    rows += [("y", f"s{n}", "g", f"f{f}", f, float(v)) for (n, f), v in np.ndenumerate(whole)]
    obs = spark.createDataFrame(rows, "layer string, sample_id string, grp string, feature string, f_ord int, value double").repartition(3)
    corr = stats.feature_correlations(obs)
    got = {(r.layer, r.i, r.j): r.r for r in corr.collect()}
    want = {("x", 2 * i, 2 * j): r for (i, j), r in by_hand(x).items()} | {("y", i, j): r for (i, j), r in by_hand(whole).items()}
    assert got.keys() == want.keys() and ("x", 0, 12) not in got
    assert all(got[k] is None if w is None else abs(got[k] - w) < 1e-7 for k, w in want.items())
    assert "Generate" not in corr.sparkSession._jvm.PythonSQLUtils.explainString(corr._jdf.queryExecution(), "formatted")
    ranked = stats.feature_correlations(obs.where("layer = 'y'"), "spearman").collect()
    order = by_hand(np.argsort(np.argsort(whole, axis=0), axis=0).astype(float))
    assert all(abs(r.r - order[r.i, r.j]) < 1e-9 for r in ranked)
