"""Threshold models over rows: conjugate gradients, folds, and permuted labels, against fits on one machine."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.operators import ordinal, rowwise
from blocklens.operators.ordinal import Ordinal


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    y = np.repeat([0, 1, 2], 14)
    x = rng.normal(size=(42, 5))
    x[:, 0] += 3 * y
    return spark.createDataFrame([(f"s{i}", int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(y, x))], "sample_id string, y int, x array<double>").repartition(3).cache()


def held(rows):
    got = sorted(rows.collect(), key=lambda r: int(r.sample_id[1:]))
    return [r.sample_id for r in got], np.array([r.x for r in got]), np.array([r.y for r in got])


@settings(max_examples=20, deadline=None)
@given(st.integers(4, 12), st.integers(2, 30), st.integers(0, 99), st.sampled_from(ordinal.MODELS))
def test_steps_of_all_kinds_agree(n, p, seed, model):
    """Hessians, conjugate gradients, and (for more features than rows) the rows' own basis."""
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, p)), np.arange(n) % 3
    z, omega = (x - x.min(axis=0)) / np.ptp(x, axis=0), ordinal.threshold_weights(model, 3)
    losses = lambda tries: [ordinal._losses(z, y, omega, tries[0])]
    dense = ordinal._newton([ordinal._start(p, 3)], p, 1.0, lambda vs: ordinal._dense_steps(vs, p, 1.0, lambda at: [ordinal._slopes(z, y, omega, at[0])]), losses)[0]
    free = ordinal._newton([ordinal._start(p, 3)], p, 1.0, lambda vs: ordinal._conjugate_steps(vs, p, 1.0, lambda at: [ordinal._gradient(z, y, omega, at[0])], lambda at: [ordinal._product(z, y, omega, at[0])]), losses)[0]
    own = Ordinal(model).fit(x, y)
    assert np.allclose(dense, free, atol=1e-7) and np.allclose(own.w, dense[:p], atol=1e-7) and np.allclose(own.theta, np.sort(dense[p:]), atol=1e-7)


@pytest.mark.parametrize("most", [500, 3])
def test_fits_over_rows(rows, monkeypatch, most):
    monkeypatch.setattr(ordinal, "MAX_DENSE", most)
    ids, x, y = held(rows)
    for (model, _), got in ordinal.fit_rows(rows).items():
        want = Ordinal(model).fit(x, y)
        assert np.allclose(got.w, want.w, atol=1e-7) and np.allclose(got.theta, want.theta, atol=1e-7)
    dealt = ordinal.with_folds(rows, 3)
    fold = {r.sample_id: r.fold for r in dealt.collect()}
    f = np.array([fold[i] for i in ids])
    fits = ordinal.fit_rows(dealt, ("AT",), cv=3)
    each = [Ordinal("AT").fit(x[f != k], y[f != k]) for k in range(3)]
    assert np.allclose([w for _, _, w in ordinal.mean_coefficients(fits)], np.mean([m.w for m in each], axis=0), atol=1e-7)
    predicted = {r.sample_id: r.predicted for r in ordinal.predict_folds(dealt, fits).collect()}
    assert all(predicted[i] == each[k].predict(x[n : n + 1])[0] for n, (i, k) in enumerate(zip(ids, f)))


def test_permuted_labels(rows):
    r = ordinal.permutation_test(rows, "AT", n_permutations=6, min_perms=6, cv=3)
    known = rowwise.number_rows(rows.withColumnRenamed("y", "grp"))
    n = {s.sample_id: s.number for s in known.rows.collect()}
    ids, x, y = held(rows)
    number = np.array([n[i] for i in ids])
    fold, keys = (number % 14) % 3, np.random.RandomState(42).randint(0, 1 << 31, 6)
    assert sorted(number) == list(range(42)) and (number // 14 == y).all()

    def accuracy(labels):
        return sum(int((Ordinal("AT").fit(x[fold != k], labels[fold != k]).predict(x[fold == k]) == labels[fold == k]).sum()) for k in range(3)) / 42

    assert r["true_accuracy"] == accuracy(y)
    assert np.allclose(r["null"], [accuracy(rowwise.shuffled(number, 42, int(k)) // 14) for k in keys])
