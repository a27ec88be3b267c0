"""Fits through products and resampling where the rows are, against X'X and against plain loops on one machine."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blocklens.operators import latent, resample, rowwise, wide
from blocklens.operators.latent import DIABLO, SPLSDA, Moments


def table(n, p, seed, classes="abc"):
    rng = np.random.default_rng(seed)
    y = np.array([classes[i % len(classes)] for i in range(n)], object)
    x = rng.normal(size=(n, p))
    x[:, : p // 2] += rng.normal(size=(len(classes), p // 2))[[classes.index(c) for c in y]]
    return x, y


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 14), st.integers(4, 40), st.integers(0, 1000), st.sampled_from([None, 1, 3]))
def test_products_of_samples_equal_products_of_features(n, p, seed, keep):
    x, y = table(n, p, seed)
    a, b = SPLSDA(2, keep).fit(Moments.of(x, y)), wide.fit_data(SPLSDA(2, keep), wide.Rows.of(x, y))
    assert np.allclose(a.vip, b.vip, rtol=0, atol=1e-9) and np.allclose(a.w, b.w, rtol=0, atol=1e-9) and np.allclose(a.mean, b.mean)
    k = p // 2
    kept = keep and [[keep] * 2] * 2
    a, b = DIABLO([k, p - k], 2, kept).fit(Moments.of(x, y)), wide.fit_data(DIABLO([k, p - k], 2, kept), wide.Rows.of(x, y))
    assert np.allclose(np.abs(a.w), np.abs(b.w), rtol=0, atol=1e-6) and np.allclose(a.block_corr, b.block_corr, rtol=0, atol=1e-6)


def test_few_samples_of_many_features():
    x, y = table(9, 5319, 0)
    m = wide.fit_matrix(SPLSDA(2, 5), x, y)
    assert (np.count_nonzero(m.w, axis=0) == 5).all() and m.predict(x) == list(y)
    assert np.allclose(m.scores(x).T @ m.scores(x), np.diag(np.diag(m.scores(x).T @ m.scores(x))), atol=1e-6)  # components don't correlate


@pytest.fixture(scope="module")
def rows(spark):
    x, y = table(60, 7, 3)
    return spark.createDataFrame([(f"s{i}", str(g), [float(c) for c in v]) for i, (v, g) in enumerate(zip(x, y))], "sample_id string, grp string, x array<double>").repartition(3).cache()


def held(rows):
    got = sorted(rows.collect(), key=lambda r: int(r.sample_id[1:]))
    return [r.sample_id for r in got], np.array([r.x for r in got]), np.array([r.grp for r in got], object)


def test_passes(rows, monkeypatch):
    monkeypatch.setattr(wide, "PIECE", 3)
    want = SPLSDA(2, 3, tol=1e-13).fit(latent.gather_moments(rows))
    got = wide.fit_data(SPLSDA(2, 3), wide.Passes(rows))
    assert np.allclose(got.vip, want.vip, atol=1e-9) and np.allclose(got.rotation, want.rotation, atol=1e-9) and np.allclose(got.q, want.q, atol=1e-9)
    want, got = (f(DIABLO([4, 3], 2, [[2, 3], [2, 2]], max_iter=25)) for f in (lambda m: m.fit(latent.gather_moments(rows)), lambda m: wide.fit_data(m, wide.Passes(rows))))
    assert np.allclose(np.abs(got.w), np.abs(want.w), atol=1e-5) and np.allclose(got.block_corr, want.block_corr, atol=1e-5)


def test_the_shape_chooses(rows, monkeypatch):
    used = []
    monkeypatch.setattr(wide, "fit_data", lambda model, data: used.append(type(data)) or model)
    monkeypatch.setattr(SPLSDA, "fit", lambda self, m: used.append(Moments) or self)
    wide.fit(rows, SPLSDA())
    wide.fit(rows.limit(5), SPLSDA())
    monkeypatch.setattr(wide, "ROWS_CELLS", 14)
    wide.fit(rows.limit(5), SPLSDA())
    monkeypatch.setattr(wide, "MAX_FEATURES", 6)
    wide.fit(rows, SPLSDA())
    assert used == [Moments, wide.Rows, Moments, wide.Passes]
    with pytest.raises(ValueError):
        wide.fit(rows.where("false"), SPLSDA())


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1025])
def test_shuffled_is_a_permutation(n):
    seen = [rowwise.shuffled(np.arange(n), n, k) for k in range(30)]
    assert all(sorted(s) == list(range(n)) for s in seen)
    if n == 100:
        assert len({tuple(s) for s in seen}) == 30 and 30 < np.mean(seen, axis=0).min() and np.mean(seen, axis=0).max() < 70


def test_multiplicities_add_up(monkeypatch):
    monkeypatch.setattr(rowwise, "LEAF", 16)
    edges = np.array([0, 500, 503, 503, 900])
    whole = rowwise.multiplicities(np.arange(900), edges, 7)
    assert [int(whole[a:b].sum()) for a, b in zip(edges, edges[1:])] == [500, 3, 0, 397]
    some = np.random.default_rng(0).permutation(900)[:100]
    assert (rowwise.multiplicities(some, edges, 7) == whole[some]).all() and abs((whole == 0).mean() - np.exp(-1)) < 0.05
    assert abs(np.mean([rowwise.multiplicities(np.arange(900), edges, k)[:500] for k in range(40)], axis=0).mean() - 1) < 1e-9


def test_leave_one_out(rows):
    ids, x, y = held(rows)
    for model, local in ((SPLSDA(2, 3), resample.splsda_predictor(2, 3)), (DIABLO([4, 3]), resample.diablo_predictor([4, 3]))):
        got = {r.sample_id: (r.grp, r.fold, r.predicted) for r in rowwise.cross_validate(rows, model.fit).collect()}
        assert [got[i] for i in ids] == list(zip(y, ids, resample.cross_predict(local, x, y)))


def test_folds_are_even(rows):
    got = rowwise.cross_validate(rows, SPLSDA(2, 3).fit, 4).collect()
    sizes = {}
    for r in got:
        sizes[r.grp, r.fold] = sizes.get((r.grp, r.fold), 0) + 1
    assert sizes == {(c, f): 5 for c in "abc" for f in range(4)}
    ids, x, y = held(rows)
    fold, predicted = ({r.sample_id: r[k] for r in got} for k in ("fold", "predicted"))
    f = np.array([fold[i] for i in ids])
    for k in range(4):
        want = SPLSDA(2, 3).fit(Moments.of(x[f != k], y[f != k])).predict(x[f == k])
        assert [predicted[i] for i, own in zip(ids, f == k) if own] == want


def test_rare_classes_never_win_without_samples(spark):
    rows = spark.createDataFrame([(f"s{i}", "rare" if i == 0 else "ab"[i % 2], [float(i % 2), float(i % 3), 1.0]) for i in range(12)], "sample_id string, grp string, x array<double>")
    got = {r.sample_id: r.predicted for r in rowwise.cross_validate(rows, SPLSDA(1).fit).collect()}
    assert got["s0"] != "rare" and [got[f"s{i}"] for i in range(1, 12)].count("rare") == 0
    with pytest.raises(ValueError):
        rowwise.number_rows(rows.where("false"))


def test_permutations_by_hand(rows, monkeypatch):
    r = rowwise.permutation_test(rows, SPLSDA(2, 3).fit, 60, min_perms=50, check_every=10, cv=3)
    known = rowwise.number_rows(rows)
    n = {s.sample_id: s.number for s in known.rows.collect()}
    ids, x, y = held(rows)
    number = np.array([n[i] for i in ids])
    assert sorted(number) == list(range(60)) and [y[list(number).index(i)] for i in (0, 19, 20, 59)] == ["a", "a", "b", "c"]
    fold = (number % 20) % 3
    keys = np.random.RandomState(42).randint(0, 1 << 31, 60)

    def accuracy(labels):
        hits = sum(int((np.array(SPLSDA(2, 3).fit(Moments.of(x[fold != k], labels[fold != k])).predict(x[fold == k]), object) == labels[fold == k]).sum()) for k in range(3))
        return hits / 60

    assert r["true_accuracy"] == accuracy(y)
    want = [accuracy(np.array(["abc"[v // 20] for v in rowwise.shuffled(number, 60, int(k))], object)) for k in keys[: len(r["null"])]]
    assert r["null"] == want and r["n_permutations_run"] == len(want) >= 50
    monkeypatch.setattr(rowwise, "PASS_CELLS", 200)  # few permutations a pass
    again = rowwise.permutation_test(rows, SPLSDA(2, 3).fit, 20, cv=3)
    assert again["null"] == want[:20] and not again["stopped_early"]


def test_stability_by_hand(rows, monkeypatch):
    known = rowwise.number_rows(rows)
    n = {s.sample_id: s.number for s in known.rows.collect()}
    ids, x, y = held(rows)
    number, keys = np.array([n[i] for i in ids]), np.random.RandomState(42).randint(0, 1 << 31, 12)
    for model, cells in ((SPLSDA(2, 2), None), (SPLSDA(2), 300), (DIABLO([4, 3], 2, [[1, 2], [1, 1]]), None)):
        if cells:
            monkeypatch.setattr(rowwise, "PASS_CELLS", cells)
        got = {r.f: r for r in rowwise.stability_selection(rows, model.fit, 12).collect()}
        chosen, values = [], []
        for k in keys:
            draw = np.repeat(np.arange(60), rowwise.multiplicities(number, known.edges, int(k)))
            m = model.fit(Moments.of(x[draw], y[draw]))
            values.append(np.concatenate(m.vips()) if isinstance(m, DIABLO) else m.vip)
            chosen.append((m.w != 0).any(axis=1) if m.keep else values[-1] >= 1)
        for f in range(7):
            assert abs(got[f].selection_frequency - np.mean(chosen, axis=0)[f]) < 1e-12 and abs(got[f].mean_vip - np.mean(values, axis=0)[f]) < 1e-9
            assert abs(got[f].std_vip - np.std(values, axis=0)[f]) < 1e-9 and got[f].stable == (np.mean(chosen, axis=0)[f] >= 0.8)
