"""Forests of all permutations grown where the rows are, against trees grown from the whole matrix with the same draws."""

import inspect

import numpy as np
import pytest
from blocklens.operators import forest_rows, resample
from blocklens.operators.rowwise import multiplicities, number_rows, permuted


def _grow(x, count, label, weights, tries, most, node, depth):
    """``{node: (feature, limit, shares)}``, every cut of every feature tried."""
    hot = np.eye(len(weights))[label] * count[:, None]
    sums = hot.sum(axis=0) * weights
    shares, best, tried = sums / sums.sum(), None, 0
    if node < (1 << depth) - 1 and shares.max() <= 1 - 1e-12:
        for f in tries[node]:
            values = np.unique(x[:, f])
            for low, high in zip(values[:-1], values[1:]):
                one = hot[x[:, f] <= low].sum(axis=0) * weights
                other = sums - one
                drop = sums.sum() - (sums**2).sum() / sums.sum() - (one.sum() - (one**2).sum() / one.sum()) - (other.sum() - (other**2).sum() / other.sum())
                if best is None or drop > best[0] + 1e-9:
                    best = drop, f, (low + high) / 2
            tried += len(values) > 1
            if tried == most:
                break
    if best is None:
        return {node: (-1, 0.0, shares)}
    down = x[:, best[1]] <= best[2]
    parts = [_grow(x[own], count[own], label[own], weights, tries, most, 2 * node + k, depth) for k, own in ((1, down), (2, ~down))]
    return {node: (best[1], best[2], shares)} | parts[0] | parts[1]


def _whole(rows, trees, depth, seed, n_permutations, cv):
    """The same test from the whole matrix."""
    known = number_rows(rows)
    got = sorted(known.rows.collect(), key=lambda r: r.number)
    x, edges, q = np.array([r.x for r in got]), known.edges, len(known.classes)
    number, p = np.arange(len(x)), x.shape[1]
    truth = permuted(edges, number, None)
    fold = (number - edges[truth]) % cv
    draws, keys = forest_rows.Draws(edges, cv, trees, seed), np.random.RandomState(seed).randint(0, 1 << 31, n_permutations)
    rng = np.random.RandomState(seed + 1)
    tries = [[[f for f in rng.permutation(p) if np.ptp(x[:, f]) > 0] for _ in range((1 << depth) - 1)] for _ in range(trees)]
    out = []
    for key in [None, *keys]:
        label, hits = permuted(edges, number, None if key is None else int(key)), 0
        for f in range(cv):
            own, votes = np.flatnonzero(fold != f), np.zeros(((fold == f).sum(), q))
            there = np.bincount(label[own], minlength=q)
            weights = np.where(there > 0, len(own) / ((there > 0).sum() * np.maximum(there, 1)), 0.0)
            for t in range(trees):
                bag = draws.bag(own, f, t)
                assert bag.sum() == len(own)
                tree = _grow(x[own][bag > 0], bag[bag > 0], label[own][bag > 0], weights, tries[t], int(max(1, np.sqrt(p))), 0, depth)
                for i, row in enumerate(x[fold == f]):
                    at = 0
                    while tree[at][0] >= 0:
                        at = 2 * at + 2 - (row[tree[at][0]] <= tree[at][1])
                    votes[i] += tree[at][2]
            hits += (votes.argmax(axis=1) == label[fold == f]).sum()
        out.append(hits / len(x))
    return out


@pytest.mark.parametrize("section", [16_384, 20])
def test_equals_whole_trees(spark, monkeypatch, section):
    monkeypatch.setattr(forest_rows, "SECTION", section)
    monkeypatch.setattr(forest_rows, "TOGETHER", 4)
    rng = np.random.RandomState(3)
    x = rng.normal(size=(150, 7))
    x[:, 1], x[:, 2], x[:90, 3], x[:, 4] = 5.0, rng.randint(0, 4, 150), 0.25, np.round(x[:, 4], 1)  # constant, few, one very frequent, repeated values
    x[100:, 5] = np.where(x[100:, 0] > 0, 1.0, 2.0)
    y = np.where(x[:, 0] + rng.normal(size=150) / 2 > 0, "b", "a")
    y[:10] = "c"
    rows = spark.createDataFrame([(f"s{i}", str(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(y, x))], "sample_id string, grp string, x array<double>")
    got = forest_rows.permutation_test(rows, 3, 3, 7, 5, min_perms=5, cv=3)
    assert [got["true_accuracy"], *got["null"]] == _whole(rows, 3, 3, 7, 5, 3)
    assert got["true_accuracy"] > max(got["null"])


def test_frequent_values_are_sent_as_draws(spark, monkeypatch):
    """A value of many rows is one small row for each task and tree, and nothing changes by it."""
    monkeypatch.setattr(forest_rows, "SECTION", 16)
    x = np.tile(np.array([[0.0, 1.0, 2.0, 3.0]]), (600, 1))
    x[::10] += np.arange(60)[:, None] % 7
    y = np.arange(600) // 10 % 7 % 2
    rows = spark.createDataFrame([(f"s{i}", str(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(y, x))], "sample_id string, grp string, x array<double>")
    got = forest_rows.permutation_test(rows, 2, 2, 1, 3, min_perms=3, cv=2)
    assert [got["true_accuracy"], *got["null"]] == _whole(rows, 2, 2, 1, 3, 2)


def test_more_rows_than_a_matrix_may_have(spark, monkeypatch):
    """The query holds no matrix: more values than may be broadcast don't stop it."""
    import __spark_entry__

    monkeypatch.setattr(resample, "MAX_CELLS", 1_000)
    got = __spark_entry__.queries()["q_forest_permutation"](spark, "/root/testdata/sf0.001").collect()
    assert [r.perm for r in got] == list(range(50)) and len({r.true_accuracy for r in got}) == 1


def _each_left_out(rows, trees, depth, seed, n_permutations):
    """Leave-one-out from the whole matrix: a forest for each row, grown without it."""
    known = number_rows(rows)
    got = sorted(known.rows.collect(), key=lambda r: r.number)
    x, edges, q = np.array([r.x for r in got]), known.edges, len(known.classes)
    n, p = x.shape
    number, key, bags = np.arange(n), int(np.random.RandomState(seed).randint(0, 1 << 31)), []
    while not bags or (np.array([b == 0 for b in bags]).sum(axis=0) < trees).any():
        bags.append(multiplicities(number, np.array([0, n]), key + len(bags), n - 1))
        assert bags[-1].sum() == n - 1
    rng = np.random.RandomState(seed + 1)
    tries = [[[f for f in rng.permutation(p) if np.ptp(x[:, f]) > 0] for _ in range((1 << depth) - 1)] for _ in bags]
    out = []
    for k in [None, *np.random.RandomState(seed).randint(0, 1 << 31, n_permutations)]:
        label, hits = permuted(edges, number, None if k is None else int(k)), 0
        for i in range(n):
            others = number[number != i]
            there, votes = np.bincount(label[others], minlength=q), np.zeros(q)
            weights = np.where(there > 0, 1 / ((there > 0).sum() * np.maximum(there, 1)), 0.0)
            for u in [u for u, b in enumerate(bags) if b[i] == 0][:trees]:
                bag = np.flatnonzero(bags[u])
                assert i not in bag
                tree, at = _grow(x[bag], bags[u][bag], label[bag], (n - 1) * weights, tries[u], int(max(1, np.sqrt(p))), 0, depth), 0
                while tree[at][0] >= 0:
                    at = 2 * at + 2 - (x[i, tree[at][0]] <= tree[at][1])
                votes += tree[at][2]
            hits += votes.argmax() == label[i]
        out.append(hits / n)
    return out


@pytest.mark.parametrize("section, sent", [(16_384, 1 << 40), (10, 10_000)])
def test_each_row_left_out(spark, monkeypatch, section, sent):
    """Small classes, whose weights differ much by the row left out, and a class of one row."""
    monkeypatch.setattr(forest_rows, "SECTION", section)
    monkeypatch.setattr(forest_rows, "SENT", sent)
    rng = np.random.RandomState(5)
    x = rng.normal(size=(40, 5))
    x[:, 1], x[:, 2], x[:30, 3] = 2.0, rng.randint(0, 3, 40), 0.5  # constant, few, one very frequent
    y = np.where(x[:, 0] + rng.normal(size=40) / 2 > 0, "b", "a")
    y[:4], y[4:6], y[6] = "c", "d", "e"
    rows = spark.createDataFrame([(f"s{i}", str(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(y, x))], "sample_id string, grp string, x array<double>")
    got = forest_rows.permutation_test(rows, 4, 3, 7, 4, min_perms=4)
    assert [got["true_accuracy"], *got["null"]] == _each_left_out(rows, 4, 3, 7, 4)


def test_weighings_agree_with_all_cuts_weighed():
    """Leaving out cuts that can't be the best of a weighing changes no best cut."""
    rng = np.random.RandomState(2)
    for n in (7, 30, 400):
        label, drawn, v = rng.randint(0, 3, (n, 2)), rng.randint(1, 4, n), np.sort(np.round(rng.normal(size=n), 1 if n == 30 else 9))
        label[:3] = np.arange(3)[:, None]
        counts = np.stack([np.bincount(label[:, s], drawn, 3) for s in range(2)])[:, None]
        weights = rng.uniform(0.5, 1, (2, 1, 3)) * (1 + np.eye(3) * rng.choice([0.01, 0.5, 1.0]))
        found = forest_rows.Search(counts, weights, [0])
        for a in range(0, n, 100):
            found.rows(v[a : a + 100], drawn[a : a + 100], label[a : a + 100])
        for s in range(2):
            for w in range(3):
                tree = _grow(v[:, None], drawn, label[:, s], weights[s, w], [[0]], 1, 0, 1)
                assert found.limit[s, w] == tree[0][1]
                assert (found.taken[s, w] == np.bincount(label[v <= tree[0][1], s], drawn[v <= tree[0][1]], 3)).all()


def test_query_does_the_whole_test(spark, monkeypatch):
    """100 trees, each row left out by itself, and as many permutations as the stop rule asks for."""
    import __spark_entry__

    whole, seen = inspect.signature(forest_rows.permutation_test), []
    monkeypatch.setattr(forest_rows, "permutation_test", lambda *a, **b: seen.append(whole.bind(*a, **b)) or {"null": [0.5], "true_accuracy": 0.5, "p_value": 1.0})
    __spark_entry__.queries()["q_forest_permutation"](spark, "/root/testdata/sf0.001")
    seen[0].apply_defaults()
    got = seen[0].arguments
    assert (got["trees"], got["depth"], got["cv"]) == (100, 3, None) and got["n_permutations"] >= 200 and got["min_perms"] == 50
