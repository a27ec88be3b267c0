import numpy as np
import pytest
from pyspark.sql import functions as F

from blocklens.functions import stats
from blocklens.operators import forest, latent, network, ordinal, prep, resample
from blocklens.operators.forest import Forest
from blocklens.sources import layers

OBS = layers.OBS


def obs(spark, columns, groups="aabb", layer="l"):
    rows = [(layer, f"s{i}", i, g, name, f, None if v[i] is None else float(v[i])) for f, (name, v) in enumerate(columns.items()) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, OBS)


def values(df):
    out = {}
    for r in df.orderBy("feature", "s_ord").collect():
        out.setdefault(r.feature, []).append(r.value)
    return out


def test_csv_with_odd_names(spark, tmp_path):
    path = tmp_path / "layer.csv"
    path.write_text('﻿Sample,Groups,"a,b",c.d : Conc. (nM)\nz,g1,1,2.5\nb,g2,,3\n', encoding="utf-8")
    got = layers.load_layers(spark, {"one": str(path), "none": str(tmp_path / "missing.csv")})
    assert [(r.sample_id, r.feature, r.value) for r in got.orderBy("s_ord", "f_ord").collect()] == [("z", "a,b", 1.0), ("z", "c.d : Conc. (nM)", 2.5), ("b", "a,b", None), ("b", "c.d : Conc. (nM)", 3.0)]
    path.write_text(",Groups,x\ns1,g,1\n")
    assert layers.load_layer(spark, str(path), "one").first().sample_id == "s1"


def test_unnamed_column_beside_sample(spark, tmp_path):
    path = tmp_path / "layer.csv"
    path.write_text("Unnamed: 0,Sample,Groups,x\n0,s1,g,1\n")
    got = layers.load_layer(spark, str(path), "one").orderBy("f_ord").collect()
    assert [(r.sample_id, r.feature) for r in got] == [("s1", "Unnamed: 0"), ("s1", "x")]
    table = spark.createDataFrame([("a", 1.5)], "feature string, v double")
    for fmt in ("parquet", "csv"):
        layers.save_table(table, str(tmp_path / fmt), fmt)
        assert layers.load_table(spark, str(tmp_path / fmt), fmt).collect() == table.collect()


def test_names_for_display(spark):
    want = {"a 0.0 : Conc. (nM)": "a 0.0", "p_q;r..r : Conc. (nM)": "q;r..r", "a..a;b..b Area": "a..a;b..b", "x_ y_0.0 0.0 : Conc. (nM)": "y", "abcdefghijkl;mnopqrstu": "abcdefghijkl", "a;b": "a;b", "k_v;mnopqrstuvwxyzabcdefgh": "k_v"}
    rows = spark.createDataFrame([(k,) for k in want], "f string").select("f", prep.short_feature_name(F.col("f")).alias("s")).collect()
    assert {r.f: r.s for r in rows} == want
    shown = spark.createDataFrame([(None,), (0.0,), (float("nan"),), (0.8,), (0.5,)], "v double").select(prep.stability_text(F.col("v")).alias("t")).collect()
    assert [r.t.text for r in shown] == ["\u2014"] * 3 + ["0.80", "0.50"] and [r.t.weight for r in shown][3:] == ["bold", "normal"]


def test_order_of_samples(spark):
    """Sample ids are numbered in their order, whatever the rows' order."""
    ids = [f"s{i}" for i in (3, 10, 1, 20, 2)]
    rows = [(layer, s, 9, "g", "x", 0, 1.0) for layer in ("l", "m") for s in ids] + [("l", "only", 9, "g", "x", 0, 1.0)]
    got = prep.align_blocks(spark.createDataFrame(rows, OBS)).select("sample_id", "s_ord").distinct().collect()
    assert {r.sample_id: r.s_ord for r in got} == {s: i for i, s in enumerate(sorted(ids))}


def test_steps_equal_the_chain(spark):
    """The two passes of prepare_block give what the steps give one after the other; no row is shuffled by feature."""
    rng = np.random.RandomState(11)
    cols = {f"f{i}": [None if rng.rand() < 0.2 else float(v) for v in rng.randn(12) * 3 + i] for i in range(5)}
    cols |= {"c": [2.0] * 12, "gone": [None] * 11 + [1.0], "half": [1.0, 2.0] + [None] * 5 + [3.0] * 5}
    o = obs(spark, cols, "abc" * 4)
    chain = prep.pareto_scale(prep.log_transform(prep.drop_constant_features(prep.impute_half_min(prep.drop_sparse_features(o)))))
    a, b = values(chain), values(prep.prepare_block(o))
    assert a.keys() == b.keys() and "c" not in a and "gone" not in a and all(np.allclose(a[k], b[k]) for k in a)
    assert "Window" not in prep.prepare_block(o)._jdf.queryExecution().toString()


def test_ranks_over_ranges(spark):
    rng = np.random.RandomState(12)
    v = [None if rng.rand() < 0.1 else float(rng.randint(0, 40)) for _ in range(300)]
    got = values(stats.average_rank(obs(spark, {"x": v, "y": [1.0] * 300}, ["a"] * 300)))
    known = np.array([a for a in v if a is not None])
    assert got["x"] == [None if a is None else (known < a).sum() + ((known == a).sum() + 1) / 2 for a in v] and set(got["y"]) == {150.5}


def test_correlations_with_missing_values(spark):
    rng = np.random.RandomState(13)
    x = rng.randn(30, 4)
    gaps = [[None if rng.rand() < 0.2 else float(v) for v in x[:, j]] for j in range(4)]
    got = {(r.i, r.j): r.r for r in stats.feature_correlations(obs(spark, {f"f{j}": gaps[j] for j in range(4)}, ["a"] * 30)).collect()}
    for (i, j), r in got.items():
        both = [(a, b) for a, b in zip(gaps[i], gaps[j]) if a is not None and b is not None]
        assert abs(r - np.corrcoef(np.array(both).T)[0, 1]) < 1e-9
    assert len(got) == 6
    full = {(r.i, r.j): r.r for r in stats.feature_correlations(obs(spark, {"a": list(x[:, 0]), "b": list(x[:, 1]), "c": [1.0] * 30}, ["a"] * 30)).collect()}
    assert abs(full[0, 1] - np.corrcoef(x[:, :2].T)[0, 1]) < 1e-9 and full[0, 2] is None


def test_leaf_order():
    merges = np.array([[0, 2, 0.1, 2], [1, 3, 0.2, 2], [4, 5, 0.9, 4]])
    assert network.leaf_order(merges) == [0, 2, 1, 3]


def test_ordinal_models_where_the_rows_are(spark):
    rng = np.random.RandomState(14)
    y = np.repeat([0, 1, 2], 15)
    x = y[:, None] + 0.8 * rng.randn(45, 3)
    rows = spark.createDataFrame([(f"s{i}", int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x))], "sample_id string, y int, x array<double>").repartition(3)
    for (model, _), m in ordinal.fit_rows(rows).items():
        want = ordinal.Ordinal(model).fit(x, y)
        assert np.allclose(m.w, want.w, atol=1e-7) and np.allclose(m.theta, want.theta, atol=1e-7)
        got = {r.sample_id: r.predicted for r in ordinal.predict_rows(rows, m).collect()}
        assert [got[f"s{i}"] for i in range(45)] == list(want.predict(x))
    folds = ordinal.cross_validate(rows, ("AT",), cv=3).collect()
    at = {int(r.sample_id[1:]): r for r in folds}
    for k in range(3):
        test = np.array(sorted(i for i, r in at.items() if r.fold == k))
        rest = np.setdiff1d(np.arange(45), test)
        assert [at[i].predicted for i in test] == list(ordinal.Ordinal("AT").fit(x[rest], y[rest]).predict(x[test]))


def test_missing_values(spark):
    o = obs(spark, {"half": [1, None, 3, None], "most": [1, None, None, None], "neg": [-4, None, 2, 3], "none": [None] * 4})
    assert set(values(prep.drop_sparse_features(o))) == {"half", "neg"}  # exactly half of nulls is kept
    filled = values(prep.impute_half_min(o))
    assert filled["half"] == [1, 0.5, 3, 0.5] and filled["neg"][1] == 1.0 and filled["none"] == [1.0] * 4
    by_group = values(prep.impute_group_median(obs(spark, {"x": [2, None, None, None]})))
    assert by_group["x"] == [2, 2, 1, 1]  # the second group has no median


def test_transforms(spark):
    o = obs(spark, {"c": [5, 5, 5, 5], "x": [-1, 0, 1, 2]})
    assert set(values(prep.drop_constant_features(o))) == {"x"}
    x = np.array([-1.0, 0, 1, 2])
    assert np.allclose(values(prep.log_transform(o, "log2"))["x"], np.log2(x + 2 + 1e-10))
    assert np.allclose(values(prep.pareto_scale(o))["x"], (x - x.mean()) / np.sqrt(x.std(ddof=1)))
    assert values(prep.standard_scale(o))["c"] == [0, 0, 0, 0]
    assert values(prep.minmax_scale(o, F.col("s_ord") < 3))["x"] == [0, 0.5, 1, 1.5]


def test_alignment(spark):
    a, b = obs(spark, {"x": [1, 2, 3, 4]}), obs(spark, {"y": [1, 2, 3, 4]}, layer="m").where("sample_id <> 's0'")
    assert prep.align_blocks(a.unionByName(b)).select("sample_id").distinct().count() == 3
    with pytest.raises(ValueError):
        prep.align_blocks(a.unionByName(b.withColumn("sample_id", F.lit("other"))))
    with pytest.raises(ValueError):
        prep.prepare_multiblock(a.unionByName(b.withColumn("grp", F.lit("zz"))))


def test_ordinal_labels(spark):
    df = spark.createDataFrame([("Green",), ("Overripe",)], "grp string")
    assert [r.y for r in prep.encode_ordinal(df).orderBy("grp").collect()] == [0, 2]
    with pytest.raises(Exception, match="unknown label"):
        prep.encode_ordinal(spark.createDataFrame([("Blue",)], "grp string")).collect()


def test_stop_rule_and_p_values():
    assert [next(n for n in range(50, 400, 25) if stats.settled(k, n)) for k in range(4)] == [125, 150, 200, 225]
    assert abs(stats.correlation_p(-0.9486832980505138, 9) - 9.584590571920515e-05) < 1e-12
    assert abs(stats.correlation_p(0.5, 10) - 0.141113) < 1e-6


def nipals(x, y, h, keep):
    """Row-space version of the sparse components, as the statistics' check."""
    classes = sorted(set(y))
    yy = np.array([[float(v == c) for c in classes] for v in y])
    x, yy = x - x.mean(0), yy - yy.mean(0)
    ws, ss = [], []
    for _ in range(h):
        u = yy[:, 0]
        for _ in range(500):
            w = x.T @ u
            w = latent.keep_largest(w / np.linalg.norm(w), keep)
            t = x @ w
            q = yy.T @ t / (t @ t)
            new = yy @ q / (q @ q)
            done, u = np.linalg.norm(new - u) < 1e-6, new
            if done:
                break
        ws.append(w), ss.append((t @ t) * (q @ q))
        x = x - np.outer(t, x.T @ t / (t @ t))
        yy = yy - np.outer(t, yy.T @ t / (t @ t))
    w = np.array(ws).T
    return w, latent.vip(w, np.array(ss))


@pytest.mark.parametrize("keep", [None, 4])
@pytest.mark.parametrize("k", [2, 3])
def test_components_equal_row_space(keep, k):
    rng = np.random.RandomState(1)
    y = np.array([f"c{i % k}" for i in range(30)], object)
    x = rng.randn(30, 8) + np.array([[float(v[1])] for v in y]) * rng.randn(8)
    m = latent.SPLSDA(2, keep).fit(latent.Moments.of(x, y))
    w, v = nipals(x, y, 2, keep)
    assert np.allclose(m.w, w, atol=1e-8) and np.allclose(m.vip, v, atol=1e-8)
    assert (np.array(m.predict(x), object) == y).mean() > 0.6


def test_gathered_moments(spark):
    o = obs(spark, {"x": [1, 2, 3, 5], "z": [0, 1, 0, 7]})
    got = latent.gather_moments(latent.block_rows(o))
    want = latent.Moments.of(np.array([[1, 0], [2, 1], [3, 0], [5, 7.0]]), np.array(list("aabb"), object))
    assert np.allclose(got.xx, want.xx) and np.allclose(got.xy, want.xy) and got.n == 4 and got.classes == ["a", "b"]
    less = want.without(np.array([[5, 7.0]]), np.array([[0, 1.0]]))
    assert np.allclose(less.centred()[0], latent.Moments.of(np.array([[1, 0], [2, 1], [3, 0.0]]), np.array(list("aab"), object)).centred()[0])


def test_diablo_in_row_space():
    rng = np.random.RandomState(2)
    y = np.array([f"c{i % 3}" for i in range(24)], object)
    x = rng.randn(24, 10) + np.array([[float(v[1])] for v in y]) * rng.randn(10) * 2
    m = latent.DIABLO([6, 4], 2, [[3, 3], [2, 2]]).fit(latent.Moments.of(x, y))
    blocks, yy = [x[:, :6] - x[:, :6].mean(0), x[:, 6:] - x[:, 6:].mean(0)], np.array([[float(v == c) for c in m.classes] for v in y])
    yy = yy - yy.mean(0)
    for comp in range(2):
        u, s, _ = np.linalg.svd(np.hstack(blocks), full_matrices=False)
        sup, ts = u[:, 0] * s[0], [None, None]
        for _ in range(500):
            ts, ws = [None, None], []
            for k in range(2):
                other = ts[1 - k] if ts[1 - k] is not None else sup
                target = 0.1 * other + yy @ (yy.T @ sup) / max(sup @ sup, 1e-10)
                w = blocks[k].T @ target
                ws.append(latent.keep_largest(w / np.linalg.norm(w), 3 - k))
                ts[k] = blocks[k] @ ws[k]
            new = (ts[0] + ts[1]) / 2
            done, sup = np.linalg.norm(new - sup) < 1e-6 * np.linalg.norm(sup), new
            if done:
                break
        for k in range(2):
            own = m.w[m.part[k], comp]
            assert np.allclose(np.abs(own), np.abs(ws[k]), atol=1e-5)
            blocks[k] = blocks[k] - np.outer(ts[k], blocks[k].T @ ts[k] / (ts[k] @ ts[k]))
        yy = yy - np.outer(sup, yy.T @ sup / (sup @ sup))
    assert (np.array(m.predict(x), object) == y).mean() > 0.6


def test_network_kernels():
    rng = np.random.RandomState(3)
    base = rng.randn(40, 3)
    x = np.hstack([base[:, [k]] + 0.1 * rng.randn(40, 6) for k in range(3)])
    r = np.corrcoef(x.T)
    modules, merges = network.detect_modules(np.abs(r), 3, 0.4)
    assert [set(modules[6 * k : 6 * k + 6]) for k in range(3)] == [{1}, {2}, {3}] and (np.diff(merges[:, 2]) >= 0).all()
    z = x - x.mean(0)
    assert set(network.merge_modules(z.T @ z, modules, 0.999)) == {1}
    axes = network.eigengene_axes(z.T @ z, modules)
    u, s, _ = np.linalg.svd(z[:, :6], full_matrices=False)
    assert np.allclose(np.abs(z @ axes[1]), np.abs(u[:, 0] * s[0])) and np.corrcoef(z @ axes[1], x[:, :6].mean(1))[0, 1] > 0.99


def test_network_of_a_layer(spark):
    rng = np.random.RandomState(3)
    base = rng.randn(24, 2)
    x = np.hstack([base[:, [k]] + 0.1 * rng.randn(24, 5) for k in range(2)])
    o = obs(spark, {f"f{i}": list(x[:, i]) for i in range(10)}, "ab" * 12)
    y = np.round(base[:, 0])  # ties
    trait = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)], "sample_id string, y double")
    for method in ("pearson", "spearman"):
        found = network.run_network(o, trait, power=4, corr_method=method, cut_height=0.5)
        assert [set(found["labels"][:5]), set(found["labels"][5:])] == [{1}, {2}]
        got = {int(r.sample_id[1:]): r.value for r in found["eigengenes"].where("module = 1").collect()}
        e = np.array([got[i] for i in range(24)])
        rank = (lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])) if method == "spearman" else (lambda v: v)
        r = {m.module: (m.correlation, m.n_features) for m in found["module_trait"].collect()}
        assert abs(r[1][0] - np.corrcoef(rank(e), rank(y))[0, 1]) < 1e-9 and r[1][1] == 5
        small = network.reduce_by_network(o, found)
        assert {"ME_1", "ME_2"} <= {v.feature for v in small.select("feature").distinct().collect()} and small.where("feature = 'ME_1'").count() == 24
    assert network.run_network(o, None, power=4, cut_height=0.5)["module_trait"] is None


def square(pairs, p, diagonal):
    out = np.full((p, p), 0.0)
    for r in pairs.collect():
        out[r.i, r.j] = out[r.j, r.i] = r.w
    np.fill_diagonal(out, diagonal)
    return out


def test_overlap_invariants(spark):
    rng = np.random.RandomState(4)
    o = obs(spark, {f"f{i}": list(rng.randn(8)) for i in range(6)}, "aabbccdd")
    edges = network.adjacency(stats.feature_correlations(o), 2)
    a, t = square(edges, 6, 0.0), square(network.topological_overlap(edges), 6, 1.0)
    assert np.allclose(a, a.T) and a.min() >= 0 and a.max() <= 1 and (np.diag(t) == 1).all() and t.min() >= 0 and t.max() <= 1
    assert np.allclose(network.overlap_matrix(edges, 6), t)
    k = a.sum(0)
    want = (a @ a + a) / (np.minimum.outer(k, k) + 1 - a)
    np.fill_diagonal(want, 1)
    assert np.allclose(t, want)
    with pytest.raises(ValueError):
        network.adjacency(stats.feature_correlations(o), 2, "other")
    with pytest.raises(ValueError):
        stats.feature_correlations(o, "kendall")


def test_ordinal_models():
    rng = np.random.RandomState(5)
    y = np.repeat([0, 1, 2], 12)
    x = y[:, None] + 0.3 * rng.randn(36, 2)
    for model in ordinal.MODELS:
        assert (ordinal.Ordinal(model).fit(x, y).predict(x) == y).mean() > 0.8
    with pytest.raises(ValueError):
        ordinal.Ordinal("XX")


def test_forest():
    rng = np.random.RandomState(6)
    y = np.array(list("ab") * 20, object)
    x = np.column_stack([(y == "b") + 0.2 * rng.randn(40), rng.randn(40, 3)])
    f = Forest(20).fit(x, y)
    assert (f.predict(x) == y).mean() > 0.9 and f.importance.argmax() == 0
    assert f.permutation_importance(x, y, 3)[0].argmax() == 0
    phi, p = f.shapley(x[:5]), f.proba(x[:5])
    mean = np.mean([_mean(t) for t in f.roots], axis=0)
    assert np.allclose(phi.sum(axis=1) + mean, p)


def _mean(node):
    if node[0] < 0:
        return node[4]
    return (node[2][5] * _mean(node[2]) + node[3][5] * _mean(node[3])) / node[5]


def test_rows_are_predicted_where_they_are(spark):
    rng = np.random.RandomState(8)
    y = np.array([f"c{i % 3}" for i in range(60)], object)
    x = rng.randn(60, 6) + 2 * np.eye(3)[np.arange(60) % 3] @ rng.randn(3, 6)
    rows = spark.createDataFrame([(f"s{i}", g, [float(v) for v in a]) for i, (g, a) in enumerate(zip(y, x))], "sample_id string, grp string, x array<double>")
    for model in (latent.SPLSDA(2, 4).fit(latent.Moments.of(x, y)), latent.DIABLO([4, 2], 2).fit(latent.Moments.of(x, y))):
        got = {r.sample_id: r for r in latent.predict_rows(rows, model).collect()}
        assert [got[f"s{i}"].predicted for i in range(60)] == model.predict(x)
        assert np.allclose([got[f"s{i}"].scores for i in range(60)], (x - model.mean) @ model.rotation)
    folds = latent.cross_validate(rows, latent.SPLSDA(2, 4).fit, 4).collect()
    at = {int(r.sample_id[1:]): r for r in folds}
    for k in range(4):
        test = np.array(sorted(i for i, r in at.items() if r.fold == k))
        rest = np.setdiff1d(np.arange(60), test)
        assert [at[i].predicted for i in test] == latent.SPLSDA(2, 4).fit(latent.Moments.of(x[rest], y[rest])).predict(x[test])
    assert len(at) == 60


def test_explanations_in_tasks(spark):
    rng = np.random.RandomState(9)
    y = np.array(list("ab") * 15, object)
    x = np.column_stack([(y == "b") + 0.2 * rng.randn(30), rng.randn(30, 2)])
    f = Forest(5).fit(x, y)
    rows = spark.createDataFrame([([float(v) for v in a],) for a in x], "x array<double>")
    got = {r.f: r.importance for r in forest.shapley_importance(rows, f).collect()}
    assert np.allclose([got[i] for i in range(3)], np.abs(f.shapley(x)).mean(axis=(0, 2)))
    drops = resample.permutation_importance(spark, f, x, y, 4).collect()
    assert max(drops, key=lambda r: r["mean"]).f == 0 and len(drops) == 3


def test_resampling(spark):
    rng = np.random.RandomState(7)
    y = np.repeat(np.array(["a", "b", "c"], object), 4)
    x = rng.randn(12, 5) + 4 * np.repeat(np.eye(3), 4, axis=0) @ rng.randn(3, 5)
    f = resample.splsda_predictor(2)
    r = resample.permutation_test(spark, f, x, y, 60)
    again = resample.permutation_test(spark, f, x, y, 60)
    assert r["null"] == again["null"] and r["n_permutations_run"] == 60 and 0 < r["p_value"] <= 1
    assert resample.permutation_test(spark, f, x, y, 0)["p_value"] == 1
    s = resample.stability_selection(spark, resample.splsda_selector(2, 2), x, y, 10).collect()
    assert len(s) == 5 and all(0 <= v.selection_frequency <= 1 for v in s)
    assert sorted(np.concatenate(resample.folds(y, 3))) == list(range(12))


def test_stream_of_moments(spark, tmp_path):
    from blocklens.streaming import moments

    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "grp string, x array<double>")
    rows.write.parquet(src)
    moments.maintain(spark.readStream.schema(rows.schema).parquet(src), dst, str(tmp_path / "cp")).awaitTermination()
    got = {(r.grp, r.i, r.j): (r.n, r.sx, r.sxy) for r in moments.current(spark, dst).collect()}
    assert got["a", 0, 1] == (2, 4.0, 14.0) and got["b", 1, 1] == (1, 6.0, 36.0)
