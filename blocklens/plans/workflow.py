"""Whole analyses: each layer on its own, all layers together, layers reduced by their networks, and the evidence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, latent, network, ordinal, prep, resample
from ..operators.forest import Forest
from ..operators.resample import by_block
from ..operators.wide import fit_matrix


@dataclass(frozen=True)
class Mode:
    """How much work an analysis does."""

    permutations: int = 200
    bootstraps: int = 100
    keep: int | None = 5
    trees: int = 100
    network_min_features: int = 50
    top_n: int = 15


MODES = {
    "diagnostic": Mode(permutations=0, bootstraps=10, trees=20),
    "standard": Mode(),
    "full": Mode(permutations=1000, network_min_features=0),
}


def matrix_of(obs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """Values (samples in order of s_ord, features of f_ord), labels, sample ids and feature names of prepared layers."""
    if obs.count() > resample.MAX_CELLS:  # counted before anything is fetched
        raise ValueError("too many values for the resampling kernels")
    pdf = obs.select("layer", "sample_id", "s_ord", "grp", "feature", "f_ord", "value").toPandas()
    who = pdf.drop_duplicates("sample_id").sort_values(["s_ord", "sample_id"])
    features = pdf.drop_duplicates(["layer", "f_ord"]).sort_values(["layer", "f_ord"])
    wide = pdf.pivot(index="sample_id", columns=["layer", "f_ord"], values="value")
    wide = wide.loc[list(who.sample_id), list(zip(features["layer"], features.f_ord))]
    return wide.to_numpy(float), who.grp.to_numpy(object), list(who.sample_id), list(features.feature)


def single_layer(obs: DataFrame, mode: Mode, order: list[str] | None = None, **prepare) -> dict:
    """All methods on one layer: accuracies, permutation tests, importances and stability."""
    spark = obs.sparkSession
    x, y, _, names = matrix_of(prep.prepare_block(obs, **prepare))
    levels = order or sorted(set(y))
    rank = np.array([levels.index(v) for v in y])
    keep = None if mode.keep is None else min(mode.keep, x.shape[1])
    methods = {"splsda": (resample.splsda_predictor(2, keep), y), "rf": (resample.forest_predictor(mode.trees), y), "ordinal": (resample.ordinal_predictor(), rank)}
    tests = {m: resample.permutation_test(spark, f, x, label, mode.permutations) for m, (f, label) in methods.items()}
    scores = {
        "splsda": fit_matrix(latent.SPLSDA(2, keep), x, y).vip,
        "rf": Forest(mode.trees).fit(x, y).importance,
        "ordinal": np.abs(ordinal.Ordinal().fit(x, rank).w),
    }
    stable = resample.stability_selection(spark, resample.splsda_selector(2, keep), x, y, mode.bootstraps)
    return {"names": names, "tests": tests, "importance": scores, "stability": stable}


def multi_layer(obs: DataFrame, layers: list[str], mode: Mode, **prepare) -> dict:
    """Joint components of aligned layers, and the fused baselines."""
    spark = obs.sparkSession
    prepared = prep.prepare_multiblock(obs, **prepare).where(F.col("layer").isin(layers))
    sizes = {r["layer"]: r["n"] for r in prepared.groupBy("layer").agg(F.count_distinct("f_ord").alias("n")).collect()}
    own = sorted(sizes)
    x, y, _, names = matrix_of(prepared)
    widths = [sizes[k] for k in own]
    options = {"keep": [[min(mode.keep, w)] * 2 for w in widths]} if mode.keep else {}
    model = fit_matrix(latent.DIABLO(widths, **options), x, y)
    return {
        "layers": own, "sizes": widths, "names": names, "model": model,
        "test": resample.permutation_test(spark, resample.diablo_predictor(widths, **options), x, y, mode.permutations),
        "forest": float((resample.cross_predict(resample.forest_predictor(mode.trees), x, y) == y).mean()),
        "stability": resample.stability_selection(spark, resample.diablo_selector(widths, **options), x, y, mode.bootstraps),
    }


def reduced_layers(obs: DataFrame, mode: Mode, order: list[str], strategy: str = "eigengenes_and_hubs", **prepare) -> DataFrame:
    """Layers with more features than the mode's limit become eigengenes and hubs, joined by sample; others stay."""
    aligned = prep.prepare_multiblock(obs, **prepare)
    out = None
    for row in aligned.groupBy("layer").agg(F.count_distinct("f_ord").alias("n")).orderBy("layer").collect():
        one = aligned.where(F.col("layer") == row["layer"])
        if row["n"] > mode.network_min_features:
            places = one.select("f_ord").distinct().orderBy("f_ord").toPandas().f_ord.tolist()
            dense = F.create_map(*[v for i, f in enumerate(places) for v in (F.lit(f), F.lit(i))])
            one = one.withColumn("f_ord", F.element_at(dense, F.col("f_ord")))
            levels = F.create_map(*[v for i, g in enumerate(order) for v in (F.lit(g), F.lit(float(i)))])
            trait = one.select("sample_id", F.element_at(levels, F.col("grp")).alias("y")).distinct()
            small = network.reduce_by_network(one, network.run_network(one, trait), strategy)
            one = one if small.isEmpty() else small
        out = one if out is None else out.unionByName(one.select(out.columns))
    return out


def consensus_of(results: dict[str, dict], top_n: int, spark) -> DataFrame:
    """Consensus over the methods of all single-layer results (layer -> what ``single_layer`` gave)."""
    rows = []
    for k, (layer, r) in enumerate(results.items()):
        for j, (method, scores) in enumerate(r["importance"].items()):
            rows += [(f"{layer}_{method}", 10 * k + j, layer, n, f, float(v)) for f, (n, v) in enumerate(zip(r["names"], scores))]
    table = spark.createDataFrame(rows, "method string, m_ord int, layer string, feature string, f_ord int, score double")
    return evidence.find_consensus(table, top_n)


def _numbers(test: dict) -> str:
    null = "n/a | n/a" if test["mean_null"] is None else f"{test['mean_null']:.4f} | {test['std_null']:.4f}"
    return f"{test['true_accuracy']:.4f} | {null} | {test['n_permutations_run']} | {test['p_value']:.6f}"


def _stable(table: DataFrame) -> str:
    c = table.agg(F.sum(F.col("stable").cast("int")).alias("s"), F.count("*").alias("n")).first()
    return f"{c.s or 0}/{c.n}"


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """``layer, n_original, n_reduced``: features of each layer before and after ``reduced_layers``."""
    count = lambda obs, name: obs.groupBy("layer").agg(F.count_distinct("feature").alias(name))
    return count(before, "n_original").join(count(after, "n_reduced"), "layer", "left").withColumn("n_reduced", F.coalesce("n_reduced", F.lit(0)))


def report(results: dict[str, dict], joint: dict[str, dict] | None = None, reduced: DataFrame | None = None, mode: Mode | None = None) -> str:
    """Markdown: how much work was done, accuracies with their null distributions, layers that were reduced, and stable
    features of each layer. ``joint``: what ``multi_layer`` gave, by name; ``reduced``: what ``reduction`` gave."""
    lines: list[str] = []
    if mode is not None:
        lines += ["## Setup", "", f"- Permutations: {mode.permutations}", f"- Bootstraps: {mode.bootstraps}", f"- Layers are reduced above {mode.network_min_features} features", ""]
    lines += ["## Methods", "", "| Layer | Method | Accuracy | Null mean | Null deviation | Permutations | p |", "|---|---|---|---|---|---|---|"]
    for layer, r in results.items():
        lines += [f"| {layer} | {m} | {_numbers(t)} |" for m, t in r["tests"].items()]
    for name, r in (joint or {}).items():
        lines.append(f"| {name} | joint components | {_numbers(r['test'])} |")
        lines.append(f"| {name} | fused forest | {r['forest']:.4f} | n/a | n/a | 0 | n/a |")
    if reduced is not None:
        lines += ["", "## Reduction", "", "| Layer | Features | Kept as |", "|---|---|---|"]
        lines += [f"| {r['layer']} | {r.n_original} | {r.n_reduced} |" for r in reduced.orderBy("layer").collect()]
    lines += ["", "## Stable features", "", "| Layer | " + " | ".join(["Alone", *(joint or {})]) + " |", "|---" * (2 + len(joint or {})) + "|"]
    known = list(dict.fromkeys([*results, *(k for r in (joint or {}).values() for k in r["layers"])]))
    for layer in known:
        cells = [_stable(results[layer]["stability"]) if layer in results else "n/a"]
        for r in (joint or {}).values():
            own = by_block(r["stability"], r["sizes"]).where(F.col("block") == r["layers"].index(layer)) if layer in r["layers"] else None
            cells.append("n/a" if own is None else _stable(own))
        lines.append(f"| {layer} | " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"
