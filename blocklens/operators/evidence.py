"""Consensus of methods, network evidence and the tables behind the figures, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import infer_layer


def find_consensus(importance: DataFrame, top_n: int = 15) -> DataFrame:
    """Features that stand in the ``top_n`` of more than one method.

    ``importance``: ``method, m_ord, layer, feature, f_ord, score``. Equal scores keep the features' order. Methods are
    listed in their order.
    """
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "f_ord"))
    top = importance.withColumn("__r", rank).where(F.col("__r") <= top_n)
    named = F.transform(F.array_sort(F.collect_set(F.struct("m_ord", "method"))), lambda m: m["method"])  # as many as methods
    out = top.groupBy("layer", "feature").agg(F.count_distinct("method").alias("n_methods"), F.array_join(named, ", ").alias("methods"))
    return out.where("n_methods > 1")


def ranked(table: DataFrame, score: str, name: str = "feature", by: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``place`` from 1 by falling ``score`` (nulls last), of equal ones by ``name``, within each of ``by``,
    in that order: how importance, stability, hub and coefficient tables of a few features are shown."""
    order = [F.desc_nulls_last(score), F.asc(name)]
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).orderBy(*by, "place")


def merge_importance(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("feature",), suffixes: tuple[str, str] = ("_own", "_other")) -> DataFrame:
    """Features that both tables name, with the columns of either under its suffix: an importance table beside another's."""
    left, right = (t.withColumnsRenamed({c: c + s for c in t.columns if c not in on}) for t, s in zip((a, b), suffixes))
    return left.join(right, list(on), "inner")


def selected_overlap(importance: DataFrame, top_n: int = 15) -> DataFrame:
    """``a, b, n``: features that two methods (``a`` before ``b``) both have in their ``top_n``; pairs without any are
    left out. ``importance`` as in ``find_consensus``."""
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "f_ord"))
    top = importance.withColumn("__r", rank).where(F.col("__r") <= top_n).select("method", "m_ord", "layer", "feature")
    other = top.select(F.col("method").alias("b"), F.col("m_ord").alias("after"), "layer", "feature")
    return top.join(other, ["layer", "feature"]).where("m_ord < after").groupBy(F.col("method").alias("a"), "b").agg(F.count("*").alias("n"))


def integrate_evidence(consensus: DataFrame, modules: DataFrame, traits: DataFrame, hubs: DataFrame) -> DataFrame:
    """Network support of each consensus feature.

    ``modules``: ``layer, feature, module``; ``traits``: ``layer, module, correlation, p_value``; ``hubs``: ``layer,
    feature, is_hub, hub_score``. Module 0 gives its number but no support. Best evidence has rank 1.
    """
    sizes = modules.groupBy("layer", "module").agg(F.count("*").alias("module_size"))
    base = consensus if "layer" in consensus.columns else consensus.withColumn("layer", infer_layer(F.col("methods")))
    out = base.join(modules, ["layer", "feature"], "left").withColumn("supported", F.coalesce(F.col("module") != 0, F.lit(False)))
    # evidence of modules only counts for supported features
    out = out.join(sizes, ["layer", "module"], "left").join(traits, ["layer", "module"], "left").join(hubs, ["layer", "feature"], "left")
    only = lambda c: F.when(F.col("supported"), F.col(c))
    out = out.select(
        "layer", "feature", "n_methods", "methods", "supported", "module", only("module_size").alias("module_size"), only("correlation").alias("trait_correlation"),
        only("p_value").alias("trait_p_value"), F.coalesce(only("is_hub"), F.lit(False)).alias("is_hub"), only("hub_score").alias("hub_score"),
    )
    out = out.withColumn("support_score", F.col("supported").cast("int") + F.col("is_hub").cast("int")).withColumn("evidence_score", (F.col("n_methods") + F.col("support_score")).cast("long"))
    best = [F.desc("evidence_score"), F.desc("n_methods"), F.desc("is_hub"), F.desc_nulls_last("hub_score"), F.asc("layer"), F.asc("feature")]
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # consensus features: top_n for each method at most


def candidate_table(evidence: DataFrame) -> DataFrame:
    return evidence.select("feature", "layer", "n_methods", "supported", "is_hub", "module", "trait_correlation", "trait_p_value", "hub_score", "evidence_score", "methods")


def convergence_grid(consensus: DataFrame, stability: DataFrame, least: int = 3, kinds: tuple = ("splsda", "rf", "ordinal", "diablo")) -> DataFrame:
    """Which kinds of methods name a feature (of those named by ``least`` at least), with its stability."""
    names = F.split("methods", ", ")

    def named(kind: str):
        return F.exists(names, lambda m: m.endswith(f"_{kind}") | m.startswith(f"{kind}_")).alias(kind)

    has = [named(k) for k in kinds]
    return consensus.where(F.col("n_methods") >= least).select("layer", "feature", "n_methods", *has).join(stability, ["layer", "feature"], "left")


def fused_summary(*tables: DataFrame) -> DataFrame:
    """Summaries with different columns under each other; what one lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n`` of equal-width bins; the last one is closed; empty ones are left out."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, hi = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
    at = F.least(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    width = (hi - lo) / bins
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")
