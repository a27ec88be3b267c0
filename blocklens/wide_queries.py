"""Queries of components and networks with more features than samples, and of resampling where the rows are."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import stats
from .functions.arrays import checkpointed
from .operators import evidence, explain, forest, latent, network, ordinal, rowwise, wide
from .queries import EMB, FIRST, QUERIES, SQL, query, r6
from .sources.layers import embedding_layer, word_profiles

WIDE = 5319

PROFILES = f"""w as (select coalesce(source, '') source, lang, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) word from documents where lang is not null),
 c as (select source, lang, cast(('0x' || substr(md5(word), 1, 8)) as bigint) % {WIDE} b, count(*) n from w group by all),
 t as (select source, lang, cast(sum(n) as double) total from c group by all),
 x as (select source, lang, b, n * 1000.0 / total v from c join t using (source, lang)),
 y as (select source, lang, case when lang = (select min(lang) from t) then 1.0 else 0.0 end - (select avg(case when lang = (select min(lang) from t) then 1.0 else 0.0 end) from t) u from t),
 s as (select b, sum(v * u) s from x join y using (source, lang) group by b)"""


@query("q_wide_first_vip", f"with {PROFILES} select cast(f as integer) f, round(sqrt({WIDE}) * abs(coalesce(s, 0)) / (select sqrt(sum(s * s)) from s), 6) + 0.0 vip from (select unnest(range({WIDE})) f) left join s on f = b")
def wide_first_vip(spark, d):
    m = wide.fit(word_profiles(spark, d, WIDE), latent.SPLSDA(1, None, max_iter=1))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.vip)], "f int, vip double").select("f", r6("vip").alias("vip"))


@query("q_wide_components")
def wide_components(spark, d):
    m = wide.fit(word_profiles(spark, d, WIDE), latent.SPLSDA(2, 10))
    return spark.createDataFrame([(int(i), h + 1, float(m.w[i, h]), float(m.p[i, h]), float(m.vip[i])) for i in range(WIDE) for h in range(2)], "f int, component int, weight double, loading double, vip double")


@query("q_wide_diablo")
def wide_diablo(spark, d):
    """Two blocks of the same samples: their words and the words' first two letters."""
    letters = word_profiles(spark, d, 600, 2).select("sample_id", F.col("x").alias("z"))
    rows = word_profiles(spark, d, WIDE).join(letters, "sample_id").select("sample_id", "grp", F.concat("x", "z").alias("x"))
    m = wide.fit(rows, latent.DIABLO([WIDE, 600], 2, [[10, 10], [10, 10]]))
    found = [(b, c + 1, f, w, float(m.vips()[b][f]), float(m.block_corr[0, 1])) for b in range(2) for c in range(2) for f, w in m.selected(b, c)]
    return spark.createDataFrame(found, "block int, component int, f int, loading double, vip double, block_correlation double")


def _rows(spark, d):
    return latent.block_rows(embedding_layer(spark, d))


def _null(spark, r):
    return spark.createDataFrame([(i, v, r["true_accuracy"], r["p_value"]) for i, v in enumerate(r["null"])], "perm long, accuracy double, true_accuracy double, p_value double")


TWO = ([32, 32], 2, [[5, 5], [5, 5]])


@query("q_splsda_cv")
def splsda_cv(spark, d):
    return rowwise.cross_validate(_rows(spark, d), latent.SPLSDA(2, 10).fit)


@query("q_diablo_cv")
def diablo_cv(spark, d):
    return rowwise.cross_validate(_rows(spark, d), latent.DIABLO(*TWO).fit)


@query("q_splsda_folds")
def splsda_folds(spark, d):
    return rowwise.cross_validate(_rows(spark, d), latent.SPLSDA(2, 10).fit, 5)


@query("q_splsda_permutation")
def splsda_permutation(spark, d):
    return _null(spark, rowwise.permutation_test(_rows(spark, d), latent.SPLSDA(2, 10).fit))


@query("q_diablo_permutation")
def diablo_permutation(spark, d):
    return _null(spark, rowwise.permutation_test(_rows(spark, d), latent.DIABLO(*TWO).fit))


@query("q_stability")
def stability(spark, d):
    return evidence.ranked(rowwise.stability_selection(_rows(spark, d), latent.SPLSDA(2, 10).fit), "selection_frequency", "f")


@query("q_diablo_stability")
def diablo_stability(spark, d):
    from .operators.resample import by_block

    return by_block(rowwise.stability_selection(_rows(spark, d), latent.DIABLO(*TWO).fit), [32, 32])


def _score(spark, d, model):
    rows = _rows(spark, d)
    return latent.score_rows(rows, wide.fit(rows, model))


@query("q_splsda_score")
def splsda_score(spark, d):
    return _score(spark, d, latent.SPLSDA(2, 10))


@query("q_diablo_score")
def diablo_score(spark, d):
    return _score(spark, d, latent.DIABLO(*TWO))


@query("q_vip_merge", f"with {FIRST}, d as (select f_ord f, stddev_samp(\"value\") sd from emb group by 1) select wt.f, round(sqrt(64) * abs(w), 6) + 0.0 vip_own, round(sd, 6) + 0.0 sd_other from wt join d on d.f = wt.f where w <> 0")
def vip_merge(spark, d):
    obs = embedding_layer(spark, d)
    m = latent.SPLSDA(1, 5, max_iter=1).fit(latent.gather_moments(latent.block_rows(obs)))
    own = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.vip) if v > 0], "f int, vip double")
    spread = obs.groupBy(F.col("f_ord").alias("f")).agg(F.stddev_samp("value").alias("sd"))
    return evidence.merge_importance(own, spread, ("f",)).select("f", r6("vip_own").alias("vip_own"), r6("sd_other").alias("sd_other"))


@query("q_module_sizes", f"with {EMB}, c as (select f_ord, abs(corr(\"value\", cast(grp as integer))) r from emb group by 1), m as (select f_ord f, cast(floor(20 * r) as integer) \"module\" from c) select 'emb' layer, \"module\", count(*) n from m group by 2")
def module_sizes(spark, d):
    """Features in bands of their correlation with the label as modules."""
    r = embedding_layer(spark, d).groupBy("layer", F.col("f_ord").alias("f")).agg(F.abs(stats.safe_corr(F.col("value"), F.col("grp").cast("int").cast("double"))).alias("r"))
    return network.module_sizes(r.select("layer", "f", F.floor(20 * F.col("r")).cast("int").alias("module")))


FAR = """l as (select f_ord, avg("value") + 1.5 * stddev_pop("value") far from emb group by 1),
 kk as (select grp, e.f_ord f, count(*) n, count(*) filter ("value" >= far) k from emb e join l on e.f_ord = l.f_ord group by 1, 2)"""


@query("q_stop_rule", f"""with {EMB}, {FAR}, c as (select grp, f, n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)) p from kk, unnest(range(0, 1000)) c(i) where i <= k)
 select grp, f, n, k, sum(p) < 0.005 or 1 - coalesce(sum(p) filter (i < k), 0) < 0.005 settled from c group by all""")
def stop_rule(spark, d):
    """For each class and dimension: would the values far above the mean, as hits among the class's values, end a test?"""
    obs = embedding_layer(spark, d)
    far = obs.groupBy("f_ord").agg((F.avg("value") + 1.5 * F.stddev_pop("value")).alias("far"))
    hits = obs.join(F.broadcast(far), "f_ord").groupBy("grp", F.col("f_ord").alias("f")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") >= F.col("far"), 1)).alias("k"))
    kinds = [(r.n, r.k, stats.settled(r.k, r.n)) for r in hits.select("n", "k").distinct().collect()]  # pairs of small numbers
    return hits.join(F.broadcast(spark.createDataFrame(kinds, "n long, k long, settled boolean")), ["n", "k"]).select("grp", "f", "n", "k", "settled")


@query("q_vip_ranked", f"with {FIRST} select f, round(sqrt(64) * abs(w), 6) + 0.0 vip, cast(row_number() over (order by round(abs(w), 9) desc, f) as integer) place from wt")
def vip_ranked(spark, d):
    rows = _rows(spark, d)
    m = latent.SPLSDA(1, 5, max_iter=1).fit(latent.gather_moments(rows))
    return evidence.ranked(spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(m.vip)], "f int, vip double"), "vip", "f").select("f", (F.col("vip") + F.lit(0.0)).alias("vip"), "place")


def _ordinal(spark, d):
    return _rows(spark, d).withColumn("y", F.col("grp").cast("int"))


@query("q_ordinal_permutation")
def ordinal_permutation(spark, d):
    return _null(spark, ordinal.permutation_test(_ordinal(spark, d)))


@query("q_ordinal_confusion")
def ordinal_confusion(spark, d):
    predicted = ordinal.cross_validate(_ordinal(spark, d), ("AT",))
    return stats.confusion(checkpointed(predicted), "y", "predicted")


@query("q_ordinal_fold_coefficients")
def ordinal_fold_coefficients(spark, d):
    fits = ordinal.fit_rows(ordinal.with_folds(_ordinal(spark, d)), ("AT",), cv=5)
    return spark.createDataFrame(ordinal.mean_coefficients(fits), "model string, f int, coefficient double").orderBy(F.desc(F.abs("coefficient")), "f")


@query("q_forest_importance")
def forest_importance(spark, d):
    model, _ = forest.train_forest(_rows(spark, d))
    return evidence.ranked(spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())], "f int, importance double"), "importance", "f")


@query("q_forest_cv")
def forest_cv(spark, d):
    predicted = checkpointed(explain.cross_validate(_rows(spark, d)))
    whole = predicted.agg(stats.accuracy("grp", "predicted")).first()[0]
    return stats.class_report(predicted, "grp", "predicted").withColumn("accuracy", F.lit(whole))


@query("q_forest_permutation_importance")
def forest_permutation_importance(spark, d):
    rows = _rows(spark, d)
    model, classes = forest.train_forest(rows)
    return evidence.ranked(explain.permutation_importance(rows, explain.boxes_of(model, rows), classes), "mean", "f")


@query("q_forest_shapley")
def forest_shapley(spark, d):
    rows = _rows(spark, d)
    model, _ = forest.train_forest(rows)
    return evidence.ranked(explain.shapley_importance(rows, explain.boxes_of(model, rows)), "importance", "f")


__all__ = ["QUERIES", "SQL"]
