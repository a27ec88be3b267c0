"""Queries of the operators over the driver's tables, and the same in SQL. Computed doubles are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .operators import evidence, forest_rows, latent, network, ordinal, prep
from .sources.layers import embedding_layer, event_layer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EMB = """emb as (select 'emb' layer, cast(vec_id as varchar) sample_id, cast(label as varchar) grp, printf('d%02d', f) feature, cast(f as integer) f_ord, cast(v as double) "value"
 from (select vec_id, label, unnest(range(64)) f, unnest(embedding) v from embeddings))"""
EVENTS = """ec as (select user_id, cast(ts as date) d, event_type, avg(value) v from events group by all),
 ek as (select event_type, cast(row_number() over (order by event_type) - 1 as integer) f_ord from (select distinct event_type from events)),
 ev as (select 'events' layer, cast(s.user_id as varchar) || '|' || cast(s.d as varchar) sample_id, 'g' || cast(s.user_id % 3 as varchar) grp, k.event_type feature, k.f_ord, c.v "value"
 from (select distinct user_id, d from ec) s cross join ek k left join ec c on c.user_id = s.user_id and c.d = s.d and c.event_type = k.event_type)"""
CELL = "layer, sample_id, grp, feature, f_ord"
W = "over (partition by layer, feature)"


def r6(c, places: int = 6):
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def cells(df: DataFrame) -> DataFrame:
    return df.select("layer", "sample_id", "grp", "feature", "f_ord", r6("value").alias("value"))


def pair_query(name: str, sql: str):
    """Registers f(obs, spark, d) on all dimensions of the embeddings."""
    return lambda f: query(name, sql)(lambda spark, d: f(embedding_layer(spark, d), spark, d))


def _steps(name: str, source: str, f, value: str, where: str = "") -> None:
    base, table, load = (EMB, "emb", embedding_layer) if source == "emb" else (EVENTS, "ev", event_layer)
    query(name, f'with {base}, s as (select *, {value} nv from {table} {where}) select {CELL}, round(nv, 6) + 0.0 "value" from s')(lambda spark, d: cells(f(load(spark, d))))


HALF = f'coalesce("value", case when min("value") {W} / 2 > 0 then min("value") {W} / 2 else 1.0 end)'
_steps("q_half_min", "ev", prep.impute_half_min, HALF)
_steps("q_drop_sparse", "ev", lambda o: prep.drop_sparse_features(o, 0.7), '"value"', f'qualify avg(case when "value" is null then 1 else 0 end) {W} <= 0.7')
_steps("q_zero_variance", "emb", prep.drop_constant_features, '"value"', f'qualify max("value") {W} > min("value") {W}')
MOVED = f'"value" + case when min("value") {W} <= 0 then abs(min("value") {W}) + 1 else 0 end + 1e-10'
for _b, _f in (("log", "ln"), ("log2", "log2"), ("log10", "log10")):
    _steps(f"q_{_b}_transform", "emb", lambda o, b=_b: prep.log_transform(o, b), f"{_f}({MOVED})")
SCALED = '("value" - avg("value") {w}) / case when stddev_samp("value") {w} > 0 then {s} else 1 end'
_steps("q_pareto", "emb", prep.pareto_scale, SCALED.format(w=W, s=f'sqrt(stddev_samp("value") {W})'))
_steps("q_standard", "emb", prep.standard_scale, SCALED.format(w=W, s=f'stddev_samp("value") {W}'))
_steps("q_minmax", "emb", prep.minmax_scale, f'("value" - min("value") {W}) / case when max("value") {W} > min("value") {W} then max("value") {W} - min("value") {W} else 1 end')
_steps("q_average_rank", "emb", stats.average_rank, 'rank() over (partition by layer, feature order by "value") + (count(*) over (partition by layer, feature, "value") - 1) / 2.0')


@query("q_null_fraction", f'with {EVENTS} select layer, feature, round(avg(case when "value" is null then 1.0 else 0 end), 6) + 0.0 nulls from ev group by all')
def _null_fraction(spark, d):
    return stats.null_fraction(event_layer(spark, d)).select("layer", "feature", r6("nulls").alias("nulls"))


@query("q_group_median", f'with {EVENTS}, m as (select * replace (coalesce("value", median("value") over (partition by layer, feature, grp)) as "value") from ev), h as (select *, {HALF} nv from m) select {CELL}, round(nv, 6) + 0.0 "value" from h')
def _group_median(spark, d):
    return cells(prep.impute_group_median(event_layer(spark, d)))


_PREPARED = """{base}, a as (select * from {t} qualify avg(case when "value" is null then 1 else 0 end) {w} <= 0.7), b as (select * replace ({half} as "value") from a),
 c as (select * from b qualify max("value") {w} > min("value") {w}), l as (select * replace (ln({moved}) as "value") from c), p as (select * replace ({pareto} as "value") from l)"""
PREP_EV = _PREPARED.format(base=EVENTS, t="ev", w=W, half=HALF, moved=MOVED, pareto=SCALED.format(w=W, s=f'sqrt(stddev_samp("value") {W})'))


@query("q_prepare_block", f'with {PREP_EV} select {CELL}, round("value", 6) + 0.0 "value" from p')
def _prepare_block(spark, d):
    return cells(prep.prepare_block(event_layer(spark, d), threshold=0.7))


@query("q_ordinal_encode", "select o_orderkey, cast(cast(left(o_orderpriority, 1) as integer) - 1 as integer) y from orders")
def _ordinal(spark, d):
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return prep.encode_ordinal(spark.read.parquet(f"{d}/orders.parquet"), levels, "o_orderpriority").select("o_orderkey", "y")


def two_layers(spark, d):
    """Customers by what they ordered, and suppliers of the same numbers by their balance; most are in one layer alone."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("orders"))
    c = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.col("s_acctbal").alias("balance"))
    row = lambda df, layer, key, names: df.select(F.lit(layer).alias("layer"), F.col(key).cast("string").alias("sample_id"), F.col(key).alias("s_ord"), F.concat(F.lit("g"), (F.col(key) % 3).cast("string")).alias("grp"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("f_ord"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names)])))
    return row(o, "sales", "o_custkey", ["price", "orders"]).unionByName(row(c, "account", "s_suppkey", ["balance"]))


TWO = """ls as (select o_custkey k, avg(o_totalprice) q, count(*) dc from orders group by 1), sp as (select s_suppkey k, s_acctbal b from supplier),
 tw as (select 'sales' layer, k, 'price' feature, 0 f_ord, q "value" from ls union all select 'sales', k, 'orders', 1, dc from ls union all select 'account', k, 'balance', 0, b from sp),
 cm as (select cast(k as varchar) sample_id, row_number() over (order by cast(k as varchar)) - 1 s_ord from (select k from ls intersect select k from sp)),
 al as (select layer, cm.sample_id, cm.s_ord, 'g' || cast(k % 3 as varchar) grp, feature, cast(f_ord as integer) f_ord, cast("value" as double) "value" from tw join cm on cm.sample_id = cast(k as varchar))"""


@query("q_align", f'with {TWO} select {CELL}, s_ord, round("value", 6) + 0.0 "value" from al')
def _align(spark, d):
    return prep.align_blocks(two_layers(spark, d)).select("layer", "sample_id", "grp", "feature", "f_ord", "s_ord", r6("value").alias("value"))


@query("q_prepare_multiblock", f'with {TWO}, l as (select * replace (ln({MOVED}) as "value") from al), p as (select * replace ({SCALED.format(w=W, s=f"sqrt(stddev_samp({chr(34)}value{chr(34)}) {W})")} as "value") from l) select {CELL}, round("value", 6) + 0.0 "value" from p')
def _multiblock(spark, d):
    return cells(prep.prepare_multiblock(two_layers(spark, d)))


@query("q_early_fusion", f"with {TWO} select 'fused' layer, sample_id, grp, layer || ':' || feature feature, cast(f_ord + case layer when 'account' then 2 else 0 end as integer) f_ord, round(\"value\", 6) + 0.0 \"value\" from al")
def _fusion(spark, d):
    return cells(prep.early_fusion(prep.align_blocks(two_layers(spark, d)), ["sales", "account"]))


SMALL = EMB + ', x as (select * from emb), pr as (select a.f_ord i, b.f_ord j, corr(a."value", b."value") r from x a join x b on a.sample_id = b.sample_id and a.f_ord < b.f_ord group by 1, 2)'
ADJ = SMALL + ", ad as (select i, j, abs(r) ^ 2 w from pr), bw as (select i, j, w from ad union all select j, i, w from ad), kk as (select i, sum(w) k from bw group by 1)"


@pair_query("q_pearson", f"with {SMALL} select 'emb' layer, i, j, round(r, 6) + 0.0 r from pr")
def _pearson(obs, spark, d):
    return stats.feature_correlations(obs).select("layer", "i", "j", r6("r").alias("r"))


@pair_query("q_spearman", f'with {EMB}, x as (select sample_id, f_ord, rank() over (partition by f_ord order by "value") + (count(*) over (partition by f_ord, "value") - 1) / 2.0 v from emb) select \'emb\' layer, a.f_ord i, b.f_ord j, round(corr(a.v, b.v), 6) + 0.0 r from x a join x b on a.sample_id = b.sample_id and a.f_ord < b.f_ord group by a.f_ord, b.f_ord')
def _spearman(obs, spark, d):
    return stats.feature_correlations(obs, "spearman").select("layer", "i", "j", r6("r").alias("r"))


for _kind, _e in (("unsigned", "abs(r) ^ 2"), ("signed", "((1 + r) / 2) ^ 2"), ("signed_hybrid", "greatest(r, 0) ^ 2")):
    pair_query(f"q_adjacency_{_kind}", f"with {SMALL} select 'emb' layer, i, j, round({_e}, 9) + 0.0 w from pr")(
        lambda obs, spark, d, k=_kind: network.adjacency(stats.feature_correlations(obs), 2, k).select("layer", "i", "j", r6("w", 9).alias("w"))
    )


@pair_query("q_connectivity", f"with {ADJ} select 'emb' layer, i, round(k, 9) + 0.0 k from kk")
def _connectivity(obs, spark, d):
    return network.connectivity(network.adjacency(stats.feature_correlations(obs), 2)).select("layer", "i", r6("k", 9).alias("k"))


@pair_query("q_tom", f"with {ADJ}, l as (select a.i, b.j, sum(a.w * b.w) l from bw a join bw b on a.j = b.i where a.i < b.j group by 1, 2) select 'emb' layer, ad.i, ad.j, round((coalesce(l, 0) + w) / (least(x.k, y.k) + 1 - w), 9) + 0.0 w from ad left join l on l.i = ad.i and l.j = ad.j join kk x on x.i = ad.i join kk y on y.i = ad.j")
def _tom(obs, spark, d):
    return network.topological_overlap(network.adjacency(stats.feature_correlations(obs), 2)).select("layer", "i", "j", r6("w", 9).alias("w"))


SCAN = EMB + """, x as (select * from emb), pr as (select a.f_ord i, b.f_ord j, abs(corr(a."value", b."value")) r from x a join x b on a.sample_id = b.sample_id and a.f_ord < b.f_ord group by 1, 2),
 ew as (select unnest(range(2, 6)) p, i, j, r from pr), bw as (select p, i f, r ^ p w from ew union all select p, j, r ^ p from ew), kk as (select p, f, sum(w) k from bw group by 1, 2),
 st as (select *, count(*) over (partition by p) n, min(k) over (partition by p) lo, max(k) over (partition by p) hi from kk where k > 0), nb as (select *, greatest(5, least(20, n // 3)) nb from st),
 bn as (select p, n, lo, hi, nb, least(cast(floor((k - lo) / (hi - lo) * nb) as bigint), nb - 1) b, count(*) c from nb group by all),
 ft as (select p, count(*) bins, regr_slope(log10(c), log10(lo + (b + .5) * (hi - lo) / nb)) s, regr_r2(log10(c), log10(lo + (b + .5) * (hi - lo) / nb)) r2 from bn group by 1),
 sf as (select ft.p, case when bins >= 3 then -sign(s) * r2 else 0 end r2, m from ft join (select p, avg(k) m from kk group by 1) q on q.p = ft.p)"""


@query("q_scale_free", f"with {SCAN} select 'emb' layer, cast(p as integer) power, round(r2, 6) + 0.0 r_squared, round(m, 6) + 0.0 mean_connectivity from sf")
def _scale_free(spark, d):
    out = network.scale_free_scan(stats.feature_correlations(embedding_layer(spark, d)), range(2, 6))
    return out.select("layer", "power", r6("r_squared").alias("r_squared"), r6("mean_connectivity").alias("mean_connectivity"))


@query("q_pick_power", f"with {SCAN} select 'emb' layer, cast(coalesce(min(p) filter (r2 > 0.8), arg_min(p, {{'a': -r2, 'b': p}})) as integer) power, count(*) filter (r2 > 0.8) > 0 threshold_met from sf")
def _pick_power(spark, d):
    return network.pick_power(network.scale_free_scan(stats.feature_correlations(embedding_layer(spark, d)), range(2, 6)))


def _trait(spark, d):
    return embedding_layer(spark, d).select("sample_id", F.col("grp").cast("int").alias("y")).distinct()


@query("q_trait_correlation", f'with {EMB} select f_ord f, round(corr("value", cast(grp as integer)), 6) + 0.0 r, round(abs(corr("value", cast(grp as integer))), 6) + 0.0 abs_r, count(*) n from emb group by 1')
def _trait_corr(spark, d):
    out = network.trait_correlation(embedding_layer(spark, d).select("sample_id", F.col("f_ord").alias("f"), "value"), _trait(spark, d), ["f"])
    return out.select("f", r6("r").alias("r"), r6("abs_r").alias("abs_r"), "n")


@pair_query("q_hubs", f"""with {ADJ}, ki as (select i f, i % 3 + 1 module, sum(case when i % 3 = j % 3 then w else 0 end) k from bw group by 1), g as (select f_ord f, abs(corr("value", cast(grp as integer))) gs from x group by 1),
 h as (select f, module, k, k / max(k) over (partition by module) kn, k / max(k) over (partition by module) * gs hs from ki join g using (f)) select 'emb' layer, f, cast(module as integer) module, round(k, 9) + 0.0 k_in, round(kn, 6) + 0.0 k_norm, round(hs, 6) + 0.0 hub_score, row_number() over (partition by module order by hs desc, f) <= 2 is_hub from h""")
def _hubs(obs, spark, d):
    edges = network.adjacency(stats.feature_correlations(obs), 2)
    modules = obs.select("layer", F.col("f_ord").alias("f"), (F.col("f_ord") % 3 + 1).alias("module")).distinct()
    gs = network.trait_correlation(obs.select("layer", "sample_id", F.col("f_ord").alias("f"), "value"), _trait(spark, d), ["layer", "f"])
    return network.hub_features(edges, modules, gs, 2).select("layer", "f", "module", r6("k_in", 9).alias("k_in"), r6("k_norm").alias("k_norm"), r6("hub_score").alias("hub_score"), "is_hub")


GRAM = EMB + ', x as (select sample_id, grp, f_ord, "value" - avg("value") over (partition by f_ord) v from emb)'


@pair_query("q_gram", f"with {GRAM} select a.f_ord i, b.f_ord j, round(sum(a.v * b.v), 6) + 0.0 c from x a join x b on a.sample_id = b.sample_id group by 1, 2")
def _gram(obs, spark, d):
    c = latent.gather_moments(latent.block_rows(obs)).centred()[0]
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(c)], "i int, j int, c double").select("i", "j", r6("c").alias("c"))


@pair_query("q_pls_first_weights", f"with {GRAM}, s as (select f_ord f, sum(v) filter (grp = (select min(grp) from x)) s from x group by 1), k as (select * from s order by abs(s) desc, f limit 5) select s.f, round(case when k.f is null then 0 else s.s / sqrt((select sum(s * s) from k)) end, 6) + 0.0 w from s left join k on k.f = s.f")
def _first(obs, spark, d):
    m = latent.SPLSDA(1, 5, max_iter=1).fit(latent.gather_moments(latent.block_rows(obs)))
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(m.w[:, 0])], "f int, w double").select("f", r6("w").alias("w"))


PRED = "pr as (select vec_id, label y, cast(floor(abs(embedding[1]) * 1000) as bigint) % 10 p from embeddings)"


def predicted(spark, d):
    """Labels beside a made-up prediction, to measure the metrics on."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").alias("y"), (F.floor(F.abs(F.col("embedding")[0].cast("double")) * 1000) % 10).alias("p"))


PRED = PRED.replace("abs(embedding[1])", "abs(cast(embedding[1] as double))")


@query("q_accuracy", f"with {PRED} select round(avg(case when y = p then 1.0 else 0 end), 6) + 0.0 accuracy, round(avg(abs(y - p)), 6) + 0.0 mae from pr")
def _accuracy(spark, d):
    return predicted(spark, d).agg(r6(stats.accuracy("y", "p")).alias("accuracy"), r6(stats.mean_absolute_error("y", "p")).alias("mae"))


@query("q_confusion", f"with {PRED}, l as (select y l from pr union select p from pr) select a.l y_true, b.l y_pred, count(pr.y) n from l a cross join l b left join pr on pr.y = a.l and pr.p = b.l group by 1, 2")
def _confusion(spark, d):
    return stats.confusion(predicted(spark, d).withColumn("y", F.col("y").cast("long")), "y", "p")


@query("q_class_report", f"with {PRED}, l as (select y l from pr union select p from pr), c as (select l, count(*) filter (y = l) s, count(*) filter (p = l) g, count(*) filter (y = l and p = l) t from l cross join pr group by 1), m as (select l, case when g > 0 then t / g else 0 end pc, case when s > 0 then t / s else 0 end rc, s from c) select l \"label\", round(pc, 6) + 0.0 \"precision\", round(rc, 6) + 0.0 recall, round(case when pc + rc > 0 then 2 * pc * rc / (pc + rc) else 0 end, 6) + 0.0 f1, s support from m")
def _report(spark, d):
    out = stats.class_report(predicted(spark, d).withColumn("y", F.col("y").cast("long")), "y", "p")
    return out.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


IMP = """im as (select 'emb_splsda' method, 0 m_ord, f_ord, abs(avg("value")) score from emb group by f_ord union all select 'emb_rf', 1, f_ord, stddev_samp("value") from emb group by f_ord
 union all select 'emb_ordinal', 2, f_ord, max("value") from emb group by f_ord), tp as (select * from im qualify row_number() over (partition by method order by score desc, f_ord) <= 30),
 cs as (select f_ord, count(*) n_methods, string_agg(method, ', ' order by m_ord) methods from tp group by 1 having count(*) > 1)"""


def importance(spark, d):
    by = embedding_layer(spark, d).groupBy("layer", "feature", "f_ord").agg(F.abs(F.avg("value")).alias("emb_splsda"), F.stddev_samp("value").alias("emb_rf"), F.max("value").alias("emb_ordinal"))
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("m_ord"), F.col(m).alias("score")) for i, m in enumerate(("emb_splsda", "emb_rf", "emb_ordinal"))])
    return by.select("layer", "feature", "f_ord", F.inline(kinds))


@query("q_consensus", f"with {EMB}, {IMP} select 'emb' layer, printf('d%02d', f_ord) feature, n_methods, methods from cs")
def _consensus(spark, d):
    return evidence.find_consensus(importance(spark, d), 30)


def _evidence(spark, d):
    names = embedding_layer(spark, d).select("layer", "feature", "f_ord").distinct()
    modules = names.where("f_ord % 7 <> 6").select("layer", "feature", (F.col("f_ord") % 4).alias("module"))
    traits = spark.createDataFrame([("emb", m, m / 10, m / 100) for m in (1, 2)], "layer string, module int, correlation double, p_value double")
    hubs = names.where("f_ord % 3 = 0").select("layer", "feature", (F.col("f_ord") % 2 == 0).alias("is_hub"), (F.col("f_ord") / 64.0).alias("hub_score"))
    return evidence.integrate_evidence(evidence.find_consensus(importance(spark, d), 30), modules, traits, hubs)


EVID = f"""with {EMB}, {IMP}, mo as (select range f, range % 4 m from range(64) where range % 7 <> 6), ms as (select m, count(*) c from mo group by 1),
 e as (select f_ord f, n_methods, methods, mo.m, coalesce(mo.m <> 0, false) s, c from cs left join mo on mo.f = f_ord left join ms on ms.m = mo.m),
 o as (select printf('d%02d', f) feature, 'emb' layer, n_methods, s supported, s and f % 3 = 0 and f % 2 = 0 is_hub, cast(m as integer) module, case when s then c end module_size, case when s and m in (1, 2) then m / 10.0 end trait_correlation,
 case when s and m in (1, 2) then m / 100.0 end trait_p_value, case when s and f % 3 = 0 then f / 64.0 end hub_score, methods from e),
 q as (select *, n_methods + supported::int + is_hub::int evidence_score from o)"""


@query("q_evidence", EVID + " select layer, feature, n_methods, methods, supported, module, module_size, round(trait_correlation, 6) trait_correlation, round(trait_p_value, 6) trait_p_value, is_hub, round(hub_score, 6) hub_score, cast(supported::int + is_hub::int as integer) support_score, cast(evidence_score as bigint) evidence_score, cast(row_number() over (order by evidence_score desc, n_methods desc, is_hub desc, hub_score desc nulls last, layer, feature) as integer) \"rank\" from q")
def _q_evidence(spark, d):
    return _evidence(spark, d).withColumns({c: F.round(c, 6) for c in ("trait_correlation", "trait_p_value", "hub_score")})


@query("q_candidates", EVID + " select feature, layer, n_methods, supported, is_hub, module, round(trait_correlation, 6) trait_correlation, round(trait_p_value, 6) trait_p_value, round(hub_score, 6) hub_score, cast(evidence_score as bigint) evidence_score, methods from q")
def _candidates(spark, d):
    return evidence.candidate_table(_evidence(spark, d)).withColumns({c: F.round(c, 6) for c in ("trait_correlation", "trait_p_value", "hub_score")})


@query("q_convergence_grid", f"with {EMB}, {IMP} select 'emb' layer, printf('d%02d', f_ord) feature, n_methods, contains(methods, '_splsda') splsda, contains(methods, '_rf') rf, contains(methods, '_ordinal') ordinal, false diablo, round(case when f_ord % 2 = 0 then f_ord / 64.0 end, 6) stability from cs where n_methods >= 2")
def _grid(spark, d):
    stability = embedding_layer(spark, d).where("f_ord % 2 = 0").select("layer", "feature", F.round(F.col("f_ord") / 64.0, 6).alias("stability")).distinct()
    return evidence.convergence_grid(evidence.find_consensus(importance(spark, d), 30), stability, 2)


@query("q_summary_union", "select l_returnflag layer, count(*) n, cast(null as double) mean from lineitem group by 1 union all select o_orderpriority, count(*), round(avg(o_totalprice), 2) + 0.0 from orders group by 1")
def _summary(spark, d):
    a = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("layer")).agg(F.count("*").alias("n"))
    b = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("layer")).agg(F.count("*").alias("n"), r6(F.avg("o_totalprice"), 2).alias("mean"))
    return evidence.fused_summary(a, b)


@query("q_class_means", f'with {EMB} select grp, feature, round(avg("value"), 6) + 0.0 mean, cast(rank() over (partition by feature order by round(avg("value"), 6)) as integer) "rank" from emb group by 1, 2')
def _class_means(spark, d):
    from pyspark.sql import Window

    out = stats.class_means(embedding_layer(spark, d)).select("grp", "feature", r6("mean").alias("mean"))
    return out.withColumn("rank", F.rank().over(Window.partitionBy("feature").orderBy("mean")))


@query("q_short_names", """with n as (select case p_partkey % 8 when 0 then p_name || ' Area' when 1 then p_name when 2 then p_name || ';aaaaaaaaaaaa;bbbbbbbbbbbbbb' when 3 then p_name || ' : Conc. (nM)'
   when 4 then 'a_' || p_name || '_0.0 : Conc. (nM)' when 5 then p_name || ' 0.0 : Conc. (nM)' when 6 then 'p_' || p_name || ';r : Conc. (nM)' else p_name || ';bbbbbbbbbbbbbbbbbbbb Area' end f from part),
 s as (select f, replace(f, ' : Conc. (nM)', '') o from n)
 select f feature, case when f <> o and contains(o, '_') then trim(replace(replace(substr(o, strpos(o, '_') + 1), '_0.0', ''), ' 0.0', '')) when suffix(o, ' Area') then left(o, length(o) - 5) when contains(o, ';') and length(o) > 20 then split_part(o, ';', 1) else o end short from s""")
def _short(spark, d):
    c = F.col("p_name")
    kinds = [F.concat(c, F.lit(" Area")), c, F.concat(c, F.lit(";aaaaaaaaaaaa;bbbbbbbbbbbbbb")), F.concat(c, F.lit(" : Conc. (nM)")), F.concat(F.lit("a_"), c, F.lit("_0.0 : Conc. (nM)")), F.concat(c, F.lit(" 0.0 : Conc. (nM)")), F.concat(F.lit("p_"), c, F.lit(";r : Conc. (nM)")), F.concat(c, F.lit(";bbbbbbbbbbbbbbbbbbbb Area"))]
    return spark.read.parquet(f"{d}/part.parquet").select(F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int")).alias("feature")).select("feature", prep.short_feature_name(F.col("feature")).alias("short"))


@query("q_stability_text", "select p_partkey, case when s = 0 then '\u2014' else printf('%.2f', s) end \"text\", case when s = 0 then '#bbbbbb' when s >= 0.8 then '#2166ac' else '#666666' end colour, case when s >= 0.8 then 'bold' else 'normal' end weight from (select p_partkey, (p_partkey % 11) / 10.0 s from part)")
def _stability_text(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", prep.stability_text((F.col("p_partkey") % 11) / 10.0).alias("x")).select("p_partkey", "x.*")


@query("q_top_features", f'with {EMB}, m as (select feature, avg(abs("value")) score from emb group by 1) select feature, round(score, 6) + 0.0 score from m order by score desc, feature limit 15')
def _top(spark, d):
    found = embedding_layer(spark, d).groupBy("feature").agg(F.avg(F.abs("value")).alias("score"))
    return stats.head(found, "score").select("feature", r6("score").alias("score"))


@query("q_scaling", f'with {EMB} select layer, feature, round(avg("value"), 6) + 0.0 mean, round(sqrt(stddev_samp("value")), 6) + 0.0 divisor from emb group by all')
def _scaling(spark, d):
    return prep.scaling(embedding_layer(spark, d), True).select("layer", "feature", r6("mean").alias("mean"), r6("divisor").alias("divisor"))


@query("q_infer_layer", "select o_orderkey, case when contains(o_orderpriority, 'HIGH') then 'HIGH' when contains(o_orderpriority, 'LOW') then 'LOW' else 'unknown' end layer from orders")
def _infer(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", prep.infer_layer(F.col("o_orderpriority"), ("HIGH", "LOW")).alias("layer"))


@query("q_histogram", "with m as (select min(o_totalprice) a, max(o_totalprice) z from orders), b as (select cast(least(floor((o_totalprice - a) / (z - a) * 30), 29) as integer) b, a, z from orders, m) select b bin, round(a + b * (z - a) / 30, 4) + 0.0 low, round(a + (b + 1) * (z - a) / 30, 4) + 0.0 high, count(*) n from b group by all")
def _histogram(spark, d):
    return evidence.histogram(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice").select("bin", r6("low", 4).alias("low"), r6("high", 4).alias("high"), "n")


@query("q_permutation_p", """with t as (select event_type, avg("value") true_value from events group by 1)
 select event_type, round((count(*) filter (e."value" >= t.true_value) + 1) / (count(e."value") + 1), 6) + 0.0 p from events e join t using (event_type) group by 1""")
def _permutation_p(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value")
    true = e.groupBy("event_type").agg(F.avg("value").alias("true_value"))
    return e.join(true, "event_type").groupBy("event_type").agg(r6(stats.permutation_p(F.col("value"), F.col("true_value"))).alias("p"))


FIRST = GRAM + """, s as (select f_ord f, sum(v) filter (grp = (select min(grp) from x)) s from x group by 1), k as (select * from s order by abs(s) desc, f limit 5),
 wt as (select s.f, case when k.f is null then 0 else s.s / sqrt((select sum(s * s) from k)) end w from s left join k on s.f = k.f)"""


def _first_component(obs):
    rows = latent.block_rows(obs)
    return rows, latent.SPLSDA(1, 5, max_iter=1).fit(latent.gather_moments(rows))


@pair_query("q_pls_first_scores", f"with {FIRST} select sample_id, round(sum(v * w), 6) + 0.0 score from x join wt on wt.f = x.f_ord group by 1")
def _first_scores(obs, spark, d):
    rows, m = _first_component(obs)
    return latent.predict_rows(rows, m).select("sample_id", r6(F.col("scores")[0]).alias("score"))


@pair_query("q_pls_first_vip", f"with {FIRST} select f, round(sqrt(64) * abs(w), 6) + 0.0 vip, sqrt(64) * abs(w) >= 1 important from wt")
def _first_vip(obs, spark, d):
    m = _first_component(obs)[1]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.vip)], "f int, vip double").select("f", r6("vip").alias("vip"), (F.col("vip") >= 1).alias("important"))


TWO_COMPONENTS = FIRST + """, t1 as (select sample_id, any_value(grp) grp, sum(v * w) t from x join wt on wt.f = x.f_ord group by 1), n1 as (select sum(t * t) tt from t1),
 p1 as (select f_ord f, sum(v * t) / (select tt from n1) p from x join t1 using (sample_id) group by 1), q1 as (select grp, sum(t) / (select tt from n1) q from t1 group by 1),
 y1 as (select sample_id, t, case when grp = (select min(grp) from t1) then 1.0 else 0 end y from t1), y2 as (select sample_id, t, y - (select avg(y) from y1) - t * (select q from q1 order by grp limit 1) y from y1),
 x2 as (select x.sample_id, x.grp, x.f_ord, v - t * p v, y from x join y2 using (sample_id) join p1 on p1.f = x.f_ord), s2 as (select f_ord f, sum(v * y) s from x2 group by 1), k2 as (select * from s2 order by abs(s) desc, f limit 5),
 w2 as (select s2.f, case when k2.f is null then 0 else s2.s / sqrt((select sum(s * s) from k2)) end w from s2 left join k2 on s2.f = k2.f), t2 as (select sample_id, any_value(grp) grp, sum(v * w) t from x2 join w2 on w2.f = x2.f_ord group by 1), n2 as (select sum(t * t) tt from t2),
 p2 as (select f_ord f, sum(v * t) / (select tt from n2) p from x2 join t2 using (sample_id) group by 1), q2 as (select grp, sum(t) / (select tt from n2) q from t2 group by 1),
 ss as (select (select tt from n1) * (select sum(q * q) from q1) a, (select tt from n2) * (select sum(q * q) from q2) b)"""


@query("q_pls_components", f"with {TWO_COMPONENTS} select wt.f, round(wt.w, 6) + 0.0 weight1, round(w2.w, 6) + 0.0 weight2, round(p1.p, 6) + 0.0 loading1, round(p2.p, 6) + 0.0 loading2, round(sqrt(64 * (wt.w ^ 2 * a + w2.w ^ 2 * b) / (a + b)), 6) + 0.0 vip from wt join w2 using (f) join p1 using (f) join p2 using (f), ss")
def _components(spark, d):
    m = latent.SPLSDA(2, 5, max_iter=1).fit(latent.gather_moments(latent.block_rows(embedding_layer(spark, d))))
    out = spark.createDataFrame([(i, *map(float, (*m.w[i], *m.p[i], m.vip[i]))) for i in range(len(m.w))], "f int, weight1 double, weight2 double, loading1 double, loading2 double, vip double")
    return out.select("f", *[r6(c).alias(c) for c in out.columns[1:]])


@query("q_selected_overlap", f"with {EMB}, {IMP} select a.method a, b.method b, count(*) n from tp a join tp b on a.f_ord = b.f_ord and a.m_ord < b.m_ord group by 1, 2")
def _overlap(spark, d):
    return evidence.selected_overlap(importance(spark, d), 30)


# --- models: no SQL; tested against published numbers and plain versions


@query("q_splsda_vip")
def splsda_vip(spark, d):
    obs = prep.prepare_block(embedding_layer(spark, d))
    names = [r.feature for r in obs.select("feature", "f_ord").distinct().orderBy("f_ord").collect()]
    m = latent.SPLSDA(2, 10).fit(latent.gather_moments(latent.block_rows(obs)))
    return spark.createDataFrame([(n, float(v), bool(v >= 1)) for n, v in zip(names, m.vip)], "feature string, vip double, important boolean").orderBy(F.desc("vip"), "feature")


@query("q_diablo_vip")
def diablo_vip(spark, d):
    moments = latent.gather_moments(latent.block_rows(embedding_layer(spark, d)))
    m = latent.DIABLO([32, 32], 2, [[5, 5], [5, 5]]).fit(moments)
    return spark.createDataFrame([(b, i, float(v)) for b, vs in enumerate(m.vips()) for i, v in enumerate(vs)], "block int, f int, vip double")


def _ordinal_rows(spark, d):
    return latent.block_rows(embedding_layer(spark, d)).withColumn("y", F.col("grp").cast("int"))


@query("q_ordinal_coefficients")
def ordinal_coefficients(spark, d):
    fitted = ordinal.fit_rows(_ordinal_rows(spark, d))
    return spark.createDataFrame([(m, i, float(w), abs(float(w))) for (m, _), o in fitted.items() for i, w in enumerate(o.w)], "model string, f int, coefficient double, abs_coefficient double").orderBy("model", F.desc("abs_coefficient"), "f")


@query("q_forest_permutation")
def forest_permutation(spark, d):
    r = forest_rows.permutation_test(latent.block_rows(embedding_layer(spark, d)))
    return spark.createDataFrame([(i, v, r["true_accuracy"], r["p_value"]) for i, v in enumerate(r["null"])], "perm long, accuracy double, true_accuracy double, p_value double")


@query("q_splsda_loadings")
def splsda_loadings(spark, d):
    m = latent.SPLSDA(2, 10).fit(latent.gather_moments(latent.block_rows(embedding_layer(spark, d))))
    return spark.createDataFrame(latent.loadings(m, [f"d{i:02d}" for i in range(64)]), "feature string, component int, weight double, loading double")


@query("q_splsda_scores")
def splsda_scores(spark, d):
    rows = latent.block_rows(embedding_layer(spark, d))
    return latent.predict_rows(rows, latent.SPLSDA(2, 10).fit(latent.gather_moments(rows))).select("sample_id", "grp", "scores", "predicted")


@query("q_dendrogram_order")
def dendrogram_order(spark, d):
    found = _network(spark, d)
    return spark.createDataFrame([(k, f, int(found["labels"][f])) for k, f in enumerate(network.leaf_order(found["merges"]))], "place int, f int, module int")


@query("q_network_modules")
def network_modules(spark, d):
    return _network(spark, d)["modules"]


def _network(spark, d):
    return network.run_network(embedding_layer(spark, d), _trait(spark, d), power=2, min_module_size=3, cut_height=0.995)


@query("q_eigengenes")
def eigengenes(spark, d):
    return _network(spark, d)["eigengenes"]


@query("q_module_trait")
def module_trait(spark, d):
    return _network(spark, d)["module_trait"]


@query("q_reduced_layer")
def reduced_layer(spark, d):
    return network.reduce_by_network(embedding_layer(spark, d), _network(spark, d))


@query("q_diablo_block_correlations")
def diablo_block_correlations(spark, d):
    m = latent.DIABLO([32, 32], 1).fit(latent.gather_moments(latent.block_rows(embedding_layer(spark, d))))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m.block_corr)], "block int, other int, r double")


@query("q_diablo_selected")
def diablo_selected(spark, d):
    m = latent.DIABLO([32, 32], 2, [[5, 5], [5, 5]]).fit(latent.gather_moments(latent.block_rows(embedding_layer(spark, d))))
    return spark.createDataFrame([(b, c, f, w) for b in range(2) for c in range(2) for f, w in m.selected(b, c)], "block int, component int, f int, loading double")


@query("q_ordinal_cv")
def ordinal_cv(spark, d):
    found = ordinal.cross_validate(_ordinal_rows(spark, d))
    return found.groupBy("model").agg(stats.accuracy("y", "predicted").alias("accuracy"), stats.mean_absolute_error("y", "predicted").alias("mae"))
