"""Filters, imputation, transforms, scaling and alignment of the long table.

A step aggregates what it needs of each feature (partial sums first, so a feature may hold any number of rows) and joins
the few statistics to the rows, which aren't shuffled as long as the counted statistics can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import broadcast_few, numbered
from ..functions.stats import medians

LAYER_ORDER = ("amino_acids", "aromatics", "central_carbon", "proteomics")
#: Features (or groups of them) whose statistics are broadcast, at most, by their counted number.
BROADCAST_ROWS = 200_000


def with_statistics(obs: DataFrame, keys: tuple[str, ...] = ("layer", "feature"), **aggregates: Column) -> DataFrame:
    """``obs`` with the aggregates of each row's group. They are computed at once, and counted; later steps read them."""
    return _joined(obs, obs.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()]), keys)


def _joined(obs: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    known = broadcast_few(found.withColumnsRenamed({k: f"__{k}" for k in keys}), BROADCAST_ROWS)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return obs.join(known, same).drop(*[f"__{k}" for k in keys])


def drop_sparse_features(obs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Keep features whose share of nulls is at most ``threshold``."""
    return with_statistics(obs, __nulls=F.avg(F.col("value").isNull().cast("int"))).where(F.col("__nulls") <= threshold).drop("__nulls")


def _half(low: Column) -> Column:
    return F.when(low / 2 > 0, low / 2).otherwise(F.lit(1.0))


def impute_half_min(obs: DataFrame) -> DataFrame:
    """Nulls become half of the feature's minimum; 1 if that isn't positive or there is none."""
    return with_statistics(obs, __low=F.min("value")).withColumn("value", F.coalesce("value", _half(F.col("__low")))).drop("__low")


def impute_group_median(obs: DataFrame) -> DataFrame:
    """Nulls become their group's exact median; where a group has none, half of the filled feature's minimum."""
    keys = ("layer", "feature", "grp")
    middle = _joined(obs, medians(obs, keys).withColumnRenamed("median", "__middle"), keys)
    return impute_half_min(middle.withColumn("value", F.coalesce("value", "__middle")).drop("__middle"))


def drop_constant_features(obs: DataFrame) -> DataFrame:
    return with_statistics(obs, __d=F.max("value") > F.min("value")).where("__d").drop("__d")


def _logged(low: Column, base: str) -> Column:
    moved = F.col("value") + F.when(low <= 0, F.abs(low) + 1).otherwise(F.lit(0.0)) + 1e-10
    return {"log2": F.log2, "log10": F.log10}.get(base, F.ln)(moved)


def log_transform(obs: DataFrame, base: str = "log") -> DataFrame:
    """Logarithm of each feature, moved above zero where its minimum isn't; other bases than log2 and log10 are natural."""
    return with_statistics(obs, __low=F.min("value")).withColumn("value", _logged(F.col("__low"), base)).drop("__low")


def scaling(obs: DataFrame, root: bool) -> DataFrame:
    """``layer, feature, mean, divisor``: what a scaling takes off and divides by (the root of the deviation, or itself)."""
    sd = F.stddev_samp("value")
    return obs.groupBy("layer", "feature").agg(F.avg("value").alias("mean"), F.when(sd > 0, F.sqrt(sd) if root else sd).otherwise(F.lit(1.0)).alias("divisor"))


def _scaled(obs: DataFrame, root: bool) -> DataFrame:
    sd = F.stddev_samp("value")
    known = with_statistics(obs, __mean=F.avg("value"), __by=F.when(sd > 0, F.sqrt(sd) if root else sd).otherwise(F.lit(1.0)))
    return known.withColumn("value", (F.col("value") - F.col("__mean")) / F.col("__by")).drop("__mean", "__by")


def pareto_scale(obs: DataFrame) -> DataFrame:
    return _scaled(obs, True)


def standard_scale(obs: DataFrame) -> DataFrame:
    return _scaled(obs, False)


def minmax_scale(obs: DataFrame, train: Column | None = None) -> DataFrame:
    """To [0, 1] by the rows for which ``train`` holds (all by default); a constant feature has range 1."""
    seen = F.col("value") if train is None else F.when(train, F.col("value"))
    known = with_statistics(obs, __low=F.min(seen), __high=F.max(seen))
    span = F.when(F.col("__high") > F.col("__low"), F.col("__high") - F.col("__low")).otherwise(F.lit(1.0))
    return known.withColumn("value", (F.col("value") - F.col("__low")) / span).drop("__low", "__high")


def prepare_block(obs: DataFrame, imputation: str = "half_min", transform: str | None = "log", scaling: str | None = "pareto", threshold: float = 0.5) -> DataFrame:
    """Sparse filter, imputation, constant filter, transform, scaling. An unknown scaling leaves values unscaled.

    All but the scaling follow from each feature's nulls and range (an imputed value is known beforehand), so two passes
    over the rows gather all statistics; group medians take one more of their own.
    """
    if imputation == "group_median":
        out = drop_constant_features(impute_group_median(drop_sparse_features(obs, threshold)))
        out = out if transform is None else log_transform(out, transform)
    else:
        nulls = F.avg(F.col("value").isNull().cast("int"))
        known = with_statistics(obs, __nulls=nulls, __low=F.min("value"), __high=F.max("value")).where(F.col("__nulls") <= threshold)
        fill, any_null = _half(F.col("__low")), F.col("__nulls") > 0
        low = F.when(any_null, F.least("__low", fill)).otherwise(F.col("__low"))
        high = F.when(any_null, F.greatest("__high", fill)).otherwise(F.col("__high"))
        out = known.where(high > low).withColumn("value", F.coalesce("value", fill))
        out = (out if transform is None else out.withColumn("value", _logged(low, transform))).drop("__nulls", "__low", "__high")
    return pareto_scale(out) if scaling == "pareto" else standard_scale(out) if scaling == "standard" else out


def encode_ordinal(df: DataFrame, order: list[str] | tuple = ("Green", "Ripe", "Overripe"), label: str = "grp", out: str = "y") -> DataFrame:
    """Rank of each label in ``order``; an unknown label is an error."""
    known = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    rank = F.try_element_at(known, F.col(label))
    return df.withColumn(out, F.when(F.col(label).isNull() | rank.isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null"))))).otherwise(rank))


def align_blocks(obs: DataFrame) -> DataFrame:
    """Rows of samples that all layers have, numbered from 0 in the order of their ids (``s_ord``)."""
    n = obs.select("layer").distinct().count()
    common = obs.select("layer", "sample_id").distinct().groupBy("sample_id").count().where(F.col("count") == n).select("sample_id")
    if common.isEmpty():
        raise ValueError("the layers have no sample in common")
    place = numbered(common, "sample_id", "s_ord")
    return obs.drop("s_ord").join(place, "sample_id").select(obs.columns)


def prepare_multiblock(obs: DataFrame, **options) -> DataFrame:
    """Align, then prepare each layer on what is left; labels have to agree between layers."""
    aligned = align_blocks(obs)
    if not aligned.groupBy("sample_id").agg(F.count_distinct("grp").alias("n")).where("n > 1").isEmpty():
        raise ValueError("layers disagree on a sample's label")
    return prepare_block(aligned, **options)


def early_fusion(obs: DataFrame, layers: list[str]) -> DataFrame:
    """One layer of all features, in the order of ``layers``; names get their layer in front."""
    order = F.array_position(F.array(*map(F.lit, layers)), F.col("layer"))
    width = obs.groupBy("layer").agg((F.max("f_ord") + 1).alias("w")).collect()  # a row for each layer
    sizes = {r["layer"]: r["w"] for r in width}
    starts = F.create_map(*[x for i, k in enumerate(layers) for x in (F.lit(k), F.lit(sum(sizes.get(j, 0) for j in layers[:i])))])
    return obs.where(order > 0).select(F.lit("fused").alias("layer"), "sample_id", "s_ord", "grp", F.concat("layer", F.lit(":"), "feature").alias("feature"), (F.col("f_ord") + F.element_at(starts, F.col("layer"))).alias("f_ord"), "value")


def short_feature_name(name: Column) -> Column:
    """A feature's name for display: of concentrations what follows the first underscore, of peak areas what precedes the
    word, of lists of accessions over 20 characters the first."""
    conc = F.lit(" : Conc. (nM)")
    plain = F.replace(name, conc, F.lit(""))
    core = F.replace(F.replace(F.regexp_replace(plain, "^[^_]*_", ""), F.lit("_0.0"), F.lit("")), F.lit(" 0.0"), F.lit(""))
    return (
        F.when(F.contains(name, conc) & F.contains(plain, F.lit("_")), F.regexp_replace(core, r"^\s+|\s+$", ""))
        .when(F.endswith(plain, F.lit(" Area")), F.regexp_replace(plain, " Area$", ""))
        .when(F.contains(plain, F.lit(";")) & (F.length(plain) > 20), F.substring_index(plain, ";", 1))
        .otherwise(plain)
    )


def stability_text(value: Column) -> Column:
    """``text, colour, weight`` of a stability for display; none and 0 are a dash. The colours are fixed values."""
    shown = F.format_string("%.2f", value)
    style = lambda text, colour, weight: F.struct(text.alias("text"), F.lit(colour).alias("colour"), F.lit(weight).alias("weight"))
    none = value.isNull() | F.isnan(value) | (value == 0)
    return F.when(none, style(F.lit("\u2014"), "#bbbbbb", "normal")).when(value >= 0.8, style(shown, "#2166ac", "bold")).otherwise(style(shown, "#666666", "normal"))


def infer_layer(methods: Column, layers: tuple = LAYER_ORDER) -> Column:
    """The first layer whose name stands in the text."""
    return F.coalesce(*[F.when(methods.contains(k), F.lit(k)) for k in layers], F.lit("unknown"))
