"""Statistics on long and pair tables as Catalyst expressions, and the stop rule of permutation tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import array_rows, broadcast_few, checkpointed, summed

#: Features of all layers together whose correlations are taken, at most (0.5 GB a matrix in a task).
MAX_FEATURES = 8_000
#: Distinct values that are ranked at once, and groups' ranges that are broadcast, at most.
RANKED = 200_000
#: Parts of a range in which a pass counts, and values of a group that are picked from directly.
BUCKETS, LEFT = 1024, 4096
#: Values that a task sums in one pass where some are missing (256 MB), at most.
MASKED_CELLS = 32_000_000


def average_rank(obs: DataFrame) -> DataFrame:
    """Values become ranks within their feature, ties their mean rank; nulls stay null.

    Distinct values are counted. Up to RANKED of them are ranked at once and broadcast. More are put into ranges of
    (layer, feature, value) and ranked inside each range; the counts of the feature's earlier ranges come on top. So no
    task holds a whole feature.
    """
    key = ["layer", "feature"]
    counts = obs.where("value is not null").groupBy(*key, "value").agg(F.count("*").alias("c"))
    few = counts.limit(RANKED + 1).toArrow()
    if few.num_rows <= RANKED:
        t = few.to_pandas().sort_values([*key, "value"])
        t["rank"] = t.groupby(key, dropna=False)["c"].cumsum() - (t["c"] - 1) / 2.0
        ranks = F.broadcast(obs.sparkSession.createDataFrame(pa.Table.from_pandas(t[[*key, "value", "rank"]], preserve_index=False), obs.select(*key, "value").schema.add("rank", "double")))
    else:
        ranged = checkpointed(counts.repartitionByRange(*key, "value").withColumn("part", F.spark_partition_id()))
        totals = ranged.groupBy(*key, "part").agg(F.sum("c").alias("t"))  # a row for each feature in a range
        before = totals.select(*key, "part", (F.sum("t").over(Window.partitionBy(*key).orderBy("part")) - F.col("t")).alias("before"))
        upto = F.sum("c").over(Window.partitionBy("part", *key).orderBy("value"))
        ranks = ranged.withColumn("upto", upto).join(before, [*key, "part"]).select(*key, "value", (F.col("before") + F.col("upto") - (F.col("c") - 1) / 2.0).alias("rank"))
    return obs.join(ranks, [*key, "value"], "left").withColumn("value", F.col("rank")).select(obs.columns)


def medians(obs: DataFrame, keys: tuple[str, ...] = ("layer", "feature", "grp")) -> DataFrame:
    """The keys and the exact ``median`` of each group's values (null without any), for groups of any size.

    A group's middle value lies in a range that is narrowed pass by pass: its rows are counted in BUCKETS equal parts of
    the range, and the part that holds the middle, from its least to its largest value, is the next range. Once no range
    holds more than LEFT rows these are picked from directly. So each pass shuffles counts, and no task holds a group.
    """
    spark = obs.sparkSession
    own = {k: f"__{k}" for k in keys}
    first = obs.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).withColumnsRenamed(own)
    first = _known(first)
    # one target for odd counts, two for even ones: the place of the value in the group, those below the range, those in it
    at = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("at")
    ranges = first.where("n > 0").select(*own.values(), at, "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    values = obs.where("value is not null").select(*keys, "value")

    def inside(ranges: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]
        return values.join(ranges, [*same, F.col("value").between(F.col("lo"), F.col("hi"))])

    by = [*own.values(), "at"]
    while (ranges.where("lo < hi").agg(F.max("inside")).first()[0] or 0) > LEFT:
        part = F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        open_ = inside(ranges.where("lo < hi")).groupBy(*by, "below", part.alias("part")).agg(F.count("*").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by).orderBy("part"))  # BUCKETS rows at most
        found = open_.withColumn("upto", upto).where("at < upto and at >= upto - c").select(*by, "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"))
        ranges = _known(found.unionByName(ranges.where("lo = hi")))
    done = ranges.where("lo = hi").select(*by, F.col("lo").alias("value"))
    rest = inside(ranges.where("lo < hi")).groupBy(*by, "below").agg(F.sort_array(F.collect_list("value")).alias("v"))  # LEFT values at most
    rest = rest.select(*by, F.element_at("v", (F.col("at") - F.col("below") + 1).cast("int")).alias("value"))
    middle = done.unionByName(rest).groupBy(*own.values()).agg((F.sum(F.col("value") / 2) * F.when(F.count("*") == 1, 2).otherwise(1)).alias("median"))
    groups = first.select(*[F.col(o).alias(k) for k, o in own.items()])
    return groups.join(middle, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()], "left").select(*keys, "median")


def _known(ranges: DataFrame) -> DataFrame:
    """Computed once; broadcast while small, else written where all executors read it."""
    few = broadcast_few(ranges, RANKED)
    return few if few is not ranges else checkpointed(ranges)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; null where a side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def feature_correlations(obs: DataFrame, method: str = "pearson") -> DataFrame:
    """``layer, i, j, r`` for feature pairs i < j (by ``f_ord``).

    Where no value is missing each task multiplies its samples' standardised rows and sends one array for each matrix
    row; these are added up by row. Where values are missing, each pair has the samples that hold both (pairs that no
    sample holds are left out, and those constant on their samples have no r). ``spearman`` ranks first.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown correlation method: {method}")
    x = average_rank(obs) if method == "spearman" else obs
    x = x.select("layer", "sample_id", "f_ord", "value")
    features = x.groupBy("layer", "f_ord").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).orderBy("layer", "f_ord").limit(MAX_FEATURES + 1).collect()
    if len(features) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    rows = x.groupBy("layer", "sample_id").agg(F.array_sort(F.collect_list(F.struct("f_ord", "value"))).alias("v"))  # one sample's features
    samples = {r.layer: r.n for r in rows.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    of: dict[str, list] = {}
    for f in features:
        of.setdefault(f.layer, []).append(f)
    names = sorted(of)
    ords = {k: np.array([f.f_ord for f in of[layer]]) for k, layer in enumerate(names)}
    mean = {k: np.array([f.mean for f in of[layer]]) for k, layer in enumerate(names)}
    by = {k: np.array([f.sd or np.nan for f in of[layer]]) for k, layer in enumerate(names)}
    if any(f.n != samples[f.layer] for f in features):
        return _masked_correlations(rows, names, ords, {k: np.array([f.mean or 0.0 for f in of[layer]]) for k, layer in enumerate(names)}, {k: np.array([f.sd or 1.0 for f in of[layer]]) for k, layer in enumerate(names)})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            which, values = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for k in map(int, np.unique(which)):
                z = np.stack([flat[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(which == k)])
                z = (z - mean[k]) / by[k]
                totals[k] = totals.get(k, 0.0) + z.T @ z
        for k, total in totals.items():
            for a in range(0, len(total), 64):
                own = range(a, min(a + 64, len(total)))
                yield array_rows({"k": np.full(len(own), k), "i": np.array(own)}, [total[i, i + 1 :] for i in own])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                r = np.clip(v.values.to_numpy(zero_copy_only=False) / samples[names[k]], -1, 1)
                j = ords[k][i + 1 :]
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(j), pa.string()), pa.array(np.full(len(j), ords[k][i], "int32")), pa.array(j.astype("int32")), pa.array(r, from_pandas=True)], names=["layer", "i", "j", "r"])

    if not names:
        return obs.sparkSession.createDataFrame([], PAIRS)
    dense = rows.select(_place(names).alias("k"), F.transform("v", lambda c: c["value"].cast("double")).alias("v"))
    return summed(dense.mapInArrow(multiply, "k long, i long, v array<double>"), "k", "i").mapInArrow(pairs, PAIRS)


PAIRS = "layer string, i int, j int, r double"


def _place(names: list[str]) -> Column:
    return F.element_at(F.create_map(*[c for k, name in enumerate(names) for c in (F.lit(name), F.lit(k).cast("long"))]), F.col("layer"))


def _masked_correlations(rows: DataFrame, names: list[str], ords: dict[int, np.ndarray], mean: dict[int, np.ndarray], by: dict[int, np.ndarray]) -> DataFrame:
    """Each pair over the samples that hold both: six sums of products of the values, their squares and the mask of those
    that are there, of standardised values with 0 for missing ones, so a sample adds whole rows and no pair is a row before
    all samples are summed. A pass takes as many features on the left as MASKED_CELLS allows."""

    def of(first: int, stripe: int) -> DataFrame:
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                which, (at, values) = batch.column(0).to_numpy(), (batch.column(c) for c in (1, 2))
                ends, flat, own = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False), at.values.to_numpy()
                for k in map(int, np.unique(which)):
                    if first >= len(ords[k]):
                        continue
                    some = np.flatnonzero(which == k)
                    x = np.full((len(some), len(ords[k])), np.nan)
                    for n, i in enumerate(some):
                        x[n, np.searchsorted(ords[k], own[ends[i] : ends[i + 1]])] = flat[ends[i] : ends[i + 1]]
                    there = (~np.isnan(x)).astype(float)
                    x = np.nan_to_num((x - mean[k]) / by[k])
                    left, l_there, square = x[:, first : first + stripe], there[:, first : first + stripe], x * x
                    l_square = square[:, first : first + stripe]
                    sums = np.stack([l_there.T @ there, left.T @ there, l_there.T @ x, l_square.T @ there, l_there.T @ square, left.T @ x])
                    totals[k] = totals.get(k, 0.0) + sums
            for k, total in totals.items():
                for i in range(total.shape[1]):
                    yield array_rows({"k": np.array([k]), "i": np.array([first + i])}, [total[:, i, first + i + 1 :].ravel()])

        cells = F.transform(F.filter("v", lambda c: c["value"].isNotNull()), lambda c: c["value"].cast("double"))
        dense = rows.select(_place(names).alias("k"), F.transform(F.filter("v", lambda c: c["value"].isNotNull()), lambda c: c["f_ord"].cast("int")).alias("at"), cells.alias("v"))
        return summed(dense.mapInArrow(multiply, "k long, i long, v array<double>"), "k", "i")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, x, y, xx, yy, xy = v.values.to_numpy(zero_copy_only=False).reshape(6, -1)
                j = ords[k][i + 1 :]
                with np.errstate(all="ignore"):
                    a, b, tiny = xx - x * x / n, yy - y * y / n, 8 * np.finfo(float).eps * n
                    r = np.where((n > 0) & (a > tiny * xx) & (b > tiny * yy), np.clip((xy - x * y / n) / np.sqrt(a * b), -1, 1), np.nan)
                met = n > 0
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * int(met.sum()), pa.string()), pa.array(np.full(int(met.sum()), ords[k][i], "int32")), pa.array(j[met].astype("int32")), pa.array(r[met], from_pandas=True)], names=["layer", "i", "j", "r"])

    most = max(len(o) for o in ords.values())
    stripe = max(1, MASKED_CELLS // (6 * most))
    out = None
    for first in range(0, most, stripe):
        one = of(first, stripe)
        out = one if out is None else out.unionByName(one)
    return out.mapInArrow(pairs, PAIRS)


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def mean_absolute_error(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)).cast("double"))


def class_means(obs: DataFrame) -> DataFrame:
    """``layer, feature, grp, mean`` over the values that are there."""
    return obs.groupBy("layer", "feature", "grp").agg(F.avg("value").alias("mean"))


def null_fraction(obs: DataFrame) -> DataFrame:
    """``layer, feature, nulls``: the share of missing values."""
    return obs.groupBy("layer", "feature").agg(F.avg(F.col("value").isNull().cast("double")).alias("nulls"))


def head(df: DataFrame, score: str, n: int = 15, name: str = "feature") -> DataFrame:
    """The ``n`` rows with the largest ``score``, of equal ones by ``name``, in that order."""
    return df.orderBy(F.desc(score), name).limit(n)


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts for the full grid of labels."""
    labels = df.select(F.col(y).alias("l")).union(df.select(F.col(p))).distinct().agg(F.collect_set("l").alias("ls"))  # labels only
    grid = labels.select(F.explode("ls").alias("y_true"), "ls").select("y_true", F.explode("ls").alias("y_pred"))
    seen = df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count("*").alias("n"))
    return grid.join(seen, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support for each label; 0 where nothing is divided by."""
    c = confusion(df, y, p)
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    recall = c.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    given = c.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("given"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    out = recall.join(given, "label").select("label", part("tp", "given").alias("precision"), part("tp", "support").alias("recall"), "support")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def binomial_cdf(k: int, n: int, p: float) -> float:
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if k >= 0 else 0.0


def settled(k: int, n: int, alpha: float = 0.05, confidence: float = 0.99) -> bool:
    """Whether k of n permutations at least as good put the p-value on one side of ``alpha`` (exact binomial interval)."""
    tail = (1 - confidence) / 2
    return binomial_cdf(k, n, alpha) < tail or 1 - binomial_cdf(k - 1, n, alpha) < tail


def permutation_p(null: Column, true: Column) -> Column:
    """Aggregate: the share of null values at least as large as ``true``, which itself counts as one; 1 without any."""
    return (F.coalesce(F.sum((null >= true).cast("long")), F.lit(0)) + 1) / (F.count(null) + 1).cast("double")


#: Nodes on [0, 1] and weights of the rule that integrates the tail of a correlation's distribution.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)
NODES, WEIGHTS = (NODES + 1) / 2, WEIGHTS / 2


def correlation_p(r: float, n: int) -> float:
    """``p_value`` of one correlation."""
    v = n - 2
    if v < 1 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0

    def tail(cos: float) -> float:
        """The integral of (cos t / cos)^(v - 1) from where the cosine is ``cos`` to where it adds nothing any more."""
        start = math.acos(cos)
        length = math.acos(cos * math.exp(-40 / max(v - 1, 1e-9))) - start
        return length * float(WEIGHTS @ np.exp((v - 1) * (np.log(np.cos(start + length * NODES)) - math.log(cos))))

    cos = math.sqrt(1 - r * r)
    return min(1.0, math.exp((v - 1) * math.log(cos)) * tail(cos) / tail(1.0))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs (Student's t with v = n - 2 degrees of freedom), for columns.

    With |r| as a sine, p is the integral of cos^(v - 1) from its angle to a right angle over the one from 0. Both take
    the same 64 nodes on the stretch where the integrand isn't negligible, so the work doesn't depend on n. Null for fewer
    than 3 pairs or no r, 0 for |r| = 1.
    """
    v, cos = (n - 2).cast("double"), F.sqrt(1 - r * r)
    nodes = F.lit([float(x) for x in NODES])

    def tail(cos: Column) -> Column:
        start = F.acos(cos)
        length = F.acos(cos * F.exp(F.lit(-40.0) / F.greatest(v - 1, F.lit(1e-9)))) - start
        each = F.zip_with(nodes, F.lit([float(w) for w in WEIGHTS]), lambda x, w: w * F.exp((v - 1) * (F.ln(F.cos(start + length * x)) - F.ln(cos))))
        return length * F.aggregate(each, F.lit(0.0), lambda s, x: s + x)

    p = F.least(F.lit(1.0), F.exp((v - 1) * F.ln(cos)) * tail(cos) / tail(F.lit(1.0)))
    return F.when((n >= 3) & (F.abs(r) >= 1) & ~F.isnan(r), F.lit(0.0)).when((n >= 3) & r.isNotNull() & ~F.isnan(r), p)
