"""Feature layers as one long table: ``layer, sample_id, s_ord, grp, feature, f_ord, value``.

Missing cells are SQL nulls, never NaN. ``s_ord`` and ``f_ord`` keep the order of rows and columns, which drives
resampling and breaks ties.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types, at most: each is a column of one aggregation.
MAX_COLUMNS = 2_000

OBS = "layer string, sample_id string, s_ord long, grp string, feature string, f_ord int, value double"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def long_form(wide: DataFrame, layer: str, sample: str, group: str, order: str | None = None) -> DataFrame:
    """One row for each cell of a wide table; any column name is allowed."""
    features = [c for c in wide.columns if c not in (sample, group, order)]
    place = F.col(quoted(order)) if order else F.lit(0)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("f_ord"), F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None)).alias("value")) for i, c in enumerate(features)])
    return wide.select(F.lit(layer).alias("layer"), F.col(quoted(sample)).cast("string").alias("sample_id"), place.cast("long").alias("s_ord"), F.col(quoted(group)).cast("string").alias("grp"), F.inline(cells))


def load_layer(spark: SparkSession, path: str, layer: str, group_col: str = "Groups", sample_col: str = "Sample") -> DataFrame:
    """A layer from a CSV file with a header; an unnamed first column holds the sample ids. The file is one task's work
    (a layer's samples are few; many rows come as Parquet), so the order of its lines is kept."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    if sample_col not in wide.columns and (wide.columns[0] in ("_c0", "") or wide.columns[0].startswith("Unnamed")):
        wide = wide.withColumnRenamed(wide.columns[0], sample_col)
    if group_col not in wide.columns:
        raise KeyError(group_col)
    return long_form(wide.withColumn("__order", F.monotonically_increasing_id()), layer, sample_col, group_col, "__order")


def load_layers(spark: SparkSession, paths: dict[str, str], **columns) -> DataFrame:
    """The union of all layers whose file is there; a missing one is reported and left out."""
    hadoop, out = spark.sparkContext._jvm.org.apache.hadoop.fs, None
    for layer, path in paths.items():
        place = hadoop.Path(path)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            print(f"Warning: no file for layer {layer}: {path}")
            continue
        one = load_layer(spark, path, layer, **columns)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], OBS) if out is None else out


def embedding_layer(spark: SparkSession, sf_dir: str, layer: str = "emb") -> DataFrame:
    """Each dimension of the embeddings is a feature."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("f_ord", "value"))
    return rows.select(F.lit(layer).alias("layer"), F.col("vec_id").cast("string").alias("sample_id"), F.col("vec_id").alias("s_ord"), F.col("label").cast("string").alias("grp"), F.format_string("d%02d", "f_ord").alias("feature"), "f_ord", F.col("value").cast("double").alias("value"))


def event_layer(spark: SparkSession, sf_dir: str, layer: str = "events") -> DataFrame:
    """A sample is a user's day, a feature an event type, a value their mean; types without events are null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(MAX_COLUMNS + 1).collect()]
    if len(kinds) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} event types")
    days = e.groupBy("user_id", "day").agg(*[F.avg(F.when(F.col("event_type").eqNullSafe(k), F.col("value"))).alias(f"v{i}") for i, k in enumerate(kinds)])
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(i).alias("f_ord"), F.col(f"v{i}").alias("value")) for i, k in enumerate(kinds)])
    return days.select(
        F.lit(layer).alias("layer"), F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("sample_id"), F.col("user_id").alias("s_ord"),
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("grp"), F.inline(cells),
    )


def word_profiles(spark: SparkSession, sf_dir: str, features: int = 5319, first: int | None = None) -> DataFrame:
    """``sample_id, grp, x``: each source and language of the documents as a sample, by the share (in thousandths) of its
    words, or of their ``first`` letters, that falls into each of ``features`` hashed buckets; a wide block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    words = docs.select(F.coalesce("source", F.lit("")).alias("source"), "lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    counts = words.withColumn("word", F.col("word") if first is None else F.substring("word", 1, first)).groupBy("source", "lang", "word").agg(F.count("*").alias("n"))
    bucket = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long") % features
    sums = counts.groupBy("source", "lang", bucket.cast("int").alias("b")).agg(F.sum("n").alias("n"))
    one = sums.groupBy("source", "lang").agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n"), F.sum("n").alias("total"))  # features entries at most

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, features))
            for k, (b, n, total) in enumerate(zip(*(batch.column(i) for i in (2, 3, 4)))):
                x[k, b.values.to_numpy()] = n.values.to_numpy() * 1000.0 / total.as_py()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * features, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["sample_id", "grp", "x"])

    return one.select(F.concat_ws("|", "source", "lang"), "lang", "b", "n", "total").mapInArrow(dense, "sample_id string, grp string, x array<double>")


def load_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table that ``save_table`` wrote; an unnamed first column of a CSV file is left out."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    out = spark.read.csv(path, header=True, inferSchema=True)
    return out.drop(out.columns[0]) if out.columns and out.columns[0] in ("_c0", "") else out


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet by default; ``csv`` writes one file with a header, for small result tables."""
    if fmt == "csv":
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def results_dir(base: str, name: str) -> Path:
    place = Path(base) / name
    place.mkdir(parents=True, exist_ok=True)
    return place


def save_json(data, path: str) -> None:
    """JSON with numbers of any numeric library as plain ones."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, indent=2, default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x)))
