"""Resampling of documents to look like a target: importance weights of hashed word runs, drawn by Gumbel noise."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, summed
from .common import forget, written

#: Buckets of the features, longest run of words, seed of the noise.
BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Buckets in one row of a shuffle.
PIECE = 500
#: Words that a document needs to be drawn, and the share drawn: DRAWN[0] of DRAWN[1].
LEAST_WORDS, DRAWN = 20, (5, 100)
#: Of UTF-8 bytes after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text: str | None) -> tuple[int, np.ndarray]:
    """Words of the whole text, and the bucket of each run of 1 to LONGEST consecutive words, repeats counted.

    The checksum of a run goes on from that of the run without its last word, so each run costs its last word alone.
    """
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    sums = [*map(crc32, words)]
    spaced = [b" " + w for w in words]
    out = [sums]
    for k in range(1, min(LONGEST, len(words))):
        sums = [*map(crc32, spaced[k:], sums)]
        out.append(sums)
    return len(words), np.fromiter((s for part in out for s in part), "int64", sum(map(len, out))) % BUCKETS


def collapse(df: DataFrame, text: str = "text") -> DataFrame:
    """``digest, copies, n_words, buckets`` of each distinct text: equal texts are one row, whatever their number.

    Copies are counted where they are before they are shuffled. ``buckets`` holds the features' buckets in rising order
    as the steps between them, two bytes each, which are mostly small. Null and empty texts are one text without words.
    """
    distinct = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_buckets(t) for t in batch.column(1).to_pylist()]
            steps = [np.diff(np.sort(b), prepend=0).astype("<u2").tobytes() for _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array(steps, pa.binary())], names=["digest", "copies", "n_words", "buckets"])

    return distinct.select(digest("text"), "text", "copies").mapInArrow(features, "digest binary, copies long, n_words long, buckets binary")


def digest(text: str) -> Column:
    """Stands for the whole text where texts are joined."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all texts of ``collapse``, copies counted; each task sums its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, "int64")
        for batch in batches:
            for copies, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += copies * np.bincount(np.cumsum(np.frombuffer(steps, "<u2"), dtype="int64"), minlength=BUCKETS)
        if total.any():
            yield array_rows({"first": np.arange(0, BUCKETS, PIECE)}, [total[a : a + PIECE].astype(float) for a in range(0, BUCKETS, PIECE)])

    out = np.zeros(BUCKETS, "int64")
    for r in summed(texts.select("copies", "buckets").mapInArrow(count, "first long, v array<double>"), "first").toLocalIterator():  # BUCKETS numbers
        out[r.first : r.first + len(r.v)] = r.v
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds to a weight: 1000 times the log of its target's over its source's share, floored."""
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS)))) for a, b in zip(source.tolist(), target.tolist())], "int64")


def weigh(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``digest, copies, n_words, n_features, weight``: the sum of a text's features' gains."""
    held = texts.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.cumsum(np.frombuffer(b, "<u2"), dtype="int64") for b in batch.column(3).to_pylist()]
            sums = [int(held.value[b].sum()) for b in at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(b) for b in at], pa.int64()), pa.array(sums, pa.int64())], names=["digest", "copies", "n_words", "n_features", "weight"])

    return texts.select("digest", "copies", "n_words", "buckets").mapInArrow(add, "digest binary, copies long, n_words long, n_features long, weight long")


def noise(key: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel-distributed number that the key alone decides, floored; null keys are the empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", least_words: int = LEAST_WORDS, drawn: tuple[int, int] = DRAWN, seed: int = SEED) -> DataFrame:
    """``key, n_features, weight, score, rank`` for each row of ``df``: how much like ``target`` its text is, and its place
    among those drawn without replacement (Gumbel top-k), null if it isn't.

    Identical texts are collapsed by their full text; features and weights are made once for each, counts go in by their
    number of copies, and weights are joined back to the rows, each of which gets noise of its own key. Rows of fewer
    than ``least_words`` words are never drawn. Of those with as many, N, the floor(N * drawn) highest scores are; ties go
    to the smaller key, null keys last, then by text.

    Null and empty texts have no feature, weight 0 and no rank. Repeated rows are scored and drawn one by one, with equal
    scores. Texts of any length are read whole. An empty target gives every bucket its part of the smoothing alone; an
    empty table gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    texts = written(collapse(rows), "texts", compression="zstd")
    wanted = bucket_counts(collapse(target.select(F.col(target_text).alias("text"))))
    weights = weigh(texts, gains(bucket_counts(texts), wanted)).drop("copies")
    # a text with many copies is one row on the right and many on the left, which adaptive execution splits
    scored = written(rows.select("key", digest("text")).join(weights, "digest").withColumn("score", F.col("weight") + noise("key", seed)), "scored")
    forget(texts)

    # places among those that may be drawn: ranges of scores are ordered by themselves and begin where the ranges before end
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("digest")]
    ranged = able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    ranged = written(ranged.select("key", "n_features", "weight", "score", F.shiftrightunsigned("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"), F.expr(f"sum(n) over () * {drawn[0]} div {drawn[1]}").alias("most"))
    rank = F.col("start") + F.col("place") + 1
    ranked = ranged.join(F.broadcast(starts), "part").select("key", "n_features", "weight", "score", F.when(rank <= F.col("most"), rank).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("key", key)
