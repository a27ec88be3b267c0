"""Rows that carry arrays: sums by key without a row for each element, and order numbers without a single task."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one stands in only where the session names none and
    everything runs in one process, as in tests."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(place or "file://" + tempfile.mkdtemp(prefix="blocklens-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read from there ever after."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_few(found: DataFrame, most: int) -> DataFrame:
    """A small table for joins: computed once, counted, and broadcast if it has ``most`` rows at most; else as it is."""
    rows = found.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return found
    return F.broadcast(found.sparkSession.createDataFrame(rows, found.schema))


def array_rows(keys: dict[str, np.ndarray], arrays: list[np.ndarray]) -> pa.RecordBatch:
    """A batch of long ``keys`` and, as ``v``, an array of doubles for each row."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("int32")
    v = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0)])))
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(k, "int64")) for k in keys.values()), v], names=[*keys, "v"])


def summed(rows: DataFrame, *keys: str, by: np.ufunc = np.add) -> DataFrame:
    """The arrays ``v`` of rows with equal long ``keys``, added up (or joined ``by`` another function) element by element; a
    task holds its keys' sums alone."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values, offsets = batch.column(len(keys)).values.to_numpy(zero_copy_only=False), batch.column(len(keys)).offsets.to_numpy()
            for *key, a, b in zip(*(batch.column(k).to_pylist() for k in range(len(keys))), offsets[:-1], offsets[1:]):
                own = totals.get(tuple(key))
                if own is None:
                    totals[tuple(key)] = values[a:b].copy()
                else:
                    by(own, values[a:b], out=own)
        order = sorted(totals)
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            yield array_rows({k: np.array([t[i] for t in some]) for i, k in enumerate(keys)}, [totals[t] for t in some])

    return rows.select(*keys, "v").repartition(*keys).mapInArrow(add, ", ".join(f"{k} long" for k in keys) + ", v array<double>")


def numbered(ids: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of ``column`` numbered from 0 in their order: each range of them by itself, and then by the ranges' sizes."""
    ranged = checkpointed(ids.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).select(column, F.monotonically_increasing_id().alias("__m")))
    part, place = F.shiftrightunsigned("__m", 33).alias("__part"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))  # a row for each range
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("start"))
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").select(column, (F.col("start") + place).alias(out))
