"""Token ids in Parquet list columns: dictionary-coded ids, delta-coded keys, controlled row groups, page indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc
from .tokens import word_ids

#: The file format: one row for each document, ascending within and across parts.
SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Writer settings. Version 2 pages give the keys delta coding; ids are dictionary-coded (a vocabulary's indexes fit
#: in 16 bits); small pages and the page index let a reader fetch a few documents, or the metadata alone.
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "snappy",
}


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode each row's whole text, append ``end_id``, and write the ids in ascending ``doc_id`` order to ``path``.

    Null doc_ids come first, as in Spark's order; rows with equal ids are ordered by their text's hash and then by the text,
    so ranges can part them and repeated rows give equal rows. Null and empty texts hold the end id alone. Other columns are left out. An empty table writes
    an empty file.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        ids_of = word_ids(tokenizer, spaced).ids
        for batch in batches:
            rows = [ids_of(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(r) // 4 for r in rows], "int64")
            starts = start + np.concatenate([[0], np.cumsum(n)])
            start = int(starts[-1])
            offsets = np.concatenate([[0], np.cumsum(n)]).astype("int32")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rows), part, "int32")), pa.array(starts[:-1]), pa.array(n.astype("int32")), ids], names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    order = ["doc_id", F.xxhash64("text")]
    ranged = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ranged.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The files' rows; ``where`` on doc_id is pushed to row groups and pages. Selecting no ids reads none."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if where is None else rows.where(where)


def part_starts(files: DataFrame) -> DataFrame:
    """``part, part_start``: ids in all parts before; reads the metadata columns alone, a row for each part."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for each stored document, all taken from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [crc(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    files = read_token_files(spark, path)
    rows = files.select("doc_id", "part", "local_start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens int, ids_crc32 long")
    return rows.join(part_starts(files), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
