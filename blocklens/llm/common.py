"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of ``written`` that ``forget`` hasn't deleted, and what a worker keeps.
_written: dict = {}
_state: dict = {}
#: Rows in one Arrow batch; keeps a Python worker's memory to a few MB of text at a time.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that a shared checkpoint folder is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and everything runs in one process
    (as in tests) is it a temporary one; a cluster without a shared folder is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="blocklens-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written.setdefault(id(back), (back, path))
    return back


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    _, path = _written.pop(id(df), (None, None))
    if path:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the quarter of rows that no classifier may learn from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the name may also be a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)




def _give_back() -> None:
    """Return freed memory to the system where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_state(key, make):
    """What a Python worker keeps between tasks: one operator's tables at a time, so that they don't add up."""
    if key not in _state:
        _state.clear()
        _give_back()
        _state[key] = make()
    return _state[key]
