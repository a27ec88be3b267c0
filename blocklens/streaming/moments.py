"""Sufficient statistics kept up by a stream: Gram sums are additive, so each micro-batch adds its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pair_sums(rows: DataFrame) -> DataFrame:
    """``grp, i, j, n, sx, sxy`` from ``grp, x``: sums of each feature (j = i) and of products, for i <= j."""
    a = rows.select("grp", "x", F.posexplode("x").alias("i", "a"))
    b = a.select("grp", "i", "a", F.posexplode("x").alias("j", "b")).where("i <= j")
    return b.groupBy("grp", "i", "j").agg(F.count("*").alias("n"), F.sum("a").alias("sx"), F.sum(F.col("a") * F.col("b")).alias("sxy"))


def maintain(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each micro-batch's sums under its number, so that a batch that runs again replaces its own rows."""

    def add(batch: DataFrame, number: int) -> None:
        pair_sums(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark, path: str) -> DataFrame:
    sums = spark.read.parquet(path)
    return sums.groupBy("grp", "i", "j").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxy").alias("sxy"))
