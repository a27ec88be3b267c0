"""Token counts: a broadcast table of frequent pre-token lengths, then worker caches; no pre-token is shuffled.

The table comes from a bounded number of rows: the few tasks that count their pre-tokens hand bounded tables to the driver
through an accumulator.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path, worker_state
from .tokens import LONG, PieceCounts, pre_tokens

#: Pre-tokens in the broadcast table (at most LONG characters each, so under 10 MB).
TABLE = 32_768
#: Pre-tokens that one task reports, and that it keeps while it counts.
REPORT, KEEP = 2_048, 200_000
#: Rows, about, whose pre-tokens are counted for the table, and tasks that count them.
SAMPLE, SAMPLERS = 20_000, 16


class _Frequent(AccumulatorParam):
    """Adds tables of counts, and keeps the most frequent ``keep`` entries once there are twice as many."""

    def __init__(self, keep: int):
        self.keep = keep

    def zero(self, value: Counter) -> Counter:
        return Counter()

    def addInPlace(self, value1: Counter, value2: Counter) -> Counter:
        value1.update(value2)
        return Counter(dict(value1.most_common(self.keep))) if len(value1) > 2 * self.keep else value1


def frequent_pre_tokens(texts: DataFrame, size: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of some SAMPLE rows, dealt to SAMPLERS tasks at most; each keeps a bounded count table
    and reports its ``REPORT`` most frequent, the driver keeps ``4 * size`` of them. So neither the first pass nor what
    reaches the driver grows with the rows. It decides speed, never counts."""
    found = texts.sparkSession.sparkContext.accumulator(Counter(), _Frequent(4 * size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pre_tokens(text))
            if len(seen) > KEEP:
                seen = Counter(dict(seen.most_common(KEEP // 2)))
        found.add(Counter({w: n for w, n in seen.most_common(REPORT) if n > 1 and w and len(w) <= LONG and " " not in w}))
        yield from ()

    n = texts.count()
    some = texts if n <= SAMPLE else texts.where(F.rand(7) < SAMPLE / n)
    some.repartition(SAMPLERS).mapInArrow(count, "part string").write.format("noop").mode("overwrite").save()
    return [w for w, _ in sorted(found.value.items(), key=lambda x: (-x[1], x[0]))[:size]]


def count_tokens(df: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", limit: int = 4096, table: int = TABLE) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row's whole text.

    ``model`` is a SentencePiece BPE file whose normalizer is the identity. Null and empty texts have no bytes and no
    tokens. Repeated rows are counted one by one; columns of these three names are replaced; an empty table stays empty.
    """
    spark = df.sparkSession
    place = tokenizer_path(model)
    parts = frequent_pre_tokens(df.select(F.col(text).alias("text")), table)
    lengths = PieceCounts(place, {})
    # the compact form: one string with blanks between the pre-tokens, one array of lengths
    table_form = (" ".join(parts), np.array([lengths[p] for p in parts], "<u2").tobytes())
    shared, made = spark.sparkContext.broadcast(table_form), uuid.uuid4().hex
    carried = f"text-{made}"  # clashes with no column

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> PieceCounts:
            words, sizes = shared.value
            return PieceCounts(tokenizer_path(model), dict(zip(words.split(" "), np.frombuffer(sizes, "<u2").tolist())) if words else {})

        lookup = worker_state(("pieces", made), table).__getitem__
        for batch in batches:
            at = batch.schema.get_field_index(carried)
            n = [sum(map(lookup, pre_tokens(t))) if t else 0 for t in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(n, pa.int64())], names=[*(batch.schema.names[i] for i in rest), "n_tokens"])

    kept = df.drop("n_bytes", "n_tokens", "over_limit")
    out = kept.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    schema = out.schema.add("n_tokens", "long")
    return out.withColumn(carried, F.col(text)).mapInArrow(counts, schema).withColumn("over_limit", F.col("n_tokens") > limit)
