"""From raw documents to packed training sequences: five stages, each over all that the stage before it kept."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3
#: Entries in a worker's token tables: few, as workers of the stages before may still hold theirs.
ROOM = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language (op 7): those whose n-grams are likely in the language predicted.

    Null, empty and blank texts and those without a letter go. Repeated rows are judged alike, texts of any length whole.
    Columns besides those of documents are left out, whatever their names. An empty table stays empty; if no row is
    labelled, no language is known and all rows go.
    """
    from blocklens.llm import langid
    from blocklens.llm.common import prepare

    prepare(spark)
    return langid.identify_language(docs.select(*COLUMNS), langid.fit(docs), known="known").where("known").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that aren't predicted to be toxic (op 5).

    Null and empty texts have the score of a text without matches and stay. Repeated rows are judged alike, texts of any
    length whole. Other columns are left out; an empty table stays empty; without labels the hand-written lexicon judges.
    """
    from blocklens.llm import toxicity
    from blocklens.llm.common import prepare

    prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model, threshold=TOXIC).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component (op 10).

    Rows that share a doc_id are one document: of different texts the smallest stays, whatever the order of rows; of
    repeated rows, one. Texts without words are linked with nothing; they and rows without a doc_id stay. Texts of any
    length are compared whole; other columns are left out; an empty table stays empty.
    """
    from blocklens.llm import jaccard
    from blocklens.llm.common import prepare

    prepare(spark)
    found = jaccard.jaccard_components(docs)
    heads = found.where("component_id = doc_id and n_shingles > 0").select(F.col("doc_id").alias("k")).distinct()
    rows = docs.select(*COLUMNS).withColumn("blank", ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    chosen = rows.where("doc_id is not null and not blank").join(heads, F.col("doc_id") == F.col("k"), "left_semi")
    one = F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")
    kept = chosen.groupBy("doc_id").agg(one).select("doc_id", "x.*").select(*COLUMNS)
    return kept.unionByName(rows.where("doc_id is null or blank").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document the words that the mix takes of it (op 1), repeats counted: whole copies, and one cut after the
    words that are over, so each source's words come to those the mix takes.

    Texts without words stay once. Rows of one doc_id get their own shares, repeated rows one by one. A null source or
    doc_id is a value of its own. Other columns are left out; an empty table stays empty.
    """
    from blocklens.llm import mixing
    from blocklens.llm.common import prepare

    prepare(spark)
    rows = docs.select(*COLUMNS).withColumn("size", mixing.n_words("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy("taken"))  # repeated rows alone share one
    shares = mixing.words_taken(docs.select(*COLUMNS)).where("size > 0").select(F.col("key").alias("doc_id"), "source", "tie", "taken").withColumn("nth", nth)
    shares = shares.select(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("tie").alias("t"), F.col("nth").alias("m"), "taken")
    some = rows.where("size > 0").withColumn("tie", F.xxhash64("text"))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy("lang")))
    own = F.col("doc_id").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("tie") == F.col("t")) & (F.col("nth") == F.col("m"))
    both = some.join(shares, own).select(*COLUMNS, "size", "taken").unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                size, taken = row.pop("size"), row.pop("taken")
                out += [row] * (taken // size if size else 1)
                if size and taken % size:
                    end = next(islice(WORD.finditer(row["text"]), taken % size - 1, None)).end()
                    out.append(row | {"text": row["text"][:end], "n_chars": end})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([f for f in batch.schema if f.name in COLUMNS]))

    return both.mapInArrow(repeat, docs.select(*COLUMNS).schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, a row for each piece (op 4).

    Null and empty texts are the end id alone; repeated rows are packed one by one; texts of any length are packed whole;
    a null doc_id stays null; other columns are left out; an empty table gives no pieces.
    """
    from blocklens.llm import packing
    from blocklens.llm.common import prepare

    prepare(spark)
    return packing.pack_documents(docs, "byte_bpe_50k.json", 1, spaced=True, room=ROOM)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: Learned models and hashed sets aren't SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each one's rows are written as Parquet and read again."""
    from blocklens.llm.common import new_path, prepare

    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
