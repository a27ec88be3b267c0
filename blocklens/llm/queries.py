"""The operators' queries with production parameters, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, media, mixing, ngram_lm, packing, resampling, sharding, simhash, token_count, token_files, toxicity, whitening
from .common import documents, held_out, new_path, prepare

END_ID = 1


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path, "word_bpe_49k.json", END_ID, spaced=False)
    return token_files.token_digest(spark, path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(packing.pack_documents(documents(spark, sf_dir), "byte_bpe_50k.json", END_ID, spaced=True, room=450_000, binary=True))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_texts(documents(spark, sf_dir)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs)
    return langid.identify_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir)).select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_digest(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_digest(documents(spark, sf_dir))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mix_sources, op2_token_files, op3_token_counts, op4_packing, op5_toxicity, op6_media, op7_language, op8_sharding, op9_simhash, op10_ngram_jaccard, op11_whitening, op12_lm_scoring, op13_resampling, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.oracle(), "op10_ngram_jaccard": jaccard.oracle()}
