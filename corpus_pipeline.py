"""The corpus pipeline: language, toxicity, near-duplicates, mixing, packing; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bbit_minhash, bin_completion, language_id, mixing, toxic_segments
from tidewell.llm.batches import text_or_empty
from tidewell.session import scratch_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    model = language_id.fit(docs)
    found = docs.withColumn("_language", language_id.language(text_or_empty(), model))
    return found.filter(F.col("_language.lang_pred") != language_id.UNDETERMINED).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxic_segments.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_toxicity", toxic_segments.toxicity(text_or_empty(), model)).filter(F.col("_toxicity") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the least id.

    Rows equal in id and text are one document; texts without words are all kept.
    """
    found = bbit_minhash.near_duplicates(docs, n=5, similarity=80)
    kept = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (F.col("n_shingles") == 0).alias("_empty")).distinct()
    keyed = docs.withColumn("_own", F.xxhash64(text_or_empty()))
    met = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    salted = met.withColumn("_salt", F.when(F.col("_empty"), F.monotonically_increasing_id()).otherwise(0))
    return salted.dropDuplicates(["doc_id", "_own", "_salt"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources holds it (not at all, once or twice).

    Null and empty texts have no words and are taken as often as their source is
    complete; a null source is the last one; rows equal in all columns are alike.
    """
    row = F.xxhash64(*docs.columns)
    mixed = mixing.mix(docs, extra=[row.alias("_row")])
    copies = mixed.filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_key")).agg(F.max("copies").cast("int").alias("_copies"))
    met = docs.withColumn("_row", row).join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; null and empty texts are the end id alone, repeated rows are packed each."""
    return bin_completion.pack_documents(docs, keep_words=False)


STAGES = [("language_id", keep_languages), ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources),
          ("packing", pack_sequences)]

ORACLE_SQL = None
"""Fitted models and a tokenizer: SQL cannot express the stages; tests/llm compares each with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
