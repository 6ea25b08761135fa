"""A training corpus from raw documents: the stages, each a DataFrame of documents in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenforge.llm import bpe, chains, mixing, oddsketch, queries
from screenforge.llm.text import short_batches
from screenforge.session import checkpointed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a posterior of at least one half; lang is set to it.

    The model learns from documents that name their language. Texts that are null or have no letter
    go. Repeated rows and rows that share a doc_id are judged each by their own text.
    """
    short_batches(spark)
    rows = docs.withColumn("__key", F.xxhash64("text"))
    found = queries.languages(docs, docs.select(F.xxhash64("text").alias("doc_id"), "text"))
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).groupBy("doc_id").agg(F.min("lang_pred").alias("__lang"))
    return rows.join(sure.withColumnRenamed("doc_id", "__key"), "__key").withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8): that of the smallest doc_id.

    Rows that share a doc_id are one document; the one with the first text stays (null before
    empty before others), of equal texts the one whose other columns have the smallest hash. Rows
    without doc_id stay, all of them. An empty table gives no rows; other columns may have any name.
    """
    short_batches(spark)
    kept = oddsketch.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct()
    wanted = docs.join(kept, docs["doc_id"] == kept["__id"], "left_semi")
    first = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns)))
    stays = wanted.groupBy(F.col("doc_id").alias("__id")).agg(first.alias("__row")).select("__row.*")
    return stays.unionByName(docs.where("doc_id IS NULL"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left without words go."""
    short_batches(spark)
    return chains.without_repeats(docs, chains.passages(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the wanted token shares of good, poor and toxic text; a rate above 1 repeats documents."""
    found, _ = mixing.mixed(docs, queries.domains(queries.table(spark, sf_dir, "labels")), queries.TARGETS, total="good")
    rates = checkpointed(found.groupBy(F.col("doc_id").alias("__id")).agg(F.max("rate").alias("__rate")))
    uses = mixing.copies(F.coalesce("__rate", F.lit(1.0)), F.col("doc_id"))
    joined = docs.join(rates, F.col("doc_id") == F.col("__id"), "left").withColumn("__uses", uses)
    return joined.where("__uses > 0").withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("__uses")))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the whole text's token ids and of the text they decode to."""
    short_batches(spark)
    spec = queries.tokenizer_json()
    return bpe.digests(bpe.decode(bpe.encode(docs, spec), spec))


STAGES = [
    ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("passages", passage_stage),
    ("mixing", mixing_stage), ("encoding", encoding_stage),
]
#: The stages are models and graph work, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage keeps is written to shared storage for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
