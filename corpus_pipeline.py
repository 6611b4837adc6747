"""The corpus pipeline: language identification, line dedup, near dedup, mixing of sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; each works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe, language, line_dedup, mixing, near_dup
from vectide.llm.common import materialize, new_path, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose language is less probable than this are rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language is uncertain. A missing lang is filled with the predicted one.
    Where no row has a lang nothing is learned: only texts that are null or have no letter are rejected, and lang stays null."""
    model = language.train(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.predict(docs, model, *COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows. A document that loses all its words goes."""
    found = line_dedup.dedup_lines(docs, "lang", "source", "n_chars")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    gone = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.where(~gone).withColumn("n_chars", n_chars).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id. Rows that repeat a doc_id and its
    text are one document. Rows are told apart by doc_id and a digest of the text; the texts are shuffled only if those that go
    are too many to broadcast."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    marked = docs.select(*COLUMNS, digest.alias("digest__"))
    found = materialize(near_dup.near_duplicates(marked, "digest__").select("doc_id", "digest__", "kept"), "near-duplicates")
    gone = small(found.where(~F.col("kept")).select(F.col("doc_id").alias("id__"), F.col("digest__").alias("gone__")).distinct())
    left = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("digest__") == F.col("gone__")), "left_anti")
    again = found.where("kept").groupBy("doc_id", "digest__").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        again = small(again.select(F.col("doc_id").alias("id__"), F.col("digest__").alias("gone__")))
        same = F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("digest__") == F.col("gone__"))
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "digest__"]))
    return left.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document of the mix: doc_id, n_tokens, the digests of ids and decoded bytes, and the ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the language model, nor line digests in Bloom filters, nor BPE merges are SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
