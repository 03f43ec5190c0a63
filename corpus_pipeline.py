"""From raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns the columns of ``documents``; the last returns ids.  ``run``
writes each stage's rows as Parquet in the shared folder and reads them for the
next, so a lost executor costs a part of one stage; when a stage is written, what
it read and wrote on the way is removed.

Cases that all stages share: a null text counts as empty and stays null; rows
with a null doc_id are kept by both deduplications; repeated rows are judged
alike; no documents give no rows; further columns of ``documents`` are carried
along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borelake.llm import bpe, decontaminate, jaccard, quality, substrings
from borelake.shared import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 5-word shingles of at least 0.8): that of smallest doc_id."""
    return jaccard.near_dedup(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that a document of smaller doc_id has; n_chars follows the text. Workers of the stages before may still hold memory, so a reader combines less text at a time."""
    left = substrings.dedup(docs, chunk=4 << 20)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each document. Workers of the stages before may still hold memory, so parts are small."""
    import public_tokenizers

    source = bpe.tokenizer_source(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(docs.select("doc_id", "text"), source, part=1 << 20, remembered=50_000).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", good), ("near_duplicates", distinct), ("repeated_strings", unrepeated), ("benchmark", unseen), ("tokens", encoded)]

#: SQL has no expression for the classifier, the fingerprints or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def after(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """The documents that ``stages`` leave."""
    if not stages:
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    name, stage = stages[-1]
    return written(lambda: stage(spark, after(spark, sf_dir, stages[:-1]), sf_dir), spark, name)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, after(spark, sf_dir, STAGES[:-1]), sf_dir)
