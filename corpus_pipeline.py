"""The corpus pipeline: toxicity, exact duplicates, near duplicates, mixing by source, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. ``run`` applies them to the documents of a folder. An empty table stays empty in every stage, null ids stay
null, and other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import bpe, common, exact_dedup, mixing, near, tokens, toxicity

#: The most passes over a source for one pass over the least repeated one. Every document is held once at least.
REPETITION = 1.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the labels of the folder train the scorer.

    Null and empty texts are scored as empty ones and stay unless those are toxic; repeated rows are scored each alike. Without labels of both kinds all
    texts get one score: the share of toxic labels among the labelled, 0 or 1.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased) the one with the largest doc_id.

    Null texts are empty ones. A null id stays only if its group has no other; of rows that have the id that stays, one does.
    """
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8 or more) the document with the smallest doc_id.

    Texts without words are alike, and texts of fewer words than a shingle are one shingle. A null id stays only if its group has no
    other. Rows of one id with different texts may each stand for a group; in one group the text with the smallest digest
    stays, and of equal rows one.
    """
    return near.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the flattest mix of sources with that repetition holds them, once at least.

    A null source is a source of its own; documents without words are held once. Rows with one id get the same number of copies.
    """
    return mixing.mix(docs, repetition=REPETITION)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document in the mix, one row for each copy. A null or empty text has no ids."""
    return bpe.encode_decode(docs, tokens.default_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage), ("mixing", mixing_stage), ("byte_level_bpe", bpe_stage)]

#: SQL cannot train the scorer or encode; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
        common.clear(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
