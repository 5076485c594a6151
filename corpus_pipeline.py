"""From raw documents to token ids: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes all that its predecessor kept, and its decisions take effect.  Between stages lies a Parquet table
in the shared folder, which outlives lost executors.

Defined results: documents whose text is null, empty or without letters are of no known language and go in the first
stage; given to a later stage, they stay (near-dedup, decontamination and mixing take a text without words for a
document of its own) and have null or no tokens in the last.  Very long texts are taken whole by every stage.  Of rows
that are alike or repeated whole one stays in near-dedup, the one with the least doc_id, ties by text; mixing copies
rows by their source's rate, a null source being a source.  An empty table passes every stage as an empty table.
Further columns, whatever they are called, pass through all stages to the token table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, language, mixing, near_dedup, tokens
from graphloom.llm._cluster import new_path
from graphloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    ship(spark)
    return language.accept_known(docs, language.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    ship(spark)
    return mixing.resample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table of what is left."""
    ship(spark)
    return tokens.token_table(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token-ID output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = new_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Hashing, training, random rounding and a tokeniser have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
