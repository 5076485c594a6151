"""The corpus operators' queries over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, exact_dedup, language, licenses, mixing, near_dedup, pii, secrets, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, written as a record of one of six layouts, and back to canonical turns by the records' fingerprints."""
    records = chat.as_records(_table(spark, sf_dir, "conversations"))
    return chat.format_records(records, "record", "conversation", position="position").drop("fingerprint")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), pii.session_key(spark))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_findings(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_exact_dedup, op4_secret_scan, op5_chat_format, op6_decontamination, op7_pii_surrogates, op8_license_scan, op9_mixing, op10_token_output)}
ORACLES: dict[str, str] = {"op3_exact_dedup": exact_dedup.EXACT_SQL, "op5_chat_format": chat.CHAT_SQL, "op6_decontamination": decontamination.CONTAMINATION_SQL}
