"""The queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, minhash, packing, quality, records, secrets, simhash, sql, substring, token_counts, toxicity
from .common import new_path, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one ledger: the first enters every blob, so that the second scans none and joins the findings back."""
    docs, ledger = table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets.enter(docs, ledger)
    return secrets.digests(secrets.find_secrets(docs, ledger))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_binary_records, op3_toxicity, op4_simhash, op5_token_counts, op6_quality, op7_best_fit_packing, op8_secrets, op9_minhash, op10_substring_dedup)}

ORACLE_SQL: dict[str, str] = {"op8_secrets": sql.secrets(), "op10_substring_dedup": sql.REPEATS}
