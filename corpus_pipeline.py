"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import decontaminate, mixing, quality_rules, secrets, simhash
from vitalgrid.llm.common import table
from vitalgrid.session import materialize

#: Session setting: a folder all executors see, where the ledger of scanned texts is kept between runs.
SECRET_LEDGER = "vitalgrid.secret.ledger"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; cutoffs by language from the labels."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate component."""
    return simhash.keep_one(docs)


def leave_out_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and their lengths counted again.

    With a ledger's folder in ``SECRET_LEDGER`` only texts are scanned that no earlier run has
    filed there; without one, every run scans its own.
    """
    path = spark.conf.get(SECRET_LEDGER, None)
    masked = secrets.mask_secrets(docs, secrets.open_ledger(docs, path) if path else None)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(masked.schema["n_chars"].dataType), "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of weights 5, 2, 1 takes of the documents, and how often."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", leave_out_benchmark),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
]

#: Fingerprints and certified cutoffs have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the mix."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
